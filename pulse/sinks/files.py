"""Reports and per-run documents as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.operators.keys import in_display_order
from pulse.schemas import KEY, LATENCY_SAMPLE
from pulse.sinks.manifests import new_name


def write_samples_csv(samples: DataFrame, path: str) -> None:
    """Samples in visible order with a header. The files' names follow the order; each is one
    range of it, so no task sorts the whole."""
    ordered = samples.select(*LATENCY_SAMPLE.names).orderBy("visible_at", "event_id")
    ordered.write.mode("overwrite").option("header", "true").csv(path)


def write_report(report: DataFrame, path: str, fmt: str = "csv") -> None:
    """A report table, in display order where it has the columns for it."""
    if {"strategy", "scenario"} <= set(report.columns):
        report = in_display_order(report, then=[c for c in ("run_id", "elapsed_s") if c in report.columns])
    writer = report.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", "true").csv(path)
    else:
        writer.format(fmt).save(path)


def write_run_documents(documents: DataFrame, path: str) -> None:
    """One JSON document per run, in a folder per run key."""
    documents.write.mode("overwrite").partitionBy(*KEY).json(path)


def write_tree(rows: DataFrame, root: str, name: str, order: Sequence[str] = (), fmt: str = "csv") -> None:
    """One file ``<root>/<strategy>/<scenario>/<run_id>/<name>`` for each run, in the given order; CSV files have a header.

    The layout asks for one file a run, so a run is written by one task, as a stream. The tasks write to a folder of
    their own, and each run's file is moved to its place from there: the tree never has half a file.
    """
    spark, draft = rows.sparkSession, f"{root.rstrip('/')}/.writing-{new_name()}"
    places = [f"of_{c}" for c in KEY]
    placed = rows.withColumns({place: F.col(c) for place, c in zip(places, KEY)})
    ordered = placed.repartition(*places).sortWithinPartitions(*places, *order)
    ordered.write.option("header", "true").partitionBy(*places).format(fmt).save(draft)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    files = path(draft).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    unescape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    for found in files.globStatus(path("/".join([draft, *["of_*"] * len(places), "part-*"]))) or []:
        labels, at = [], found.getPath().getParent()
        for _ in places:
            labels.append(unescape(at.getName().partition("=")[2]))
            at = at.getParent()
        target = path("/".join([root.rstrip("/"), *reversed(labels)]))
        files.mkdirs(target)
        there = path(target, name)
        files.delete(there, False)
        if not files.rename(found.getPath(), there):
            raise OSError(f"could not move a file to {there}")
    files.delete(path(draft), True)
