"""Readers of a result tree ``<root>/<strategy>/<scenario>/<run_id>/<file>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.functions.columns import in_scope, lenient_double, lenient_long
from pulse.schemas import (
    GENERATOR_FILE,
    KEY,
    LAG_FILE,
    LAG_SERIES,
    LATENCY_FILE,
    LATENCY_SAMPLE,
    METADATA_FILE,
    REQUIRED_ARTIFACTS,
    RESOURCE_SERIES,
    RESOURCES_FILE,
    RUN_METADATA,
    RUN_SUMMARY,
    SNAPSHOT,
    SNAPSHOT_FILE,
    SUMMARY_FILE,
    GENERATOR_SUMMARY,
)

_PATH = "_path"


def _file_path() -> Column:
    """Path of the file a row came from, with its %-escapes undone."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _relative_parts(root: str) -> Column:
    """Path parts below the root, from the file path of each row."""
    tail = root.rstrip("/").split("://")[-1].removeprefix("file:") + "/"
    below = F.substring(F.col(_PATH), F.locate(tail, F.col(_PATH)) + len(tail), F.length(_PATH))
    return F.split(below, "/")


def _lines(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Lines of every file of one name below the root, with their path and their place in the file."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root)
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return text.select("value", _file_path().alias(_PATH), place.alias("line"))


def _headers(lines: DataFrame) -> DataFrame:
    """The first line of each file: its column names and its place."""
    first = lines.where("line.start = 0").groupBy(_PATH).agg(F.min_by("value", "line").alias("_first"), F.min("line").alias("_at"))
    names = F.transform(F.split(F.replace("_first", F.lit("\ufeff")), ","), lambda n: F.trim(n))
    return first.select(_PATH, names.alias("_names"), "_at")


def _csv(spark: SparkSession, root: str, name: str, schema: T.StructType, only_present: bool = False) -> DataFrame:
    """Every CSV of one name below the root, as text columns plus the path parts and ``line``, its place in the file.

    Fields go by the names in their file's first line, in any order; columns that a file lacks are null there, and
    others are passed over. A record with more fields than its header is dropped, one with fewer keeps the fields it
    has and nulls. The files hold no quoted commas. ``only_present`` leaves out the columns that no file has.
    """
    lines = _lines(spark, root, name)
    headers = _headers(lines)
    fields = F.split("value", ",", -1)
    rows = lines.where("value <> ''").join(headers, _PATH).where((F.col("line") != F.col("_at")) & (F.size(fields) <= F.size("_names")))
    wanted = schema.names
    if only_present:
        # Distinct column names: as many as the files' layout has, however many files.
        there = {r[0] for r in headers.select(F.explode("_names")).distinct().collect()}
        wanted = [n for n in wanted if n in there]

    def field(column: str) -> Column:
        place = F.array_position("_names", column).cast("int")
        return F.nullif(F.get(fields, F.nullif(place, F.lit(0)) - 1), F.lit("")).alias(column)

    return rows.select(*map(field, wanted), "line", _relative_parts(root).alias("_parts"))


def _label(place: int) -> Column:
    return F.get(F.col("_parts"), F.lit(place))


def _labelled(df: DataFrame, path_first: bool) -> DataFrame:
    """Run labels from the path, over or under the file's own."""
    for place, name in enumerate(KEY):
        own = F.col(name) if name in df.columns else F.lit(None).cast("string")
        value = F.coalesce(_label(place), own) if path_first else F.coalesce(own, _label(place))
        df = df.withColumn(name, value)
    return df


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    def cast(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.DoubleType):
            return lenient_double(f.name)
        if isinstance(f.dataType, T.LongType):
            return lenient_long(f.name)
        return F.col(f.name)

    return df.select(*[cast(f).alias(f.name) for f in schema.fields])


def read_latency_samples(
    spark: SparkSession, root: str, scope: str = "official", *, flat_root: bool = False, raw: bool = False
) -> DataFrame:
    """Latency samples of every run; the path decides the labels.

    ``flat_root`` also takes a file lying in the root itself, with the labels it holds, and files
    three levels deep. ``raw`` leaves the number columns as text, and out those that no file has, for the
    quality rules.
    """
    df = _csv(spark, root, LATENCY_FILE, LATENCY_SAMPLE, only_present=raw).drop("line")
    depth = F.size("_parts")
    if flat_root:
        nested = _labelled(df.where(depth >= 3), path_first=True)
        df = nested.unionByName(df.where(depth == 1), allowMissingColumns=True)
    else:
        df = _labelled(df.where(depth >= 4), path_first=True)
    df = df.where(in_scope("scenario", scope)).drop("_parts")
    return df if raw else _typed(df, LATENCY_SAMPLE).where(F.col("latency_ms").isNotNull())


def _json(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """One document per file; the path fills only the labels a document lacks."""
    df = (
        spark.read.schema(schema)
        .option("multiLine", "true")
        .option("mode", "DROPMALFORMED")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", name)
        .json(root)
        .withColumn(_PATH, _file_path())
        .withColumn("_parts", _relative_parts(root))
    )
    return _labelled(df.where(F.size("_parts") >= 4), path_first=False).drop("_parts", _PATH)


def read_run_metadata(spark: SparkSession, root: str) -> DataFrame:
    return _json(spark, root, METADATA_FILE, RUN_METADATA)


def read_run_summaries(spark: SparkSession, root: str) -> DataFrame:
    return _json(spark, root, SUMMARY_FILE, RUN_SUMMARY)


def read_generator_summaries(spark: SparkSession, root: str) -> DataFrame:
    return _json(spark, root, GENERATOR_FILE, GENERATOR_SUMMARY)


def _series(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    df = _csv(spark, root, name, schema)
    df = _labelled(df.where(F.size("_parts") >= 4), path_first=False)
    return _typed(df.drop("_parts", "line"), schema)


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Metric snapshots in long form, with ``line`` to tell a later value from an earlier one of the same file."""
    df = _csv(spark, root, SNAPSHOT_FILE, SNAPSHOT)
    df = _labelled(df.where(F.size("_parts") >= 4), path_first=False)
    typed = [lenient_double("value").alias("value") if c == "value" else F.col(c) for c in SNAPSHOT.names]
    return df.select(*typed, "line")


def read_lag_series(spark: SparkSession, root: str) -> DataFrame:
    df = _series(spark, root, LAG_FILE, LAG_SERIES)
    return df.withColumn("lag_source", F.coalesce("lag_source", F.lit("unknown")))


def read_resource_series(spark: SparkSession, root: str) -> DataFrame:
    return _series(spark, root, RESOURCES_FILE, RESOURCE_SERIES)


def artifact_inventory(spark: SparkSession, root: str, kinds: list[str] = REQUIRED_ARTIFACTS) -> DataFrame:
    """Which artifact kinds each run has, from a file listing; no content is read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select(F.col("path").alias(_PATH))
        .withColumn("_parts", _relative_parts(root))
        .where(F.size("_parts") >= 4)
    )
    return files.select(
        *[_label(place).alias(name) for place, name in enumerate(KEY)],
        F.element_at("_parts", -1).alias("artifact"),
    ).where(F.col("artifact").isin(kinds)).distinct()
