"""Tables and files in the folder that all machines of the cluster share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.session import shared_dir


def kept(df: DataFrame, label: str) -> DataFrame:
    """The frame written as a table to the shared folder and read again: its lineage ends there.

    Every later use reads the table, and a lost executor costs no recomputation of what came before.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Schemes of Hadoop that Arrow knows by another name.
_SCHEMES = {"s3a://": "s3://", "s3n://": "s3://"}


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it; usable in tasks and in the driver.

    ``shared_dir`` gives paths without a scheme only where the default file system is the local one.
    """
    for name, own in _SCHEMES.items():
        path = own + path.removeprefix(name) if path.startswith(name) else path
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_whole(path: str, chunks) -> int:
    """A file written under a name of its own and moved when it is whole, so no reader sees half of it."""
    system, place = file_system(path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    part, size = f"{place}.{uuid.uuid4().hex}.part", 0
    with system.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    system.move(part, place)
    return size


def bounded_sample(df: DataFrame, rows: int, label: str, text: str, most_bytes: int) -> DataFrame:
    """At most ``rows`` different rows with a ``text`` of 1 to ``most_bytes`` bytes: those with the smallest hashes of all their columns.

    The same rows in every run. Estimates of the different hashes by their first 12 bits show in which prefix the sample ends,
    those by the next 12 bits, of that prefix alone, where in it; half as many again as asked for are looked for, as the
    estimates may be a tenth off. So a table of 10^10 rows has some hundreds of candidates more. Copies of a row are one, however many.
    """
    fit = df.where(F.octet_length(text).between(1, most_bytes)).withColumn("_hash", F.xxhash64(*df.columns))
    last, left = 0, rows + rows // 2
    for shift in (52, 40):
        # The digits before this one are those in which the sample ends.
        inside = fit if shift == 52 else fit.where(F.shiftrightunsigned("_hash", 52) == last)
        digit = F.shiftrightunsigned("_hash", shift) % 4096
        estimates = inside.groupBy(digit.alias("d")).agg(F.approx_count_distinct("_hash", 0.1).alias("n")).collect()
        at = 4095
        for found in sorted(estimates):
            if found["n"] >= left:
                at = found["d"]
                break
            left -= found["n"]
        last = last * 4096 + at
    near = fit.where(F.shiftrightunsigned("_hash", 40) <= last).dropDuplicates()
    return kept(near.orderBy("_hash", *df.columns).limit(rows).drop("_hash"), label)


@dataclass(frozen=True)
class Bitmap:
    """A set of whole numbers by a bit for each hash cell, kept in files of the shared folder, one for each stripe.

    It lets through every number that is in it, and others at the rate at which its cells are taken.
    """

    folder: str
    cells: int
    stripe: int = 1 << 23

    @staticmethod
    def written(numbers: DataFrame, folder: str, cells: int) -> Bitmap:
        """From a table of one column; each stripe is put together by one task, from the cells alone."""
        made = Bitmap(folder, cells)
        column = numbers.columns[0]

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = made.cell(batch.column(column).drop_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(cell // made.stripe), pa.array(cell % made.stripe)], names=["stripe", "cell"])

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, bits = None, None
            for batch in batches:
                stripes, cells = (batch.column(c).to_numpy() for c in ("stripe", "cell"))
                for number in np.unique(stripes).tolist():
                    if number != now:
                        if now is not None:
                            write_whole(f"{folder}/{now}", [np.packbits(bits).tobytes()])
                        now, bits = number, np.zeros(made.stripe, bool)
                    bits[cells[stripes == number]] = True
            if now is not None:
                write_whole(f"{folder}/{now}", [np.packbits(bits).tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], names=["stripe"])

        marked = numbers.mapInArrow(mark, "stripe long, cell long").distinct()
        ordered = marked.repartition(partitions(numbers.sparkSession), "stripe").sortWithinPartitions("stripe")
        ordered.mapInArrow(write, "stripe long").write.format("noop").mode("overwrite").save()
        return made

    def cell(self, numbers: np.ndarray) -> np.ndarray:
        z = numbers.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((z ^ (z >> np.uint64(29))) % np.uint64(self.cells)).astype(np.int64)

    def read(self) -> Members:
        system, place = file_system(self.folder)
        bits = np.zeros(-(-self.cells // self.stripe) * self.stripe // 8, np.uint8)
        for number in range(-(-self.cells // self.stripe)):
            if system.get_file_info(f"{place}/{number}").is_file:
                with system.open_input_file(f"{place}/{number}") as file:
                    bits[number * self.stripe // 8 : (number + 1) * self.stripe // 8] = np.frombuffer(file.read(), np.uint8)
        return Members(self, bits)


@dataclass(frozen=True)
class Members:
    """A bitmap in memory."""

    of: Bitmap
    bits: np.ndarray

    def has(self, numbers: np.ndarray) -> np.ndarray:
        cell = self.of.cell(numbers)
        return (self.bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
