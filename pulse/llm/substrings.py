"""Substring dedup (5): a count-min prefilter over windows of words, then exact grouping of the rest.

First pass: every task counts the documents that have each window, in a sketch whose cell is chosen by the
window's hash. Its sketches are sparse and sent in stripes of cells; a stripe's sums over all tasks never
fall below a window's true count. What stays of the sketch is a bit for each cell: counted twice or more.

Second pass: only windows in such cells are grouped, exactly, by 96 bits of hash; windows that occur twice are all among
them. A task reduces them first: of each window only the smallest document is sent on, all
other documents with it are known to repeat it. So the most frequent passage has one row per task.

Last, the words of the windows found are taken out of the texts.

The sketch has ``Settings.cells_per_byte`` cells for each byte of text, up to ``most_cells``; it is read by every
worker. Beyond that size it lets more windows through and spares less, but the result stays the same.

Defined cases: a missing text has no words. A text with fewer words than a window keeps all. A row without
doc_id keeps all its words and makes nothing else a repeat. Rows with one doc_id do not repeat each other, whatever
their texts. Very long texts are read whole. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.llm.shared import file_system, partitions, write_whole
from pulse.llm.words import covered, pieces, raw, split, window_hashes, word_hashes
from pulse.session import shared_dir


@dataclass(frozen=True)
class Settings:
    window: int = 13
    cells_per_byte: float = 0.5
    least_cells: int = 1 << 20
    #: Half a GB of bits in every worker.
    most_cells: int = 1 << 32
    stripe: int = 1 << 22


PIECE = 16 << 20
_HALF = np.uint64(32)


def _cells(hashes: np.ndarray, width: int) -> np.ndarray:
    return ((hashes >> _HALF) * np.uint64(width)) >> _HALF


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length in one compressed block, a byte place at a time, which compresses better."""
    planes = [np.frombuffer(a.tobytes(), np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(block: bytes, *types) -> list[np.ndarray]:
    data, arrays, at = zstandard.ZstdDecompressor().decompress(block), [], 0
    widths = [np.dtype(t).itemsize for t in types]
    n = len(data) // sum(widths)
    for kind, width in zip(types, widths):
        plane = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        arrays.append(np.frombuffer(plane.T.tobytes(), kind))
        at += n * width
    return arrays


def _deltas(cells: np.ndarray) -> bytes:
    return _pack(np.diff(cells, prepend=cells.dtype.type(0)).astype(np.uint32))


def _undeltas(block: bytes) -> np.ndarray:
    return np.cumsum(_unpack(block, np.uint32)[0], dtype=np.int64)


def _windows(piece: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, second hash, row of the piece, first word) of all windows of the rows with a doc_id."""
    found = []
    known = piece.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
    for row, text in enumerate(raw(piece)):
        if known[row]:
            words = word_hashes(split(text))
            hashes = window_hashes(words, size)
            second = (window_hashes(words, size, 7) >> _HALF).astype(np.uint32)
            found.append((hashes, second, np.full(len(hashes), row, np.uint32), np.arange(len(hashes), dtype=np.uint32)))
    if not found:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint32, np.uint32, np.uint32))
    return tuple(np.concatenate(x) for x in zip(*found))


def _sketch(docs: DataFrame, width: int, folder: str, settings: Settings) -> None:
    """Writes a file of bits for each stripe of cells: whether the stripe's cell counts two documents or more."""
    size, stripe = settings.window, settings.stripe

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=PIECE):
            hashes, _, row, _ = _windows(piece, size)
            # A document counts once in a cell.
            pairs = np.unique((_cells(hashes, width) << _HALF) | row.astype(np.uint64))
            cells, times = np.unique((pairs >> _HALF).astype(np.int64), return_counts=True)
            stripes, blocks = [], []
            for number in np.unique(cells // stripe).tolist():
                low, high = np.searchsorted(cells, (number * stripe, (number + 1) * stripe))
                part, twice = cells[low:high] - number * stripe, times[low:high] > 1
                stripes.append(number)
                blocks.append((_deltas(part.astype(np.uint32)), _deltas(part[twice].astype(np.uint32))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(stripes, pa.int64()), *(pa.array(x, pa.binary()) for x in (zip(*blocks) if blocks else ([], [])))],
                names=["stripe", "cells", "twice"],
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def write(number: int, total: np.ndarray) -> pa.RecordBatch:
            write_whole(f"{folder}/{number}", [np.packbits(total > 1).tobytes()])
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64())], names=["stripe"])

        now, total = None, None
        for batch in batches:
            for number, cells, twice in zip(*(batch.column(c).to_pylist() for c in ("stripe", "cells", "twice"))):
                if number != now:
                    if now is not None:
                        yield write(now, total)
                    now, total = number, np.zeros(stripe, np.uint8)
                for block in (cells, twice):
                    at = _undeltas(block)
                    total[at] = np.minimum(total[at] + 1, 2)
        if now is not None:
            yield write(now, total)

    parts = docs.mapInArrow(count, "stripe long, cells binary, twice binary")
    merged = parts.repartition(partitions(docs.sparkSession), "stripe").sortWithinPartitions("stripe")
    merged.mapInArrow(merge, "stripe long").write.format("noop").mode("overwrite").save()


def _read_bits(folder: str, width: int, stripe: int) -> np.ndarray:
    """The sketch's bits, as bytes of eight cells each; stripes without a file have no window."""
    bits = np.zeros(-(-width // stripe) * stripe // 8, np.uint8)
    system, place = file_system(folder)
    for number in range(-(-width // stripe)):
        info = system.get_file_info(f"{place}/{number}")
        if info.is_file:
            with system.open_input_file(f"{place}/{number}") as file:
                bits[number * stripe // 8 : (number + 1) * stripe // 8] = np.frombuffer(file.read(), np.uint8)
    return bits


_PROBE = (np.uint64, np.uint32, np.int64, np.int64, np.uint32)
_FLAG = (np.int64, np.uint32)


def _by_target(keys: np.ndarray, at: np.ndarray, targets: int) -> list[tuple[int, bytes]]:
    """Places to take out, packed for each group of documents."""
    target = keys % targets
    order = np.lexsort((at, keys, target))
    keys, at, target = keys[order], at[order], target[order]
    cuts = [0, *(np.flatnonzero(target[1:] != target[:-1]) + 1), len(keys)]
    return [(int(target[a]), _pack(keys[a:b], at[a:b])) for a, b in zip(cuts, cuts[1:]) if b > a]


def _firsts(same: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For rows ordered by window and document, where a new window begins if same[k] says that row k has the window
    of row k - 1: the first document of each row's window."""
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    return docs[start]


def _same(hashes: np.ndarray, second: np.ndarray) -> np.ndarray:
    return np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (second[1:] == second[:-1])]) if len(hashes) else np.empty(0, bool)


def _repeated(docs: DataFrame, width: int, folder: str, settings: Settings) -> DataFrame:
    """Blocks (target, block) of the first words of windows that a smaller document has too."""
    size, stripe, spread = settings.window, settings.stripe, partitions(docs.sparkSession)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None
        for piece in pieces(batches, limit=PIECE):
            if bits is None:
                bits = _read_bits(folder, width, stripe)
            hashes, second, row, at = _windows(piece, size)
            cells = _cells(hashes, width)
            likely = np.flatnonzero(bits[cells >> np.uint64(3)] >> (7 - (cells & np.uint64(7)).astype(np.uint8)) & 1)
            del cells
            hashes, second, row, at = (x[likely] for x in (hashes, second, row, at))
            doc, key = (piece.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("doc_id", "row_key"))
            doc, key = doc[row], key[row]
            order = np.lexsort((doc, second, hashes))
            hashes, second, doc, key, at = (x[order] for x in (hashes, second, doc, key, at))
            later = doc > _firsts(_same(hashes, second), doc)
            rows = [(t, True, b) for t, b in _by_target(key[later], at[later], spread)]
            hashes, second, doc, key, at = (x[~later] for x in (hashes, second, doc, key, at))
            bucket = ((hashes >> np.uint64(20)) % np.uint64(spread)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(spread + 1))
            for number in range(spread):
                if len(part := order[cuts[number] : cuts[number + 1]]):
                    rows.append((number, False, _pack(*(x[part] for x in (hashes, second, doc, key, at)))))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.binary()))], names=["target", "done", "block"]
                )

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(blocks: list[bytes]) -> pa.RecordBatch | None:
            hashes, second, doc, key, at = (np.concatenate(x) for x in zip(*(_unpack(b, *_PROBE) for b in blocks)))
            order = np.lexsort((doc, second, hashes))
            doc = doc[order]
            later = doc > _firsts(_same(hashes[order], second[order]), doc)
            found = order[later]
            return flags(_by_target(key[found], at[found], spread))

        def flags(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
            targets, blocks = zip(*rows) if rows else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(targets, pa.int32()), pa.array(blocks, pa.binary())], names=["target", "block"])

        now, waiting = None, []
        for batch in batches:
            done = []
            for target, ready, block in zip(*(batch.column(c).to_pylist() for c in ("target", "done", "block"))):
                if ready:
                    done.append((target, block))
                    continue
                if target != now and waiting:
                    yield close(waiting)
                    waiting = []
                now = target
                waiting.append(block)
            yield flags(done)
        if waiting:
            yield close(waiting)

    probes = docs.mapInArrow(probe, "target int, done boolean, block binary")
    dealt = probes.repartitionById(spread, F.col("target")).sortWithinPartitions("done", "target")
    return dealt.mapInArrow(group, "target int, block binary")


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def deduplicated(docs: DataFrame, settings: Settings = Settings(), with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept words joined by one space, of every row."""
    spark, size = docs.sparkSession, settings.window
    spread = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row_key"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = int(min(settings.most_cells, max(settings.least_cells, total * settings.cells_per_byte)))
    folder = shared_dir(spark, "sketch")
    _sketch(rows, width, folder, settings)
    flags = _repeated(rows, width, folder, settings)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, keys, places = None, [], None, None
        for batch in batches:
            for piece in pieces([batch]):
                out = []
                columns = (piece.column(c).to_pylist() for c in ("target", "block", "doc_id", "row_key"))
                for (target, block, doc_id, key), text in zip(zip(*columns), raw(piece)):
                    if target != now:
                        now, blocks, keys = target, [], None
                    if block is not None:
                        blocks.append(block)
                        continue
                    if keys is None:
                        parts = list(zip(*(_unpack(b, *_FLAG) for b in blocks)))
                        keys, places = (np.concatenate(x) for x in parts) if parts else (np.empty(0, np.int64), np.empty(0, np.uint32))
                        order = np.argsort(keys, kind="stable")
                        keys, places, blocks = keys[order], places[order], []
                    words = split(text)
                    low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
                    left = words
                    if high > low and doc_id is not None:
                        left = list(compress(words, ~covered(places[low:high].astype(np.int64), size, len(words))))
                    joined = b" ".join(left)
                    kept_text = joined.decode() if with_text else None
                    out.append((doc_id, len(words), len(words) - len(left), hashlib.sha256(joined).hexdigest(), kept_text))
                if out:
                    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)

    # Flags come before the texts of their group.
    empty = lambda kind, name: F.lit(None).cast(kind).alias(name)
    target = F.pmod("row_key", F.lit(spread)).cast("int").alias("target")
    texts = rows.select(target, empty("binary", "block"), "doc_id", "row_key", "text")
    both = flags.select("target", "block", empty("long", "doc_id"), empty("long", "row_key"), empty("string", "text")).unionAll(texts)
    ordered = both.repartitionById(spread, F.col("target")).sortWithinPartitions("target", F.col("block").isNull())
    return ordered.mapInArrow(cut, RESULT)
