"""Ranked lexical search (11): hashed max-sketches, batched bounds, exact rescoring down to a threshold.

A document's sketch is a row of coordinates, a power of two of at least eight for each of its terms. A term's impact goes
to the two coordinates that its hash names, and a coordinate keeps the maximum of what comes to it; the smaller of a term's two
is at least its impact. An impact rises with the term's occurrences, and all else in it is the document's own; so the
sketch keeps the maximum of the occurrences, from which the impacts follow at look-up, and it stays right when the corpus, and
with it the mean length, grows. A count of 255 stands for any larger one and for the impact's limit.

The index has for each document its sketch and its terms with their counts, in one row. A search looks all terms of a
block of queries up in the sketches of many documents at once: the sum over a query's terms is at least the document's
score. A task takes a query's documents by descending bound and scores them exactly, until the next bound is below the
k-th best exact score so far. A tenth of the index's files goes first, and its k-th best scores are the others' thresholds to
begin with. Every document has its bound taken; only scores that cannot be among the best are not worked out.

Defined cases: a missing or empty text has no terms, and takes no part in counts or results; an item without terms has no
results. Very long texts have wide sketches and are bounded alone. Rows that repeat a doc_id are documents of their own,
and items that repeat an item_id are searched each. Equal scores go by ascending doc_id, rows without a doc_id last. Empty tables
give no rows. Other columns are passed by.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from pulse.llm.shared import kept
from pulse.llm.words import pieces, raw

#: Letters A-Z made small, every other byte below 128 that is no letter or digit made a blank.
_FOLD = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
#: The sketch's code for counts that it cannot hold, and the limit of an impact.
MANY, LIMIT = 255, 1_000_000


@dataclass(frozen=True)
class Settings:
    best: int = 20
    #: Coordinates of a sketch for each distinct term, and the fewest of a sketch.
    width: int = 8
    least: int = 64
    #: Term occurrences of a block of queries; the index is read once for each block.
    block: int = 1_000_000
    #: Sketch cells that a task spreads out at a time, and queries whose bounds it holds at a time.
    cells: int = 1 << 22
    chunk: int = 256


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all that is not ASCII, A-Z in lower case."""
    return text.translate(_FOLD).split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def coordinates(hashed: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """The two coordinates of each term in a sketch whose width is a power of two."""
    last = np.uint64(wide - 1)
    return (hashed & last).astype(np.int64), (((hashed >> np.uint64(32)) ^ (hashed << np.uint64(7))) & last).astype(np.int64)


def impact(count: int, length: int) -> int:
    return 1_000_000_000 * count // (1000 * count + 12 * length)


INDEX = "doc_id long, n long, sketch binary, terms binary, counts binary"


def indexed(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The index, a written table: for each document with terms its length, sketch, terms and counts of terms."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            rows = []
            for doc_id, text in zip(piece.column("doc_id").to_pylist(), raw(piece)):
                counts = Counter(terms(text))
                if not counts:
                    continue
                names, many = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
                wide = max(settings.least, 1 << (settings.width * len(names) - 1).bit_length())
                sketch = np.zeros(wide, np.uint8)
                for place in coordinates(hashes(names), wide):
                    np.maximum.at(sketch, place, np.minimum(many, MANY).astype(np.uint8))
                rows.append((doc_id, int(many.sum()), sketch.tobytes(), b" ".join(names), many.astype("<u4").tobytes()))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                columns = [pa.array(x, t) for x, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "sketch", "terms", "counts"])

    return kept(docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(fold, INDEX), "search-index")


@dataclass(frozen=True)
class Query:
    """One item: its number in the block, its id, and its terms with their repeats."""

    item_id: int | None
    words: dict[bytes, int]


def blocks(items: DataFrame, size: int) -> Iterator[list[Query]]:
    """The items in blocks of about ``size`` term occurrences, so that a block's tables are bounded."""
    block, taken = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        words = Counter(terms((row["text"] or "").encode()))
        if not words:
            continue
        if block and taken + words.total() > size:
            yield block
            block, taken = [], 0
        block.append(Query(row["item_id"], dict(words)))
        taken += words.total()
    if block:
        yield block


def document_counts(index: DataFrame, block: list[Query]) -> dict[bytes, int]:
    """In how many documents each term of the block occurs; a task adds up its own documents first."""
    wanted = frozenset(word for query in block for word in query.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for names in batch.column("terms").to_pylist():
                seen.update(wanted.intersection(names.split(b" ")))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    summed = index.select("terms").mapInArrow(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(row["term"]): row["n"] for row in summed.toLocalIterator()}


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


@dataclass(frozen=True)
class Weighted:
    """A query ready for look-ups: hashes of its terms, and weights times repeats."""

    words: list[bytes]
    weights: list[int]
    hashed: np.ndarray


class Best:
    """The best ``size`` scores so far: highest first, then lowest doc_id."""

    def __init__(self, size: int, least: int):
        self.size, self.least, self.heap = size, max(least, 1), []

    def threshold(self) -> int:
        """A document that scores less is not among the best; one that scores as much may be, by its id."""
        return max(self.least, self.heap[0][0]) if len(self.heap) == self.size else self.least

    def add(self, score: int, doc_id: int | None) -> None:
        if score < self.least:
            return
        entry = (score, doc_id is not None, -(doc_id or 0))
        (heapq.heappush if len(self.heap) < self.size else heapq.heappushpop)(self.heap, entry)


def impacts(sketches: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The impacts that sketches of one width stand for: a row for each coordinate, a column for each document."""
    counts = sketches.T.astype(np.int64)
    found = 1_000_000_000 * counts // (1000 * counts + 12 * lengths)
    found[counts == MANY] = LIMIT
    return np.ascontiguousarray(found, np.float64)


def upper_bounds(found: np.ndarray, query: Weighted) -> np.ndarray:
    """What each document scores at most, by its impacts."""
    first, second = coordinates(query.hashed, len(found))
    most = np.array(query.weights, np.float64) @ np.minimum(found[first], found[second])
    # Sums below 2**53 are exact; the margin covers larger ones.
    return np.ceil(most * (1 + 1e-12))


def score(query: Weighted, counts: dict[bytes, int], length: int) -> int:
    total = 0
    for word, by in zip(query.words, query.weights):
        if count := counts.get(word):
            total += by * impact(count, length)
    return total


FOUND = "item_no long, doc_id long, score long"


def _search(index: DataFrame, queries: list[Weighted], starts: list[int], documents: int, length: int, settings: Settings) -> DataFrame:
    """Each task's best documents for each query; ``starts`` are scores below which nothing is among the best."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(settings.best, least) for least in starts]
        for piece in pieces(batches, "sketch", settings.cells):
            ids, sizes = piece.column("doc_id").to_pylist(), piece.column("n").to_pylist()
            own = [75 + 25 * n * documents // length for n in sizes]
            sketches, names, counts = (piece.column(c) for c in ("sketch", "terms", "counts"))
            # Sketches of one width are looked up together.
            by_width: dict[int, list[int]] = {}
            for place, sketch in enumerate(sketches):
                by_width.setdefault(len(sketch.as_buffer()), []).append(place)
            spread = []
            for wide, places in by_width.items():
                matrix = np.frombuffer(b"".join(sketches[p].as_py() for p in places), np.uint8).reshape(len(places), wide)
                spread.append((places, impacts(matrix, np.array([own[p] for p in places], np.int64))))
            opened: dict[int, dict[bytes, int]] = {}
            bounds = np.empty((min(settings.chunk, len(queries)), len(ids)))
            for first in range(0, len(queries), settings.chunk):
                several = queries[first : first + settings.chunk]
                for places, found in spread:
                    for row, query in enumerate(several):
                        bounds[row, places] = upper_bounds(found, query)
                for query, top, most in zip(several, best[first:], bounds):
                    likely = np.flatnonzero(most >= top.threshold())
                    for place in likely[np.argsort(-most[likely], kind="stable")].tolist():
                        if most[place] < top.threshold():
                            break
                        if place not in opened:
                            opened[place] = dict(zip(names[place].as_py().split(b" "), np.frombuffer(counts[place].as_py(), "<u4").tolist()))
                        top.add(score(query, opened[place], own[place]), ids[place])
        rows = [(no, -minus if known else None, value) for no, top in enumerate(best) for value, known, minus in top.heap]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["item_no", "doc_id", "score"])

    return index.mapInArrow(search, FOUND)


def _top(found: DataFrame, size: int) -> DataFrame:
    """The best rows of each item, with their rank; ranked in 64 parts first, so that no task meets all tasks' rows of an item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parted = found.withColumn("part", F.spark_partition_id() % 64)
    for by in (["item_no", "part"], ["item_no"]):
        parted = parted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= size)
    return parted.drop("part")


def _waves(index: DataFrame) -> list[DataFrame]:
    """A tenth of the index's files, by the last digit of their numbers, and the others."""
    path = index.inputFiles()[:1]
    if not path:
        return []
    reader = lambda pattern: index.sparkSession.read.schema(index.schema).option("pathGlobFilter", pattern).parquet(path[0].rpartition("/")[0])
    return [reader("part-????0-*"), reader("part-{????[1-9],?????[0-9]}-*")]


def search(index: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """item_id, rank, doc_id and score of each item's best documents, out of a table that ``indexed`` wrote."""
    spark = index.sparkSession
    documents, length = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    results = None
    for block in blocks(items, settings.block) if documents else ():
        holding = document_counts(index, block)
        queries = []
        for query in block:
            words = [word for word in query.words if word in holding]
            weights = [query.words[word] * weight(documents, holding[word]) for word in words]
            queries.append(Weighted(words, weights, hashes(words)))
        starts, parts = [1] * len(block), []
        for wave in _waves(index):
            parts.append(kept(_search(wave, queries, starts, documents, length, settings), "search-found"))
            if len(parts) == 1:
                # At least so many documents score as much as the last of the best so far.
                full = _top(parts[0], settings.best).where(F.col("rank") == settings.best)
                for row in full.select("item_no", "score").collect():
                    starts[row["item_no"]] = row["score"]
        found = _top(parts[0].unionAll(parts[1]), settings.best)
        names = spark.createDataFrame([(no, query.item_id) for no, query in enumerate(block)], "item_no long, item_id long")
        block_rows = found.join(names, "item_no").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        results = block_rows if results is None else results.unionAll(block_rows)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if results is None else results
