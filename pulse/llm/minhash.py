"""b-bit MinHash near-duplicates (10).

A document's shingles are hashed, and the smallest value under each of 128 functions is taken. Groups of
four minima are band keys: documents that share a key are candidates (at a similarity of 0.8 a pair
shares none of 32 keys once in 20 million). Of each minimum only the low 4 bits are kept, packed in
64 bytes a document. Equal places are counted by bit operations, and the share of places that agree by
chance is taken off; only pairs whose estimate can belong to a true similarity of the threshold are
compared on their full shingle sets.

No group of candidates is expanded into all its pairs. Documents with equal sets are one node. Each member of a
band's group is compared with the group's smallest member; the links found make components. Groups
that still hold more than one component are compared again, and there only members outside the group's
largest component meet the rest, and only across components. So every candidate pair is either compared
or already connected through compared links.

Defined cases: a missing or blank text has no shingles and is linked with nothing. A text with fewer words
than a shingle is one shingle. Repeated rows with one doc_id are one node of the graph, and each row gets
its component. A row without doc_id is linked with nothing and kept. An empty table gives no rows. Only doc_id and
text are read, so other columns, whatever their names, do not matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.llm.components import components
from pulse.llm.shared import Bitmap, kept, partitions
from pulse.llm.words import mixed, odd_numbers, pieces, raw, runs, split, window_hashes, word_hashes
from pulse.session import shared_dir


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    #: Least similarity of a link, in percent.
    percent: int = 80
    bands: int = 32
    rows: int = 4
    #: Standard errors by which the estimate of a true link may fall short.
    errors: float = 5.0

    @property
    def places(self) -> int:
        return self.bands * self.rows

    @property
    def most_unequal(self) -> int:
        """Places that may differ: the expected number at the threshold and so many standard errors.

        Two places agree by similarity, or by chance once in 16: at similarity s the share of unequal
        places is (1 - s) * 15 / 16.
        """
        p = (1 - self.percent / 100) * 15 / 16
        return int(self.places * p + self.errors * (self.places * p * (1 - p)) ** 0.5)


BITS = 4
SIGNATURE = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, bits array<long>"


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, A-Z in lower case."""
    hashes = word_hashes(split(text.lower()))
    return np.unique(window_hashes(hashes, min(size, len(hashes)))) if len(hashes) else np.empty(0, np.uint64)


def signatures(sets: list[np.ndarray], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, packed low bits) of the documents' sets, none of which is empty; a row for each document."""
    factors, n = odd_numbers(settings.places, 2), len(sets)
    minima = np.empty((n, settings.places), np.uint32)
    lengths = np.array([len(s) for s in sets])
    start = 0
    while start < n:  # some documents at a time, so that their values stay in the cache
        stop = max(start + 1, start + int(np.searchsorted(np.cumsum(lengths[start:]), 1 << 16, "right")))
        values = np.concatenate(sets[start:stop])
        heads = np.concatenate([[0], np.cumsum(lengths[start : stop - 1])])
        product = np.empty_like(values)
        for k, factor in enumerate(factors):
            np.multiply(values, factor, out=product)
            minima[start:stop, k] = np.minimum.reduceat(product, heads) >> np.uint64(32)
        start = stop
    bands = np.zeros((n, settings.bands), np.uint64)
    by_band = minima.reshape(n, settings.bands, settings.rows).astype(np.uint64)
    for k in range(settings.rows):
        bands = mixed(bands * np.uint64(31) + by_band[:, :, k] + np.uint64(k + 1))
    bands = mixed(bands + np.arange(settings.bands, dtype=np.uint64)[None, :])
    low = (minima & np.uint32(15)).astype(np.uint64).reshape(n, -1, 64 // BITS)
    packed = (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))[None, None, :]).sum(axis=2, dtype=np.uint64)
    return bands.view(np.int64), packed.view(np.int64)


def signed(docs: DataFrame, settings: Settings) -> DataFrame:
    """Per document the size and a 128-bit hash of its set, its band keys and its packed signature."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = odd_numbers(2, 3)
        for piece in pieces(batches):
            sets = [shingles(text, settings.shingle) for text in raw(piece)]
            full = [s for s in sets if len(s)]
            rows = {"bands": [None] * len(sets), "bits": [None] * len(sets)}
            if full:
                bands, bits = signatures(full, settings)
                for k, row in enumerate(np.flatnonzero([len(s) > 0 for s in sets])):
                    rows["bands"][row], rows["bits"][row] = bands[k], bits[k]
            # Sums of mixed members: equal sets have equal hashes.
            digest = lambda f: [int(mixed(s * f).sum(dtype=np.uint64).view(np.int64)) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id").cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digest(first), pa.int64()),
                    pa.array(digest(second), pa.int64()),
                    pa.array(rows["bands"], pa.list_(pa.int64())),
                    pa.array(rows["bits"], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "bits"],
            )

    return docs.select("doc_id", "text").mapInArrow(sign, SIGNATURE)


def unequal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of 4-bit places in which packed signatures differ; longs are the last axis."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1, dtype=np.int64)


def estimated(places_unequal: np.ndarray, places: int) -> np.ndarray:
    """Similarity by the share of unequal places, corrected for those that agree by chance."""
    return np.maximum(0.0, 1 - places_unequal / places * 16 / 15)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, width)


def _sets(docs: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """doc_id and full shingle set, as bytes, of the documents in ``nodes``, and of a few others.

    The texts are not shuffled: every task asks a bitmap of the wanted ids' hashes, which lets a few others through; what
    uses the sets joins them by doc_id. The bitmap lies in the shared folder and takes two bytes for each wanted id.
    """
    spark = docs.sparkSession
    ids = nodes.select("doc_id").distinct()
    cells = max(1 << 16, 16 * ids.count())
    bits = Bitmap.written(ids.select("doc_id"), shared_dir(spark, "wanted"), cells)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None
        for piece in pieces(batches):
            wanted = bits.read() if wanted is None else wanted
            known = wanted.has(piece.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False))
            piece = piece.filter(pa.array(known & piece.column("doc_id").is_valid().to_numpy(zero_copy_only=False)))
            sets = [shingles(text, settings.shingle).tobytes() for text in raw(piece)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(sets, pa.binary())], names=["doc_id", "members"])

    return kept(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, "doc_id long, members binary"), "sets")


def _linked(a: bytes, b: bytes, percent: int) -> bool:
    """Whether two sets are as similar as asked for."""
    a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (u, v) whose full sets are as similar as asked for.

    pairs has a column ``block``: pairs of one block share many documents, and a block has a bounded number
    of them. A document's set is sent once to each block, not once for each pair.
    """
    spread = partitions(pairs.sparkSession)
    places = pairs.select("block", F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    sent = places.join(sets, "doc_id").select("block", F.col("doc_id").alias("u"), F.lit(None).cast("long").alias("v"), "members")
    asked = pairs.select("block", "u", "v", F.lit(None).cast("binary").alias("members"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, "block"):
            known = defaultdict(list)  # more than one set only if rows repeat a doc_id
            found = []
            for u, v, members in zip(*(block.column(c).to_pylist() for c in ("u", "v", "members"))):
                if members is not None:
                    known[u].append(members)
                elif any(_linked(a, b, settings.percent) for a in known[u] for b in known[v]):
                    found.append((u, v))
            u, v = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    rows = sent.unionAll(asked).repartition(spread, "block").sortWithinPartitions("block", F.col("members").isNull())
    return rows.mapInArrow(check, "u long, v long")


#: Members of a group that meet in one block, on either side.
OUTER, INNER = 128, 512


def _across(rows: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Links (u, v) between members of one band's group that are in different components.

    rows: band, doc_id, part (component), main (the group's largest component), n_all and n_out (members, and
    members outside main), bits, bands. Groups are cut in blocks. First each block finds, by the estimate, which of
    its members have a partner in it; only these come again, with their sets, and are compared exactly. So no pair
    leaves a block but a link. A pair is compared only in the first of the bands that it shares.
    """
    spread, longs, most = partitions(rows.sparkSession), settings.places * BITS // 64, settings.most_unequal
    part = lambda n, size: F.pmod(F.xxhash64("doc_id"), F.ceil(F.col(n) / size))
    all_parts = lambda n, size: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / size) - 1))
    fields = ["band", "doc_id", "part", "main", "bits", "bands"]
    outer = rows.where("part <> main").select(*fields, F.lit(0).alias("side"), part("n_out", OUTER).alias("i"), all_parts("n_all", INNER).alias("j"))
    inner = rows.select(*fields, F.lit(1).alias("side"), all_parts("n_out", OUTER).alias("i"), part("n_all", INNER).alias("j"))
    blocks = outer.unionByName(inner).withColumn("block", F.xxhash64("band", "i", "j")).drop("i", "j")

    def pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a block that may be linked, as two arrays of places."""
        side = table.column("side").to_numpy()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(a) or not len(b):
            return a[:0], b[:0]
        ids, parts, main = (table.column(c).to_numpy() for c in ("doc_id", "part", "main"))
        bits, bands = _matrix(table.column("bits"), longs), _matrix(table.column("bands"), settings.bands)
        x, y = np.nonzero(unequal(bits[a][:, None, :], bits[b][None, :, :]) <= most)
        x, y = a[x], b[y]
        # Two members outside the main component meet once, not twice.
        ok = (parts[x] != parts[y]) & ((parts[y] == main[y]) | (ids[x] < ids[y]))
        x, y = x[ok], y[ok]
        first = (bands[x] == bands[y]).argmax(axis=1)
        ok = bands[x, first] == table.column("band").to_numpy().view(np.uint64)[x]
        return x[ok], y[ok]

    def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "block"):
            rows = np.unique(np.concatenate(pairs(table)))
            if len(rows):
                yield from table.take(pa.array(rows)).combine_chunks().to_batches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "block"):
            members, ids = table.column("members").to_pylist(), table.column("doc_id").to_pylist()
            found = [(ids[x], ids[y]) for x, y in zip(*pairs(table)) if _linked(members[x], members[y], settings.percent)]
            u, v = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    shape = blocks.schema
    ordered = blocks.repartition(spread, "block").sortWithinPartitions("block", "side")
    some = kept(ordered.mapInArrow(partnered, shape), "partnered")
    again = some.join(sets, "doc_id").repartition(spread, "block").sortWithinPartitions("block", "side")
    return again.mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: for every document the smallest doc_id it is linked with, also
    over other documents, and whether it is that one."""
    found = kept(signed(docs, settings), "signatures")
    full = found.where("n_shingles > 0 and doc_id is not null")
    key = ["n_shingles", "set_a", "set_b"]
    same = kept(full.groupBy(*key).agg(F.min("doc_id").alias("rep")), "equal")
    # One signature for each different set: that of the row of its smallest doc_id.
    nodes = full.join(same.select("rep", *key), key).where("doc_id = rep").dropDuplicates(["doc_id", *key])
    nodes = kept(nodes.select("doc_id", "bits", "bands"), "nodes")

    banded = nodes.select("doc_id", F.explode("bands").alias("band"))
    groups = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("doc_id").alias("lead")).where("n > 1")
    members = kept(banded.join(groups, "band"), "members")
    stars = members.where("doc_id <> lead").select(F.col("lead").alias("u"), F.col("doc_id").alias("v")).distinct()
    tried = kept(_alike(stars, nodes, settings), "tried")
    crowd = tried.groupBy("u").agg(F.ceil(F.count("*") / INNER).alias("parts"))
    block = F.xxhash64("u", F.pmod(F.xxhash64("v"), "parts"))
    sets = _sets(docs, members, settings)
    first = components(confirmed(tried.join(crowd, "u").withColumn("block", block), sets, settings))

    # Groups of three and more whose members are not all in one component yet.
    placed = members.where("n > 2").join(first, F.col("doc_id") == F.col("node"), "left")
    placed = kept(placed.select("band", "doc_id", F.coalesce("component", "doc_id").alias("part")), "placed")
    sizes = placed.groupBy("band", "part").agg(F.count("*").alias("n"))
    most = sizes.groupBy("band").agg(F.count("*").alias("parts"), F.sum("n").alias("n_all"), F.max(F.struct("n", "part")).alias("most"))
    divided = most.where("parts > 1").select("band", "n_all", (F.col("n_all") - F.col("most.n")).alias("n_out"), F.col("most.part").alias("main"))
    late = _across(placed.join(divided, "band").join(nodes, "doc_id"), sets, settings)
    linked = components(first.select(F.col("node").alias("u"), F.col("component").alias("v")).unionAll(late))

    owner = same.join(linked, F.col("rep") == F.col("node"), "left").select(
        *(F.col(k).alias(f"own_{k}") for k in key), F.coalesce("component", "rep").alias("component_id")
    )
    rows = found.select("doc_id", *key).join(owner, [F.col(k) == F.col(f"own_{k}") for k in key], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def _alike(pairs: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (u, v) whose estimated similarity allows a link.

    A doc_id whose rows have different sets has no one signature: its pairs all go on to the exact check, which tries all sets.
    """
    longs, most = settings.places * BITS // 64, settings.most_unequal

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            close = unequal(_matrix(table.column("x"), longs), _matrix(table.column("y"), longs)) <= most
            several = batch.column("several").to_numpy(zero_copy_only=False)
            yield batch.select(["u", "v"]).filter(pa.array(close | several))

    bits = nodes.groupBy("doc_id").agg(F.first("bits").alias("bits"), (F.count("*") > 1).alias("several"))
    with_u = pairs.join(bits.select(F.col("doc_id").alias("u"), F.col("bits").alias("x"), F.col("several").alias("several_u")), "u")
    with_both = with_u.join(bits.select(F.col("doc_id").alias("v"), F.col("bits").alias("y"), F.col("several").alias("several_v")), "v")
    several = (F.col("several_u") | F.col("several_v")).alias("several")
    return with_both.select("u", "v", "x", "y", several).mapInArrow(alike, "u long, v long")


def representatives(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents of which no smaller one of their group exists, with all their columns; of rows that
    repeat a doc_id, all stay or go."""
    gone = near_duplicates(docs, settings).where("not kept").select(F.col("doc_id").alias("_gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone_id"], "left_anti")
