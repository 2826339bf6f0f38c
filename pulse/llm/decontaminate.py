"""Benchmark decontamination (8): rare n-gram seeds, then Smith-Waterman alignment.

Words are compared in lower case and without ASCII punctuation; in scripts without spaces between words (Chinese,
Japanese, Thai, Lao, Khmer, Burmese) each character is a word. Every four words of a benchmark item are
a seed. A first pass over the corpus counts how often it has the words of the benchmark. A seed is rare if words drawn by these
counts would make it less often than a limit, so a passage that was copied into very many documents keeps its seeds,
while a run of everyday words makes none. The rarest quarter of an item's seeds always counts. A second pass looks
for rare seeds alone, cuts out the passages around them and aligns them with the item where they are, word by word; so a phrase that many
items and documents share makes no pairs of them, and no passage is written or sent anywhere. The score is the alignment's share of the best one possible.
A copy has half of that score, or, however long the item is, a part of ``part`` words (nearly) in a row. For the latter
the passage is aligned again with penalties under which only dense parts score, so sparse surroundings hide none.

The items are the query set: they are read in blocks of a bounded number of words, and each block is
held against all texts.

Items of fewer than ``least_words`` words are looked up in the second pass as whole word sequences, by a hash of their
length; such a copy has score 1.

Defined cases: a missing text has no words and no matches. Items without a word are not searched. Texts of any length are read whole. Repeated rows give their matches once per doc_id. Equal
items are reported each. Empty tables give no rows. A row without doc_id is reported with a null doc_id. Ties of two
alignments go to the earlier passage. Columns other than doc_id, text and item_id, text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.llm.words import pieces, texts, window_hashes, word_hashes


@dataclass(frozen=True)
class Settings:
    seed: int = 4
    #: Items of fewer words are found as exact copies only.
    least_words: int = 8
    #: A seed is rare if its words meet by chance less often than once in so many words.
    rarity: float = 1e7
    #: Least score of a copy, as a share of the score of the whole item.
    score: float = 0.5
    #: Least words of a verbatim part that is a copy by itself; each word changed in it costs four further ones.
    part: int = 20
    #: Words of benchmark items that one pass looks for.
    block_words: int = 2_000_000


MATCH, MISS, GAP = 2, -1, -1
#: For parts: a word is worth 1, a change 3, so a part with a share of under 3/4 equal words has no score.
DENSE = (1, -3, -3)
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_CLEAN = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))


_THAI_LAO_BURMESE_KHMER = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
_EAST = "\u3005-\u3007\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_UNSPACED = re.compile(f"[{_THAI_LAO_BURMESE_KHMER}{_EAST}]")
#: Their punctuation, and full-width ASCII punctuation.
_EAST_PUNCTUATION = re.compile("[\u3000-\u3004\u3008-\u3020\u3030\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


def normal_words(text: str) -> list[bytes]:
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \g<0> ", _EAST_PUNCTUATION.sub(" ", text))
    return text.lower().encode().translate(_CLEAN).split()


class Items:
    """A block of benchmark items, with the places of all their seeds ordered by seed."""

    def __init__(self, rows: list[tuple[object, str]], settings: Settings):
        cut = [(i, w) for i, t in rows if (w := normal_words(t or ""))]
        least = max(settings.least_words, settings.seed)
        kept_rows, short = [r for r in cut if len(r[1]) >= least], [r for r in cut if len(r[1]) < least]
        self.ids = [i for i, _ in kept_rows + short]
        #: By length, the hash of each short item and the places of the items that have it.
        self.short: dict[int, dict[int, list[int]]] = {}
        for place, (_, w) in enumerate(short, len(kept_rows)):
            whole = int(window_hashes(word_hashes(w), len(w))[0])
            self.short.setdefault(len(w), {}).setdefault(whole, []).append(place)
        self.short_hashes = {n: np.array(sorted(of), np.uint64) for n, of in self.short.items()}
        self.words = [word_hashes(w) for _, w in kept_rows]
        grams = [window_hashes(w, settings.seed) for w in self.words]
        sizes = [len(g) for g in grams]
        seed = np.concatenate([*grams, np.empty(0, np.uint64)])
        order = np.argsort(seed, kind="stable")
        self.place_item = np.repeat(np.arange(len(grams)), sizes)[order]
        self.place_at = np.concatenate([np.arange(n) for n in sizes] or [np.empty(0, int)]).astype(np.int64)[order]
        self.seeds, self.first, self.count = np.unique(seed[order], return_index=True, return_counts=True)
        self.vocabulary = np.unique(np.concatenate([*self.words, np.empty(0, np.uint64)]))
        self._hint()

    def _hint(self) -> None:
        #: Whether any seed has these top bits: spares most look-ups.
        self.hint = np.zeros(1 << 20, bool)
        self.hint[self.seeds >> np.uint64(44)] = True

    def only(self, wanted: np.ndarray) -> Items:
        """The same items with the wanted ones of their seeds."""
        few = copy(self)
        places = np.repeat(wanted, self.count)
        few.place_item, few.place_at = self.place_item[places], self.place_at[places]
        few.seeds, few.count = self.seeds[wanted], self.count[wanted]
        few.first = np.cumsum(few.count) - few.count
        few._hint()
        return few

    def rare(self, counts: np.ndarray, total: int, settings: Settings) -> np.ndarray:
        """For each seed whether it is rare, given how often the corpus has each word of the vocabulary."""
        logs = np.log(np.maximum(counts, 1) / max(total, 1))
        chance = np.full(len(self.seeds), -np.inf)
        per_item = []
        for words in self.words:
            of_word = logs[np.searchsorted(self.vocabulary, words)]
            gram = np.convolve(of_word, np.ones(settings.seed), "valid")
            which = np.searchsorted(self.seeds, window_hashes(words, settings.seed))
            chance[which] = gram
            per_item.append((which, gram))
        rare = chance <= -np.log(settings.rarity)
        for which, gram in per_item:
            rare[which[np.argsort(gram, kind="stable")[: max(1, len(gram) // 4)]]] = True
        return rare


def short_copies(words: np.ndarray, items: Items) -> list[tuple[int, int, int]]:
    """(item, first word, words) of the first copy of each short item in a text."""
    found = []
    for n, hashes in items.short_hashes.items():
        grams = window_hashes(words, n)
        place = np.minimum(np.searchsorted(hashes, grams), len(hashes) - 1)
        at = np.flatnonzero(hashes[place] == grams)
        for k, first in zip(*np.unique(grams[at], return_index=True)):
            found += [(item, int(at[first]), n) for item in items.short[n][int(k)]]
    return found


def passages(words: np.ndarray, items: Items, settings: Settings) -> list[tuple[int, int, np.ndarray]]:
    """(item, first word, words) of each passage of a text that holds seeds of an item."""
    grams = window_hashes(words, settings.seed)
    likely = np.flatnonzero(items.hint[grams >> np.uint64(44)])
    if not len(likely) or not len(items.seeds):
        return []
    place = np.searchsorted(items.seeds, grams[likely])
    place[place == len(items.seeds)] = 0
    hit = items.seeds[place] == grams[likely]
    at, seed = likely[hit], place[hit]
    if not len(at):
        return []
    # One row for each place of the seed in an item.
    times = items.count[seed]
    row = np.repeat(np.arange(len(at)), times)
    where = np.repeat(items.first[seed] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    item, offset = items.place_item[where], items.place_at[where]
    order = np.lexsort((at[row], item))
    item, offset, at = item[order], offset[order], at[row][order]
    lengths = np.array([len(items.words[i]) for i in item])
    cut = np.flatnonzero((item[1:] != item[:-1]) | (at[1:] - at[:-1] > lengths[1:])) + 1
    found = []
    for start, stop in zip([0, *cut], [*cut, len(at)]):
        slack = int(lengths[start]) // 4 + 2
        low = max(0, int((at - offset)[start:stop].min()) - slack)
        high = min(len(words), int((at - offset)[start:stop].max()) + int(lengths[start]) + slack)
        found.append((int(item[start]), low, words[low:high]))
    return found


def align(items: list[np.ndarray], passage: list[np.ndarray], values: tuple[int, int, int] = (MATCH, MISS, GAP)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, first word, word after the last) of the best local alignment of each pair, by Smith-Waterman.

    A cell holds its score in its upper bits and, in as many lower ones as the longest passage needs, where its alignment began; so
    the larger of two cells is that with the better score. All pairs go through the table's rows together.
    """
    match, miss, gap = values
    n, width, height = len(items), max(map(len, passage)), max(map(len, items))
    text, rows = np.zeros((n, width), np.uint64), np.ones((n, height), np.uint64)
    for k in range(n):
        text[k, : len(passage[k])], rows[k, : len(items[k])] = passage[k], items[k]
    bits = int(width + 1).bit_length()
    one = np.int64(1 << bits)
    begin = np.arange(width + 1, dtype=np.int64)
    ramp = begin * -gap * one
    before = np.tile(begin, (n, 1))
    best, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(height):
        now = np.empty_like(before)
        now[:, 0] = 0
        equal = text == rows[:, i, None]
        now[:, 1:] = np.maximum(before[:, :-1] + np.where(equal, match, miss) * one, before[:, 1:] + gap * one)
        np.maximum(now, begin, out=now)
        now = np.maximum.accumulate(now + ramp, axis=1) - ramp
        place = (now >> bits).argmax(axis=1)
        value = now[np.arange(n), place]
        better = (value >> bits) > (best >> bits)
        best, end = np.where(better, value, best), np.where(better, place, end)
        before = now
    return best >> bits, best & (one - 1), end


COUNTS = "word long, n long"
MATCHES = "doc_id long, item int, score double, start long, stop long"
_MATCH_TYPES = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]


def _counted(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """How often the corpus has each word of the vocabulary, and its words in all. Each task sends one number for each word it met."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = sent.value, 0
        seen = np.zeros(len(known), np.int64)
        for piece in pieces(batches):
            for text in texts(piece):
                words = word_hashes(normal_words(text))
                total += len(words)
                place = np.minimum(np.searchsorted(known, words), len(known) - 1)
                seen += np.bincount(place[known[place] == words], minlength=len(known))
        met = np.flatnonzero(seen)
        # The words of a text in all are no word's: place -1.
        yield pa.RecordBatch.from_arrays([pa.array([*met.tolist(), -1], pa.int64()), pa.array([*seen[met].tolist(), total], pa.int64())], names=["word", "n"])

    sums = docs.select("text").mapInArrow(count, COUNTS).groupBy("word").agg(F.sum("n").alias("n")).toArrow()  # the block's words
    place, n = (sums.column(c).to_numpy() for c in ("word", "n"))
    counts = np.zeros(len(vocabulary), np.int64)
    counts[place[place >= 0]] = n[place >= 0]
    return counts, int(n[place < 0].sum())


def scored(pairs: list[tuple[object, int, int, np.ndarray]], items: Items, settings: Settings) -> list[tuple[object, int, float, int, int]]:
    """(doc_id, item, score, start, stop) of those of the pairs (doc_id, item, first word, passage) that are copies."""
    pairs, found = sorted(pairs, key=lambda r: len(r[3])), []
    while pairs:
        # As many pairs at a time as make a table of a million cells.
        taken = max(1, min(len(pairs), 1_000_000 // len(pairs[-1][3])))
        pairs, some = pairs[:-taken], pairs[-taken:]
        best, first, last = align([items.words[r[1]] for r in some], [r[3] for r in some])
        share = best / np.array([MATCH * len(items.words[r[1]]) for r in some])
        start = np.array([r[2] for r in some], np.int64)
        # A dense part of so many words has at least this score: each three words pay for one change.
        maybe = np.flatnonzero((share < settings.score) & (3 * best >= 5 * settings.part))
        whole = share >= settings.score
        if len(maybe):
            dense, low, high = align([items.words[some[k][1]] for k in maybe], [some[k][3] for k in maybe], DENSE)
            enough = maybe[dense >= settings.part]
            first[enough], last[enough], whole[enough] = low[dense >= settings.part], high[dense >= settings.part], True
        found += [(*some[k][:2], float(share[k]), int(start[k] + first[k]), int(start[k] + last[k])) for k in np.flatnonzero(whole)]
    return found


def _found(docs: DataFrame, items: Items, settings: Settings) -> DataFrame:
    """Every passage with one of the items' seeds that is a copy, and all copies of short items."""
    block = docs.sparkSession.sparkContext.broadcast(items)
    names = [part.split()[0] for part in MATCHES.split(", ")]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = block.value
        for piece in pieces(batches):
            found, waiting, size = [], [], 0
            for doc_id, text in zip(piece.column("doc_id").to_pylist(), texts(piece)):
                words = word_hashes(normal_words(text))
                for item, start, part in passages(words, items, settings):
                    # A copy, as a slice would keep the words of the whole text.
                    waiting.append((doc_id, item, start, part.copy()))
                    size += len(part)
                    if size >= 4_000_000:
                        found += scored(waiting, items, settings)
                        waiting, size = [], 0
                found += [(doc_id, item, 1.0, start, start + n) for item, start, n in short_copies(words, items)]
            found += scored(waiting, items, settings)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), _MATCH_TYPES)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, MATCHES)


def _blocks(benchmark: DataFrame, settings: Settings) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of a bounded number of words; one block at a time is in the driver."""
    block, words = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        block.append((row[0], row[1]))
        words += len(row[1] or "") // 2
        if words >= settings.block_words:
            yield block
            block, words = [], 0
    yield block


def matches(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, item_id, score (0 to 1), start and stop (words of the normalised text) of the best copy of each
    benchmark item in each document, where there is one."""
    spark, parts = docs.sparkSession, []
    kind = benchmark.schema["item_id"].dataType.simpleString()
    for rows in _blocks(benchmark, settings):
        items = Items(rows, settings)
        if not items.ids:
            continue
        if len(items.vocabulary):
            counts, total = _counted(docs, items.vocabulary)
            items = items.only(items.rare(counts, total, settings))
        best = _found(docs, items, settings).groupBy("doc_id", "item").agg(
            F.max_by(F.struct("score", "start", "stop"), F.struct("score", -F.col("start"))).alias("best")
        )
        names = spark.createDataFrame(list(enumerate(items.ids)), f"item int, item_id {kind}")
        parts.append(best.join(names, "item").select("doc_id", "item_id", "best.*"))
    if not parts:
        return spark.createDataFrame([], f"doc_id long, item_id {kind}, score double, start long, stop long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents that hold no copy of an item, with all their columns.

    Rows are told apart by a hash of doc_id and text, which no row lacks: a row without doc_id is judged as any other, and of
    rows that repeat a doc_id only those with a copy go.
    """
    key = F.xxhash64("doc_id", "text")
    copies = matches(docs.select(key.alias("doc_id"), "text"), benchmark, settings).select(F.col("doc_id").alias("_copy_key")).distinct()
    return docs.withColumn("_row_key", key).join(copies, F.col("_row_key") == F.col("_copy_key"), "left_anti").drop("_row_key")
