"""Language ID (4): scripts narrow the candidates, Viterbi over words labels the spans of mixed texts.

Learned from texts with a language: how often each language has each run of three letters (a word's ends count as
letters), and which scripts it is written in. A word's score for a language is the sum of the logs of these
shares; a language that does not use the word's script is no candidate. Over the words of a text Viterbi finds the
labels with the best sum of scores, less a penalty for every switch, so that a single word never makes a span. The
text's language is that of most letters; its score is their share times how clearly the words tell it.

Training reads a sample of bounded size per language (``Settings.sample``). The trained tables have a fixed size for
each language, whatever the corpus.

Defined cases: a missing text, or one without letters, is ``und`` with score 0, as are all if nothing was
learned. Very long texts are labelled whole. Of languages with equally many letters the first by name is taken,
and a tie of scores stays in the language before. Repeated rows get the same labels. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.llm.shared import kept
from pulse.llm.words import mixed, pieces, texts

#: Scripts that candidates are narrowed by; letters of any other are one more class.
SCRIPTS = (
    "Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Bengali", "Thai", "Hangul", "Hiragana", "Katakana", "Han",
    "Armenian", "Georgian", "Tamil", "Telugu", "Ethiopic", "Khmer",
)
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    #: Training texts for each language, at most about so many.
    sample: int = 1500
    #: Cells of the table of letter runs.
    cells: int = 1 << 18
    #: What a switch of the language costs, in logs.
    penalty: float = 12.0
    #: Least share of a language's letters in a script that makes it a candidate there.
    script_share: float = 0.01
    smoothing: float = 0.5


def script_table() -> np.ndarray:
    """Class of every code point: 0 no letter, then the scripts, then other letters."""
    every = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
    classes = np.zeros(0x110000, np.uint8)
    for number, pattern in [(len(SCRIPTS) + 1, r"[\p{L}\p{M}]+"), *((k + 1, rf"[[\p{{L}}\p{{M}}]&&\p{{Script={s}}}]+") for k, s in enumerate(SCRIPTS))]:
        for m in regex.finditer(pattern, every, flags=regex.V1):
            first, last = ord(every[m.start()]), ord(every[m.end() - 1])
            classes[first : last + 1] = number
    classes[0xD800:0xE000] = 0
    return classes


class Words:
    """Words of some texts, as places in one array of lower-case code points with a blank between texts."""

    def __init__(self, some: list[str], classes: np.ndarray, cells: int):
        joined = ("\n" + "\n".join(some) + "\n").lower() if some else "\n\n"
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        kind = classes[points]
        letter = kind > 0
        inside = np.where(letter, points, np.uint32(32)).astype(np.uint64)
        # The run of three around each letter.
        run = (inside[:-2] << np.uint64(42)) | (inside[1:-1] << np.uint64(21)) | inside[2:]
        at = np.flatnonzero(letter[1:-1])
        self.cell = (mixed(run[at]) % np.uint64(cells)).astype(np.int64)
        start = letter[1:-1] & ~letter[:-2]
        self.starts = np.flatnonzero(start[at])  # of the words, among the letters
        self.letters = np.diff(np.append(self.starts, len(at)))
        self.script = kind[1:-1][at][self.starts] if len(at) else np.empty(0, np.uint8)
        # Text of each word: by the blanks, which are no letters; lower case may make a text longer.
        line = np.cumsum(points[1:-1] == 10)
        self.line = line[at][self.starts]
        self.point = at[self.starts]


def lines(text: str) -> str:
    return text.replace("\n", " ")


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: Logs of the shares: cell by language.
    logs: np.ndarray
    #: Whether a language is a candidate in a script: script by language.
    allowed: np.ndarray
    classes: np.ndarray
    settings: Settings

    def spans(self, some: list[str]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
        """(words, first word of each text, number of words of each text, label of each word)."""
        words = Words([lines(t) for t in some], self.classes, self.settings.cells)
        counts = np.bincount(words.line, minlength=len(some))[: len(some)]
        firsts = np.cumsum(counts) - counts
        return words, firsts, counts, viterbi(self.scores(words), firsts, counts, self.settings.penalty)

    def scores(self, words: Words) -> np.ndarray:
        """Log of each word's share for each language; a language that is no candidate has none of it."""
        if not len(words.starts):
            return np.empty((0, len(self.languages)), np.float32)
        total = np.add.reduceat(self.logs[words.cell], words.starts, axis=0)
        allowed = self.allowed[words.script]
        none = ~allowed.any(axis=1)
        return np.where(allowed | none[:, None], np.where(none[:, None], 0, total), np.float32(-1e6))


def viterbi(scores: np.ndarray, firsts: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word; all texts go forward together, the longest first in the arrays."""
    label = np.zeros(len(scores), np.int64)
    order = np.argsort(-counts, kind="stable")
    firsts, counts = firsts[order], counts[order]
    alive = int((counts > 0).sum())
    if not alive:
        return label
    steps = int(counts[0])
    # Texts that have a word at each step.
    at_step = alive - np.searchsorted(np.sort(counts[:alive]), np.arange(steps), "right")
    came = np.empty(scores.shape, np.uint8 if scores.shape[1] < 256 else np.uint16)
    best = scores[firsts[:alive]].astype(np.float64)
    own = np.arange(scores.shape[1])
    for step in range(1, steps):
        n = at_step[step]
        before = best[:n]
        top = before.argmax(axis=1)
        switched = before[np.arange(n), top] - penalty
        stay = before >= switched[:, None]
        rows = firsts[:n] + step
        came[rows] = np.where(stay, own, top[:, None])
        best[:n] = np.where(stay, before, switched[:, None]) + scores[rows]
    last = best[:alive].argmax(axis=1)
    for step in range(steps - 1, -1, -1):
        n = at_step[step]
        rows = firsts[:n] + step
        label[rows] = last[:n]
        if step:
            last[:n] = came[rows, last[:n]]
    return label


def trained(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """The model from rows of text and lang; both are needed, other rows are passed over.

    The texts of a language with the smallest hashes are the sample, about as many as asked for and the same ones
    in every run; no text is shuffled for it.
    """
    spark, classes, cells = labelled.sparkSession, script_table(), settings.cells
    # Copies of a text are told apart by their doc_id, or one text might fill the sample.
    own = ["doc_id"] if "doc_id" in labelled.columns else []
    rows = labelled.select("lang", "text", *own).where("lang is not null and text is not null")
    # One row a language; the model has a column for each, so there are never many.
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    taken = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, settings.sample / n))) if sizes else F.lit(None)
    place = F.pmod(F.xxhash64("text", *own), F.lit(1_000_000_007)) / 1_000_000_007
    sample = kept(rows.where(place < F.element_at(taken, F.col("lang"))) if sizes else rows.limit(0), "language-sample").select("lang", "text")
    sent = spark.sparkContext.broadcast(classes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, scripts = {}, {}
        for piece in pieces(batches):
            lang = np.array(piece.column("lang").to_pylist(), object)
            some = texts(piece)
            for name in set(lang.tolist()):
                words = Words([lines(t) for t, x in zip(some, lang) if x == name], sent.value, cells)
                runs[name] = runs.get(name, 0) + np.bincount(words.cell, minlength=cells)
                letters = np.bincount(words.script, words.letters, minlength=len(SCRIPTS) + 2)
                scripts[name] = scripts.get(name, 0) + letters
        for name in runs:
            used = np.flatnonzero(runs[name])
            cell = np.concatenate([used, np.arange(len(SCRIPTS) + 2)])
            n = np.concatenate([runs[name][used], scripts[name].astype(np.int64)])
            script = np.arange(len(cell)) >= len(used)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(cell), pa.string()), pa.array(script), pa.array(cell, pa.int64()), pa.array(n, pa.int64())],
                names=["lang", "script", "cell", "n"],
            )

    counts = sample.mapInArrow(count, "lang string, script boolean, cell long, n long")
    # At most a row for each language and cell of the table.
    table = counts.groupBy("lang", "script", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(table["lang"].unique()))
    runs = np.full((cells, len(languages)), settings.smoothing)
    letters = np.zeros((len(SCRIPTS) + 2, len(languages)))
    number = table["lang"].map({x: k for k, x in enumerate(languages)}).to_numpy(int)
    cell, n, script = table["cell"].to_numpy(int), table["n"].to_numpy(float), table["script"].to_numpy(bool)
    runs[cell[~script], number[~script]] += n[~script]
    letters[cell[script], number[script]] += n[script]
    # Unseen runs weigh the same in every language: a share of all letters that were seen of it.
    logs = np.log(runs / runs.sum(axis=0)).astype(np.float32) if languages else np.empty((cells, 0), np.float32)
    allowed = letters >= settings.script_share * np.maximum(letters.sum(axis=0), 1)
    return Model(languages, logs, allowed, classes, settings)


PREDICTED = "doc_id long, lang_pred string, score double, spans array<struct<lang:string,first_word:long,words:long>>"


def predicted(docs: DataFrame, model: Model, with_spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score and the spans (runs of words of one language) of every text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("words", pa.int64())]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        k = len(model.languages)
        for piece in pieces(batches):
            some = texts(piece)
            n = len(some)
            lang, score, spans = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
            if k:
                words, firsts, counts, label = model.spans(some)
                line = words.line
                shares = np.bincount(line * k + label, words.letters, minlength=n * k)[: n * k].reshape(n, k)
                best, total = shares.argmax(axis=1), shares.sum(axis=1)
                # How clearly: the margin of the words' own scores a letter over the second language.
                scores = model.scores(words)
                sums = np.zeros((n, k))
                np.add.at(sums, line, np.maximum(scores, -1e3))
                margin = np.sort(sums, axis=1)
                gap = (margin[:, -1] - margin[:, -2]) / np.maximum(total, 1) if k > 1 else np.ones(n)
                known = total > 0
                score = np.where(known, shares.max(axis=1) / np.maximum(total, 1) * (1 - np.exp(-5 * np.maximum(gap, 0))), 0.0)
                lang = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, known)]
                if with_spans:
                    cuts = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (line[1:] != line[:-1])])) if len(label) else []
                    for a, b in zip(cuts, [*cuts[1:], len(label)]):
                        spans[line[a]].append((model.languages[label[a]], a - firsts[line[a]], b - a))
            rows = [[{"lang": x, "first_word": int(a), "words": int(b)} for x, a, b in s] for s in spans]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rows, span)],
                names=["doc_id", "lang_pred", "score", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predict, PREDICTED)


def held_out() -> F.Column:
    """Whether a document is none to learn from: by its doc_id alone."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def identified(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans of every document; learned from those that are not held out."""
    model = trained(docs.where(~held_out()), settings)
    return predicted(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "spans")
