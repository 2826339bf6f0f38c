"""Personal data (6): candidate spans, boosted trees over their format and context, calibrated thresholds.

Fixed patterns give the base spans, which always stay. Looser generators propose further, overlapping spans:
addresses with "at" and "dot" spelled out, numbers with other separators or without a country code. Boosted
trees (Spark ML) judge each by what it looks like and what stands around it; per kind the lowest probability
at which a held-out part of the training rows reaches the asked precision selects. Of overlapping spans
the likelier stays, and none that touches a base span of its kind.

No labels of personal data exist, so the trees learn from what can be known: base spans, written as the generators
would meet them (true), and the same with a digit changed so that the checks of their kind fail, too few or
many parts, or candidates of the documents that a check refutes (false). A candidate that no check decides is
just what the trees are asked about, so it is no example. The examples are made of all spans of the whole corpus, in a pass
of its own from which only spans with a few words around them come back; kinds weigh the same, so that a rare one is learned too.
Equal examples are one row with a weight, and the thresholds are taken from counts by probability in steps of ``1 / GRID``,
over all held-out rows. A second pass without a shuffle then judges all candidates.

Defined cases: a missing text is empty and has no spans. Very long texts are read whole, and every pattern
is linear in their length. Of equally likely overlapping spans the earlier stays, then the longer. Repeated rows give
repeated rows. Empty tables give no rows, and a table without base spans trains nothing and adds nothing.
Other columns are passed by, or kept as they are by ``redacted``.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from pulse.llm.shared import kept
from pulse.llm.words import pieces, texts

KINDS = ("email", "ip", "card", "phone")


@dataclass(frozen=True)
class Settings:
    #: Different base spans, and as many refuted candidates, of each kind that the trees learn from, at most; None is all.
    spans: int | None = None
    trees: int = 15
    depth: int = 4
    #: Precision that a kind's threshold reaches on the held-out rows.
    precision: float = 0.99
    #: Held-out rows above a kind's own threshold, at least; with fewer those of all kinds count too, at this weight.
    support: int = 20


# Base patterns, written so that no text makes them try the same characters again and again: a run of digits
# is entered at its first digit only, and an address is found from its "@" to both sides.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    found, after = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append(("email", start, match.end()))
            after = match.end()
        at = text.find("@", max(at + 1, after))
    if _DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(octet, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(digits := only_digits(m[0])) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return found


# Generators: each is entered at a rare character or word, and its repeats are bounded.
_AT, _DOT = r"(?: ?[\[({<] ?(?:at|@) ?[\])}>] ?| (?:at|AT) |@)", r"(?: ?[\[({<] ?(?:dot|\.) ?[\])}>] ?| (?:dot|DOT) |\.)"
GENERATORS = (
    ("email", re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{2,63}}){{1,4}}")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?: ?[\[({] ?(?:\.|dot) ?[\])}] ?| ?\. ?| dot )[0-9]{1,3}){3}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9](?:[ ._/-]{0,2}[0-9]){12,18}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+.])(?:00|\+)?\(?[0-9]{1,4}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){2,5}(?![0-9])")),
)
_SPELLED = re.compile(r"@|[\[({<] ?(?:at|dot) ?[\])}>]| (?:dot|DOT) ")
CUES = {
    "email": ("mail", "contact", "write", "correo", "courriel", "schreib"),
    "ip": ("ip", "host", "server", "address", "addr", "from"),
    "card": ("card", "visa", "master", "amex", "credit", "tarjeta", "carte", "karte", "account"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "cell", "ruf", "llam", "appel"),
}


class Taken:
    """Disjoint spans in order; whether another one touches any is a look-up, whatever their number."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()):
        self._starts: list[int] = []
        self._ends: list[int] = []
        for start, end in sorted(spans):
            if self._ends and start < self._ends[-1]:
                self._ends[-1] = max(self._ends[-1], end)
            else:
                self._starts.append(start)
                self._ends.append(end)

    def touches(self, start: int, end: int) -> bool:
        before = bisect_left(self._starts, end)
        return before > 0 and self._ends[before - 1] > start

    def within(self, start: int, end: int) -> bool:
        """Whether the span lies in one of these; only for spans that did not touch each other."""
        before = bisect_right(self._starts, start)
        return before > 0 and self._ends[before - 1] >= end

    def add(self, start: int, end: int) -> None:
        """A span that touches none."""
        place = bisect_left(self._starts, start)
        self._starts.insert(place, start)
        self._ends.insert(place, end)


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the generators that touch no base span of their kind; they may overlap each other."""
    digits, spelled, found = _DIGIT.search(text), _SPELLED.search(text), []
    for kind, pattern in GENERATORS:
        if not (spelled if kind == "email" else digits):
            continue
        taken = Taken((s, e) for k, s, e in base if k == kind)
        for m in pattern.finditer(text):
            if not taken.touches(m.start(), m.end()):
                found.append((kind, m.start(), m.end()))
    return found


_DATE = re.compile(r"(?:[0-9]{1,2}([./-])[0-9]{1,2}\1(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}([./-])[0-9]{1,2}\2[0-9]{1,2})(?![0-9])")


def refuted(kind: str, span: str) -> bool:
    """Whether a check says that a candidate is none of its kind; most of the others are undecided."""
    groups = re.findall(r"[0-9]+", span)
    if kind == "email":
        # A top-level domain is no number, and names begin and end with neither dot nor hyphen.
        labels = re.split(rf"{_AT}|{_DOT}", span)
        return labels[-1].isdigit() or span[0] in ".-" or any(x[:1] == "-" or x[-1:] == "-" for x in labels[1:])
    if kind == "ip":
        return not all(map(octet, groups))
    if kind == "card":
        return not luhn("".join(groups))
    return not 7 <= sum(map(len, groups)) <= 15 or bool(_DATE.match(span))


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and what stands around it, as numbers."""
    span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 20]
    digits = only_digits(span)
    groups = re.findall(r"[0-9]+", span)
    labels = re.split(r"[^A-Za-z0-9-]+(?:(?:dot|DOT)[^A-Za-z0-9-]+)?", span)
    words = re.findall(r"\w+", before.lower())[-4:]
    cue = lambda names: float(any(w.startswith(n) for w in words for n in names))
    values = [
        len(span), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(13 <= len(digits) <= 19 and luhn(digits)),
        float(len(groups) == 4 and all(map(octet, groups))),
        float(span.startswith("+")), float(span.startswith("00")), float(9 <= len(digits) <= 15),
        span.count(" "), span.count("-"), span.count("."), sum(c in "()[]{}<>" for c in span),
        float(bool(re.search(r"[\[({<] ?(?:at|@) ?[\])}>]|@", span))),
        float(bool(re.search(r"[\[({<] ?dot ?[\])}>]", span))),
        len(labels[-1]), float(labels[-1].isalpha()),
        cue(CUES[kind]), cue([c for k in KINDS if k != kind for c in CUES[k]]),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(bool(re.match(r"[.,/-]?[0-9]", after))), float(bool(re.search(r"[0-9][.,/-]?$", before))),
    ]
    return [float(v) for v in values]


def _spelled(kind: str, span: str, rnd: random.Random) -> str:
    """A true span in a form that the base pattern does not take."""
    if kind == "email":
        local, _, domain = span.partition("@")
        at, dot = rnd.choice(((" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), (" at ", " dot ")))
        return local + at + domain.replace(".", dot)
    if kind == "ip":
        return span.replace(".", rnd.choice(("[.]", " . ", "(.)", "[dot]")))
    if kind == "card":
        digits, by = only_digits(span), rnd.choice((".", "/", "_", " - "))
        return by.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    digits, by = only_digits(span), rnd.choice(("-", " ", ".", "/"))
    area = f"({digits[-10:-7]})" if rnd.random() < 0.5 else digits[-10:-7]
    return rnd.choice(("", "00" + (digits[:-10] or "1") + by)) + by.join((area, digits[-7:-4], digits[-4:]))


def _spoiled(kind: str, span: str, rnd: random.Random) -> str:
    """A span that looks alike but is none: a check fails, or parts are missing."""
    if kind == "email":
        return rnd.choice((" at ", "@", " at the ")).join(rnd.sample(["room", "home", "he", "was", "10", "noon", "that"], 2)) + rnd.choice((" dot ", ".", "")) + rnd.choice(("a", "He", "30", "The"))
    parts = re.findall(r"[0-9]+", span)
    if kind == "ip":
        parts[rnd.randrange(len(parts))] = str(rnd.randint(256, 999))
        return rnd.choice((".", " . ", "[.]")).join(parts)
    digits = only_digits(span)
    if kind == "card":
        place = rnd.randrange(len(digits))
        digits = digits[:place] + str((int(digits[place]) + rnd.randint(1, 9)) % 10) + digits[place + 1 :]
        by = rnd.choice(("", ".", "/", " ", "-"))
        return by.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    return rnd.choice((f"{rnd.randint(1, 31):02d}.{rnd.randint(1, 12):02d}.{rnd.randint(1900, 2030)}", f"{digits[:2]} {digits[2:4]} {digits[4:6]}", f"{rnd.randint(1900, 2030)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}", f"{digits[:3]}/{digits[3:5]}/{digits[5:7]}"))


def _false(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates that a check refutes, or that lie in a base span of another kind."""
    # Base spans of one kind do not touch each other, those of two may.
    by_kind = [Taken((s, e) for k, s, e in base if k == kind) for kind in KINDS]
    return [
        (kind, start, end)
        for kind, start, end in candidates(text, base)
        if refuted(kind, text[start:end]) or any(taken.within(start, end) for taken in by_kind)
    ]


SPANS = "kind string, base boolean, h long, before string, span string, after string"
#: No generator takes a longer span.
LONGEST = 500
#: Steps of a probability in which held-out rows are counted.
GRID = 10_000
#: Spans that a task sends at once, and different examples that a task of the training takes, about.
_SENT, _TAUGHT = 4096, 1 << 17


def _spans(docs: DataFrame) -> DataFrame:
    """All base spans and refuted candidates, with what stands around them; equal spans in equal surroundings are one."""
    types = [pa.string(), pa.bool_(), pa.int64()] + [pa.string()] * 3
    names = [part.split()[0] for part in SPANS.split(", ")]

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for piece in pieces(batches):
            for text in texts(piece):
                base = base_spans(text)
                for known, spans in ((True, base), (False, _false(text, base))):
                    for kind, start, end in spans:
                        if end - start > LONGEST:
                            continue
                        row = (text[max(0, start - 60) : start], text[start:end], text[end : end + 40])
                        rows.append((kind, known, xxh3_64_intdigest("\0".join(row)) >> 1, *row))
                        if len(rows) >= _SENT:
                            yield sent(rows)
                            rows = []
        if rows:
            yield sent(rows)

    return docs.select("text").mapInArrow(scan, SPANS).dropDuplicates(["kind", "base", "h"])


def _sampled(docs: DataFrame, settings: Settings) -> DataFrame:
    """Of each kind the ``Settings.spans`` base spans and refuted candidates of the smallest hashes, where a caller wants no more."""
    most, found = settings.spans, kept(_spans(docs), "pii-spans")
    sorts = [(F.col("kind") == k) & (F.col("base") == known) for k in KINDS for known in (True, False)]
    # The largest of the smallest hashes of each sort: only these meet.
    last = [found.where(sort).select("h").orderBy("h").limit(most).agg(F.max("h").alias("h")) for sort in sorts]
    ends = [part.first()["h"] for part in last]
    return found.where(functools.reduce(lambda a, b: a | b, (s & (F.col("h") <= (-1 if end is None else end)) for s, end in zip(sorts, ends))))


def _examples(spans: DataFrame) -> DataFrame:
    """kind, label, features of training candidates out of the spans, and the span that they were made from, as a hash."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, known, h, before, span, after in zip(*(c.to_pylist() for c in batch.columns)):
                origin = xxh3_64_intdigest(span) >> 1
                if not known:
                    rows.append((kind, 0.0, features(before + span + after, kind, len(before), len(before) + len(span)), origin))
                    continue
                rnd = random.Random(h)
                for label, write in ((1.0, _spelled), (0.0, _spoiled)):
                    around = (before, write(kind, span, rnd), after)
                    for k, s, e in candidates("".join(around), base_spans("".join(around))):
                        # What the generators make of the written span; a part of it is no personal data.
                        if e <= len(before) or s >= len(before) + len(around[1]):
                            continue  # a neighbour, about which nothing is known
                        whole = s <= len(before) and e >= len(before) + len(around[1])
                        rows.append((k, label if whole and k == kind else 0.0, features("".join(around), k, s, e), origin))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.float64(), pa.list_(pa.float64()), pa.int64()))],
                    names=["kind", "label", "features", "origin"],
                )

    return spans.mapInArrow(build, "kind string, label double, features array<double>, origin long")


@dataclass(frozen=True)
class Model:
    """Trees as nested tuples (feature, threshold, left, right) with numbers as leaves, and a threshold per kind."""

    trees: tuple
    weights: tuple[float, ...]
    thresholds: dict[str, float]

    def probability(self, values: list[float]) -> float:
        margin = 0.0
        for tree, weight in zip(self.trees, self.weights):
            while isinstance(tree, tuple):
                tree = tree[2] if values[tree[0]] <= tree[1] else tree[3]
            margin += weight * tree
        return 1 / (1 + math.exp(-2 * margin))

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        scored = []
        for kind, start, end in candidates(text, base) if self.trees else ():
            p = self.probability([float(KINDS.index(kind)), *features(text, kind, start, end)])
            if p >= self.thresholds.get(kind, 2.0):
                scored.append((-p, start, start - end, kind))
        chosen: list[tuple[str, int, int]] = []
        taken = Taken((s, e) for _, s, e in base)
        for _, start, size, kind in sorted(scored):
            end = start - size
            if not taken.touches(start, end):
                chosen.append((kind, start, end))
                taken.add(start, end)
        return chosen


def _nested(node) -> tuple | float:
    """A node of a Spark ML tree, by its public accessors."""
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), _nested(node.leftChild()), _nested(node.rightChild())


def trained(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """The trees and thresholds, from the spans of all documents."""
    kinds = F.array(*(F.when(F.col("kind") == k, F.lit(float(i))) for i, k in enumerate(KINDS)))
    spans = _spans(docs) if settings.spans is None else _sampled(docs, settings)
    rows = _examples(spans).withColumn("features", F.concat(F.array_compact(kinds), "features"))
    # All that was written from one span is on one side, in whatever surroundings.
    held = F.pmod("origin", F.lit(4)) == 0
    rows = rows.withColumn("held", held).groupBy("kind", "label", "held", "features").agg(F.count("*").alias("n"))
    rows = kept(rows, "pii-examples")
    totals = rows.where("not held").groupBy("kind", "label").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()  # at most 8
    if len({t["label"] for t in totals}) < 2:
        return Model((), (), {})
    by_kind = {kind: sum(t["n"] for t in totals if t["kind"] == kind) for kind in {t["kind"] for t in totals}}
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in by_kind.items() for x in (k, max(by_kind.values()) / n))), F.col("kind"))
    vectors = rows.where("not held").select("label", (F.col("n") * share).alias("weight"), "features")
    tasks = max(4, -(-sum(t["rows"] for t in totals) // _TAUGHT))
    # In one order however the files lie, so that the trees are the same in every run.
    vectors = vectors.repartition(tasks, "features").sortWithinPartitions("features", "label", "weight")
    booster = GBTClassifier(
        labelCol="label", featuresCol="vector", weightCol="weight", maxIter=settings.trees, maxDepth=settings.depth, seed=1, maxBins=64
    )
    fitted = booster.fit(vectors.select("label", "weight", array_to_vector("features").alias("vector")))
    trees = tuple(_nested(t.rootNode()) for t in fitted._java_obj.trees())
    model = Model(trees, tuple(fitted.treeWeights), {})
    return Model(model.trees, model.weights, calibrated(_scores(rows.where("held"), model), settings))


def _scores(held: DataFrame, model: Model) -> list[tuple[str, float, float, int]]:
    """(kind, probability, label, rows) of the held-out rows, the probability rounded down to the grid: at most 8 * GRID of them."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = [math.floor(model.probability(values) * GRID) for values in batch.column("features").to_pylist()]
            own = [batch.column(name) for name in ("kind", "label", "n")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(steps, pa.int64())], names=["kind", "label", "n", "step"])

    scored = held.select("kind", "label", "n", "features").mapInArrow(score, "kind string, label double, n long, step long")
    counted = scored.groupBy("kind", "step", "label").agg(F.sum("n").alias("n")).collect()
    return [(r["kind"], r["step"] / GRID, r["label"], r["n"]) for r in counted]


#: Kind, probability, label, and how many rows have these: one, if it is not there.
Score = tuple[str, float, float] | tuple[str, float, float, int]


def thresholds(scores: list[Score], settings: Settings) -> dict[str, float]:
    """Per kind the lowest probability from which on the precision is reached, never under a half."""
    chosen = {}
    for kind in KINDS:
        right, n, ranked = 0, 0, sorted(((p, y, sum(rows) or 1) for k, p, y, *rows in scores if k == kind), reverse=True)
        for place, (p, y, rows) in enumerate(ranked):
            right, n = right + y * rows, n + rows
            last = place + 1 == len(ranked) or ranked[place + 1][0] < p
            if last and p >= 0.5 and n >= settings.support and right / n >= settings.precision:
                chosen[kind] = p
    return chosen


def calibrated(scores: list[Score], settings: Settings) -> dict[str, float]:
    """A threshold for every kind: its own, or with few held-out rows one for which the rows of all kinds stand in.

    They stand in with the weight of ``support`` rows, so each further row of the kind itself counts for more. A kind that
    never reaches the precision selects above its last wrong row, and where the probability itself says as much.
    """
    chosen = thresholds(scores, settings)
    ranked = sorted(((k, p, y, sum(rows) or 1) for k, p, y, *rows in scores), key=lambda x: -x[1])
    for kind in (k for k in KINDS if k not in chosen):
        wrong = max((p for k, p, y, _ in ranked if k == kind and not y), default=0.0)
        # The first step above all that was rounded down to the wrong row's.
        chosen[kind] = max(settings.precision, (round(wrong * GRID) + 1) / GRID)
        right, n, own_right, own_n = 0.0, 0, 0.0, 0
        for place, (k, p, y, rows) in enumerate(ranked):
            right, n = right + y * rows, n + rows
            own_right, own_n = own_right + y * rows * (k == kind), own_n + rows * (k == kind)
            last = place + 1 == len(ranked) or ranked[place + 1][1] < p
            if last and p >= 0.5 and own_right + settings.support * right / n >= settings.precision * (own_n + settings.support):
                chosen[kind] = p
    return chosen


def spelled_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def found(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per document the number of base spans of each kind, their hash, and all spans."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, settings))
    names = [part.split()[0] for part in FOUND.split(", ")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            rows = []
            for doc_id, text in zip(piece.column("doc_id").to_pylist(), texts(piece)):
                base = base_spans(text)
                added = model.value.added(text, base)
                kinds = [k for k, _, _ in base]
                rows.append(
                    (doc_id, *(kinds.count(k) for k in KINDS), hashlib.sha256(spelled_spans(base).encode()).hexdigest())
                    + (spelled_spans(base + added), len(added))
                )
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, FOUND)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the one that begins first names the kind."""
    out, after = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= after:
            out += [text[after:start], f"[{kind.upper()}]"]
        after = max(after, end)
    return "".join([*out, text[after:]])


def redacted(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents with personal data masked in ``text``; all other columns as they are."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, settings))
    place = docs.columns.index("text")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = []
            for text in batch.column(place).to_pylist():
                base = base_spans(text) if text else []
                spans = base + model.value.added(text, base) if text else []
                column.append(masked(text, spans) if spans else text)
            arrays = list(batch.columns)
            arrays[place] = pa.array(column, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return docs.mapInArrow(mask, docs.schema)
