import math
import re
from collections import Counter

import numpy as np
import pytest

from pulse.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def by_brute_force(docs, items, best=20):
    counts = [(doc_id, Counter(split(text))) for doc_id, text in docs]
    counts = [(doc_id, c) for doc_id, c in counts if c]
    n_docs, n_words = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    found = []
    for item_id, text in items:
        scores = []
        for doc_id, c in counts:
            m = 75 + 25 * c.total() * n_docs // n_words
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in split(text)
            )
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        found += [(item_id, rank, doc_id, -minus) for rank, (minus, _, doc_id) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:best], 1)]
    return found


def searched(spark, docs, items, settings=ranked.Settings()):
    index = ranked.indexed(docs, settings)
    got = ranked.search(index, spark.createDataFrame(items, "item_id long, text string, doc_id string, score string"), settings)
    return sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()))


def test_terms_are_those_of_the_pattern():
    for text in ("Aé-B c_d\x00e\x7ff\n9É", "", "—É İ ſ K", "x" * 1000, "a\xa0b c"):
        assert [t.decode() for t in ranked.terms(text.encode())] == split(text)


def test_bounds_are_never_below_scores():
    rng = np.random.default_rng(3)
    names = [b"w%d" % k for k in range(300)]
    for wide in (64, 128):
        counts = [Counter(rng.choice(300, 200).tolist()) for _ in range(20)]
        counts[0][7] = 5000
        lengths = np.array([100 + c.total() for c in counts])
        sketches = np.zeros((20, wide), np.uint8)
        for row, c in zip(sketches, counts):
            for place in ranked.coordinates(ranked.hashes([names[k] for k in c]), wide):
                np.maximum.at(row, place, np.minimum(list(c.values()), 255).astype(np.uint8))
        query = ranked.Weighted(names[:40], list(range(1, 41)), ranked.hashes(names[:40]))
        most = ranked.upper_bounds(ranked.impacts(sketches, lengths), query)
        for bound, c, length in zip(most, counts, lengths.tolist()):
            assert bound >= ranked.score(query, {names[k]: n for k, n in c.items()}, length)


ITEMS = [
    (0, "one two", "", ""),
    (1, None, "", ""),
    (2, "", "", ""),
    (3, "word7 word7 word529 the same row", "", ""),
    (3, "x é", "", ""),
    (None, "text without absent", "", ""),
]


def test_odd_rows(spark, odd, odd_rows):
    want = sorted(by_brute_force([(r[0], r[1]) for r in odd_rows], [i[:2] for i in ITEMS]), key=str)
    assert sorted(searched_any(spark, odd), key=str) == want


def searched_any(spark, docs):
    index = ranked.indexed(docs)
    got = ranked.search(index, spark.createDataFrame(ITEMS, "item_id long, text string, doc_id string, score string"))
    return list(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()))


@pytest.mark.parametrize("settings", [ranked.Settings(), ranked.Settings(best=3, width=1, least=2, block=10, cells=300, chunk=2)])
def test_equals_brute_force_with_ties_and_many_files(spark, settings):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 40))) for _ in range(150)]
    docs = [(k, texts[k % 120]) for k in range(400)]
    items = [(k, " ".join(rng.choice(words, 12)), "", "") for k in range(9)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(13)
    assert searched(spark, frame, items, settings) == sorted(by_brute_force(docs, [i[:2] for i in items], settings.best))


def test_empty_tables(spark, documents):
    none = documents([]).where("false")
    assert searched(spark, none, [(1, "a", "", "")]) == []
    assert searched(spark, documents([(1, None), (2, "...")]), [(1, "a", "", "")]) == []
    index = ranked.indexed(documents([(1, "a b")]))
    assert ranked.search(index, spark.createDataFrame([], "item_id long, text string")).collect() == []
