import hashlib
import random

import pytest

from pulse.llm import substrings


def brute(rows, size):
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        if i is not None:
            for k in range(len(w) - size + 1):
                g = tuple(w[k : k + size])
                first[g] = min(first.get(g, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone |= set(range(k, k + size))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


def passages(seed, n=120):
    rnd = random.Random(seed)
    common = [[f"p{p}w{rnd.randrange(40)}" for _ in range(rnd.randint(3, 40))] for p in range(6)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rnd.randint(0, 6)):
            text += rnd.choice(common) if rnd.random() < 0.5 else [f"own{rnd.randrange(10**6)}" for _ in range(rnd.randint(0, 20))]
        rows.append((rnd.randrange(100) if i % 9 == 0 else 100 + i, rnd.choice((" ", "\n", " \t ")).join(text)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("window", [13, 5])
def test_equal_to_brute_force(documents, window, odd_rows):
    rows = passages(window) + odd_rows + [(11, odd_rows[10][1]), (12, "x " * 40), (13, "x " * 30), (14, "x " * 13)]
    found = substrings.deduplicated(documents(rows).repartition(5), substrings.Settings(window=window))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows, window)


def test_a_full_sketch_loses_nothing(documents):
    """With few cells nearly all windows are let through, and with small stripes the sketch is many files."""
    rows = passages(3)
    settings = substrings.Settings(least_cells=512, most_cells=512, stripe=64)
    found = substrings.deduplicated(documents(rows), settings)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows, 13)


def test_empty_table(documents):
    assert substrings.deduplicated(documents([])).count() == 0
