import random

import numpy as np

from pulse.llm import minhash
from pulse.llm.components import components


def brute(rows, size, percent=80):
    """(doc_id, n_shingles, component, kept) by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b in range(a):
            j, both = rows[b][0], len(sets[a] & sets[b])
            if None not in (i, j) and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted(
        ((i, len(s), None if i is None else root(i), i is None or root(i) == i) for (i, _), s in zip(rows, sets)), key=str
    )


def found(docs, **settings):
    rows = minhash.near_duplicates(docs, minhash.Settings(**settings)).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows), key=str)


def near_copies(rnd, base, count, edits):
    made = []
    for _ in range(count):
        words = list(base)
        for _ in range(rnd.randint(0, edits)):
            words[rnd.randrange(len(words))] = f"edit{rnd.randrange(10**6)}"
        made.append(" ".join(words))
    return made


def test_groups_of_near_copies_equal_brute_force(documents):
    rnd = random.Random(5)
    texts = []
    for group in range(6):
        base = [f"g{group}w{rnd.randrange(500)}" for _ in range(rnd.choice((8, 40, 150)))]
        texts += near_copies(rnd, base, 25, 6)
    common = " ".join(f"c{k}" for k in range(60))  # a passage that many documents share
    texts += [common + " " + " ".join(f"own{rnd.randrange(10**6)}" for _ in range(rnd.randint(5, 90))) for _ in range(60)]
    texts += ["A b C", "a B c", "a", "A"]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    assert found(documents(rows), shingle=4) == brute(rows, 4)
    assert found(documents(rows)) == brute(rows, 5)


def test_odd_rows(odd, odd_rows, documents):
    assert found(odd, shingle=4) == brute(odd_rows, 4)
    assert found(documents([])) == []


def test_large_group_in_small_blocks(documents, monkeypatch):
    monkeypatch.setattr(minhash, "OUTER", 4)
    monkeypatch.setattr(minhash, "INNER", 8)
    rnd = random.Random(9)
    rows = list(enumerate(near_copies(rnd, [f"w{k}" for k in range(120)], 120, 9)))
    assert found(documents(rows), shingle=4) == brute(rows, 4)


def test_estimate_is_corrected_for_chance():
    rnd = np.random.default_rng(1)
    settings = minhash.Settings()
    for share in (0.2, 0.5, 0.8, 0.95):
        guesses = []
        for _ in range(60):
            n = 400
            same = int(2 * n * share / (1 + share))
            core = rnd.integers(0, 2**63, same, dtype=np.uint64)
            sets = [np.concatenate([core, rnd.integers(0, 2**63, n - same, dtype=np.uint64)]) for _ in range(2)]
            bits = minhash.signatures(sets, settings)[1].view(np.uint64)
            guesses.append(minhash.estimated(minhash.unequal(bits[:1], bits[1:]), settings.places)[0])
        assert abs(np.mean(guesses) - share) < 0.02


def test_representatives_keep_all_columns(documents, odd):
    docs = documents([(i, "one two three four five six seven " * 3) for i in (7, 3, 9)]).unionAll(odd.where("doc_id is null or doc_id > 9"))
    left = minhash.representatives(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == [10, 3, None]


def test_components(frame, rows):
    links = frame([(5, 4), (4, 3), (9, 8), (3, 1), (7, 7), (1, 5), (8, 9), (None, 2)], "u long, v long")
    assert rows(components(links)) == [(1, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8)]
    chain = frame([(k, k + 1) for k in range(300)], "u long, v long")
    assert rows(components(chain)) == [(k, 0) for k in range(301)]
    star = frame([(1000, k) for k in range(300)], "u long, v long")
    assert {c for _, c in rows(components(star))} == {0}
    assert rows(components(frame([], "u long, v long"))) == []


def test_repeated_doc_ids_of_different_texts_keep_their_links(documents):
    rnd = random.Random(12)
    text = lambda: [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    rows = []
    for k in range(0, 48, 2):
        one, two = text(), text()
        near = [*one[:-3], "x", "y", "z"]
        rows += [(k, " ".join(one)), (k, " ".join(two)), (k + 1, " ".join(near))]
    found = minhash.near_duplicates(documents(rows)).collect()
    assert {r.doc_id: r.component_id for r in found if r.doc_id % 2} == {k + 1: k for k in range(0, 48, 2)}
