import random

import numpy as np

from pulse.llm import decontaminate
from pulse.llm.words import word_hashes


def plain_smith_waterman(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            step = decontaminate.MATCH if x == y else decontaminate.MISS
            table[i + 1][j + 1] = max(0, table[i][j] + step, table[i][j + 1] + decontaminate.GAP, table[i + 1][j] + decontaminate.GAP)
    return max(map(max, table))


def test_alignment_equals_the_plain_table():
    rnd = random.Random(1)
    pairs = []
    for _ in range(200):
        a = [rnd.choice("abcdef") for _ in range(rnd.randint(1, 25))]
        b = [x for x in a if rnd.random() < 0.8] + [rnd.choice("abcdef") for _ in range(rnd.randint(1, 12))]
        rnd.random() < 0.3 and rnd.shuffle(b)
        pairs.append((a, b))
    hashed = [[word_hashes([c.encode() for c in x]) for x in side] for side in zip(*pairs)]
    best, first, last = decontaminate.align(*hashed)
    assert best.tolist() == [plain_smith_waterman(a, b) for a, b in pairs]
    for (a, b), score, x, y in zip(pairs, best, first, last):
        assert plain_smith_waterman(a, b[x:y]) == score  # the span alone has the whole score


def item(rnd, n):
    return [f"{rnd.choice('bcdfgk')}{rnd.randrange(3000)}" for _ in range(n)]


def test_exact_edited_and_frequent_copies(spark, documents):
    rnd = random.Random(4)
    items = [item(rnd, n) for n in (12, 20, 40, 60)]
    fill = lambda n: item(rnd, n)
    edited = lambda w, share: [x if rnd.random() > share else f"zz{rnd.randrange(99)}" for x in w]
    docs, want = [], set()
    for k in range(60):
        n = k % 4
        how = k % 3
        copy = items[n] if how == 0 else edited(items[n], 0.12) if how == 1 else [x for i, x in enumerate(items[n]) if i % 11 != 5]
        text = " ".join(fill(rnd.randint(0, 60)) + copy + fill(rnd.randint(0, 60)))
        docs.append((k, text.upper() if k % 5 == 0 else text.replace(" ", ", ")))
        want.add((k, n))
    docs += [(1000 + k, " ".join(items[2] + fill(30))) for k in range(400)]  # one item in most documents
    want |= {(1000 + k, 2) for k in range(400)}
    docs += [(5000 + k, " ".join(fill(100) + items[3][5:12] + fill(50))) for k in range(40)]  # a short quote is no copy
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(items)], "item_id long, text string")
    found = decontaminate.matches(documents(docs), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert all(0.5 <= r.score <= 1 and r.start < r.stop for r in found)
    left = decontaminate.clean(documents(docs), benchmark)
    assert left.columns == documents(docs).columns and {r.doc_id for r in left.collect()} == {5000 + k for k in range(40)}


def test_odd_tables(spark, odd, documents, odd_rows):
    schema = "item_id long, text string"
    none = spark.createDataFrame([], schema)
    odd_items = spark.createDataFrame([(None, "the same row twice, with some more words in it so that it counts"), (1, None), (2, "")], schema)
    assert decontaminate.matches(odd, none).count() == 0 and decontaminate.clean(odd, none).count() == len(odd_rows)
    assert [(r.doc_id, r.item_id) for r in decontaminate.matches(odd, odd_items).collect()] == [(5, None)]
    assert decontaminate.matches(documents([]), odd_items).count() == 0


def test_blocks_of_items_give_the_same(spark, documents):
    rnd = random.Random(6)
    items = [item(rnd, 15) for _ in range(7)]
    docs = documents([(k, " ".join(item(rnd, 30) + items[k % 7])) for k in range(20)])
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(items)], "item_id long, text string")
    whole = decontaminate.matches(docs, benchmark).collect()
    parts = decontaminate.matches(docs, benchmark, decontaminate.Settings(block_words=30)).collect()
    assert sorted(whole) == sorted(parts) and len(whole) == 20


def test_seeds_of_common_words_are_not_rare():
    settings = decontaminate.Settings()
    words = b"of the and to of the and to a rare long tail word here".split()
    block = decontaminate.Items([(1, b" ".join(words).decode())], settings)
    seen = {int(h): (10**7 if w in (b"of", b"the", b"and", b"to") else 3) for w, h in zip(words, word_hashes(words).view(np.int64))}
    rare = block.rare(np.array([seen[w] for w in block.vocabulary.view(np.int64).tolist()]), 10**8, settings)
    common = np.searchsorted(block.seeds, decontaminate.window_hashes(word_hashes(words[:4]), 4))
    assert not rare[common].any() and rare.sum() >= 6


def test_parts_of_long_items(spark, documents):
    rnd = random.Random(9)
    long, other = item(rnd, 400), item(rnd, 59)
    few = lambda w: [x if k % 12 != 6 else f"zz{k}" for k, x in enumerate(w)]
    sparse = [x if k % 3 == 0 else f"yy{rnd.randrange(9999)}" for k, x in enumerate(long)]
    copies = [long[100:290], other[10:38], few(long[30:100]), long[200:225], sparse[:150] + long[150:190] + sparse[190:]]
    others = [long[50:62], sparse, other[3:12]]
    docs = documents([(k, " ".join(item(rnd, 40) + w + item(rnd, 40))) for k, w in enumerate(copies + others)])
    benchmark = spark.createDataFrame([(0, " ".join(long)), (1, " ".join(other))], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.matches(docs, benchmark).collect()}
    assert {k: r.item_id for k, r in found.items()} == {0: 0, 1: 1, 2: 0, 3: 0, 4: 0}
    assert (found[0].start, found[0].stop) == (40, 230) and found[0].score == 190 / 400
    assert {r.doc_id for r in decontaminate.clean(docs, benchmark).collect()} == {5, 6, 7}


def test_short_items_and_scripts_without_spaces(spark, documents):
    rnd = random.Random(10)
    benchmark = spark.createDataFrame(
        [(0, "What is zyx?"), (1, "Qua!"), (2, "who was the first of them"), (3, "水の化学式は何ですか、答えなさい。"), (4, "ประเทศไทยมีกี่จังหวัด"), (5, "what is ZYX")],
        "item_id long, text string",
    )
    fill = lambda: " ".join(item(rnd, 30))
    texts = {
        1: f"{fill()} what is zyx {fill()} What is: ZYX",
        2: f"{fill()} qua",
        3: f"{fill()} (Who was the first, of them) {fill()}",
        4: "今日は晴れです。水の化学式は何ですか答えなさい。明日は雨です。",
        5: "และประเทศไทยมีกี่จังหวัดนะ",
        6: f"what is zyz, who was the first of {fill()}",
        7: "今日は晴れです。明日は雨です。",
    }
    found = {(r.doc_id, r.item_id): r for r in decontaminate.matches(documents(list(texts.items())), benchmark).collect()}
    assert set(found) == {(1, 0), (1, 5), (2, 1), (3, 2), (4, 3), (5, 4)}
    assert (found[1, 0].start, found[1, 0].stop, found[1, 0].score) == (30, 33, 1.0)
    only = benchmark.where("item_id = 1")  # a block without any seed
    assert [(r.doc_id, r.item_id) for r in decontaminate.matches(documents(list(texts.items())), only).collect()] == [(2, 1)]


def test_clean_drops_rows_without_doc_id(spark, documents):
    rnd = random.Random(11)
    words = item(rnd, 20)
    benchmark = spark.createDataFrame([(0, " ".join(words))], "item_id long, text string")
    leak, fine = " ".join(item(rnd, 30) + words), " ".join(item(rnd, 30))
    docs = documents([(None, leak), (None, fine), (None, None), (1, leak), (1, fine), (2, fine)])
    left = decontaminate.clean(docs, benchmark)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(None, fine), (None, None), (1, fine), (2, fine)], key=str)


def test_a_passage_of_many_words_aligns_as_a_short_one():
    """Where an alignment begins may take more than twenty bits."""
    rng = np.random.default_rng(4)
    item = rng.integers(1, 1 << 40, 9, np.uint64)
    width = (1 << 20) + 5_000
    passage = np.arange(width, dtype=np.uint64) + np.uint64(1 << 50)
    score, _, _ = decontaminate.align([item], [passage])
    assert score.tolist() == [0]
    passage[-20:-11] = item
    score, first, last = decontaminate.align([item], [passage])
    assert (score.tolist(), first.tolist(), last.tolist()) == ([2 * 9], [width - 20], [width - 11])


def test_a_phrase_that_items_share_makes_no_passages():
    """Items and texts with a stem in common are pairs only where a rare seed says so."""
    rnd, settings = random.Random(12), decontaminate.Settings()
    stem = "which of the following is".split()
    block = decontaminate.Items([(k, " ".join(stem + item(rnd, 12))) for k in range(30)], settings)
    counts = np.full(len(block.vocabulary), 2)
    counts[np.searchsorted(block.vocabulary, np.sort(word_hashes([w.encode() for w in stem])))] = 10**6
    few = block.only(block.rare(counts, 10**7, settings))
    text = word_hashes([w.encode() for w in item(rnd, 50) + stem + item(rnd, 50)])
    assert len(decontaminate.passages(text, block, settings)) == 30 and not decontaminate.passages(text, few, settings)
    # What is left finds the same places as before.
    own = np.concatenate([text, block.words[7]])
    assert [p[0] for p in decontaminate.passages(own, few, settings)] == [7]


def test_recall_of_seeding_against_alignment_of_all_pairs(spark, documents):
    rnd = random.Random(13)
    items = [item(rnd, rnd.randint(8, 50)) for _ in range(25)]
    texts = []
    for k in range(150):
        copy = list(items[k % 25])
        for _ in range(rnd.randint(0, len(copy) // 4)):
            at, how = rnd.randrange(len(copy)), rnd.random()
            copy[at : at + (how < 0.8)] = [] if how < 0.3 else [f"zz{rnd.randrange(999)}"]
        texts.append((k, " ".join(item(rnd, 30) + (copy if k % 3 else item(rnd, 20)) + item(rnd, 30))))
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(documents(texts), benchmark).collect()}
    pairs = [(d, n) for d, _ in texts for n in range(25)]
    hashed = [word_hashes([w.encode() for w in x]) for x in items]
    words = {d: word_hashes(decontaminate.normal_words(t)) for d, t in texts}
    best, _, _ = decontaminate.align([hashed[n] for _, n in pairs], [words[d] for d, _ in pairs])
    want = {p for p, b in zip(pairs, best) if b >= len(hashed[p[1]])}  # half of the best score
    assert len(want) > 90 and found <= want and len(found & want) >= 0.97 * len(want)
