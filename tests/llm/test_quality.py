import random

import zstandard

from pulse.llm import quality
from tests.llm.conftest import table_texts

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def brute(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in SPACES:
            words += [word] if word else []
            word = ""
        else:
            word += c
    seen, repeated = {}, set()
    for k in range(len(words) - 2):
        seen.setdefault(tuple(words[k : k + 3]), []).append(k)
    for places in seen.values():
        if len(places) > 1:
            repeated |= {k + d for k in places for d in range(3)}
    lines, earlier, same = (text or "").split("\n"), set(), 0
    for line in lines:
        if any(c not in SPACES for c in line):
            same += line in earlier
            earlier.add(line)
    n = len(words)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return n, sum(map(len, words)), symbols, same, len(repeated), n < 50 or 100 * len(repeated) > 50 * n


def rows(df):
    return sorted(
        ((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in df.collect()), key=str
    )


def test_base_counts_equal_brute_force(spark, documents, odd_rows):
    texts = [(r["doc_id"] + 100, r["text"]) for r in table_texts()] + odd_rows
    assert rows(quality.judged(documents(texts))) == sorted(((i, brute(t)) for i, t in texts), key=str)


def test_verdicts(documents):
    rnd = random.Random(1)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
    prose = " ".join(rnd.choice(vocabulary) for _ in range(900))
    noise = " ".join("".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(76)) for _ in range(90))
    stuck = prose[:3000] + " ".join(f"{k} buy" for k in range(900)) + " la" * 4000
    found = {r.doc_id: r for r in quality.judged(documents([(1, prose), (2, noise), (3, stuck)])).collect()}
    assert found[1].kept and found[1].verdict == "good"
    assert not found[2].kept and found[2].verdict == "incompressible" and not found[2].base_failed
    assert not found[3].kept and found[3].verdict == "repetitive"


def test_chunks_tell_what_the_whole_hides():
    rnd = random.Random(2)
    prose = " ".join("".join(rnd.choice("etaoin shrdlu") for _ in range(6)) for _ in range(6000)).encode()
    packer = zstandard.ZstdCompressor(level=3, write_content_size=False)
    bands = quality.Bands()
    assert quality.compression(prose, bands, packer)[0] == "good"
    assert quality.compression(prose + b"again and " * 2000, bands, packer)[0] == "repetitive"


def test_junk_at_the_tail_counts_as_elsewhere():
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 8))) for _ in range(500)]
    prose = " ".join(rnd.choice(vocabulary) for _ in range(9000)).encode()
    junk = "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(8000)).encode()
    packer = zstandard.ZstdCompressor(level=3, write_content_size=False)
    judge = lambda text: quality.compression(text, quality.Bands(), packer)
    assert judge(prose[:4100] + junk[:4042])[0] == judge(junk[:4096] + prose[:4046])[0] == "incompressible"
    again = b"again and " * 400
    assert judge(prose[:4096] + again)[0] == judge(again[:3996] + prose[:4196])[0] == "repetitive"
    # A short rest does not make the chunk that it overlaps count twice.
    assert judge(prose[: 4 * 4096] + junk[:4096] + prose[-20:])[0] == judge(prose[: 4 * 4096] + junk[:4096])[0] == "good"
    assert judge(prose[: 2 * 4096 + 10])[4] == 3 and judge(prose[:4096])[4] == 1 and judge(prose[:4000])[4] == 0


def test_limits_by_length():
    bands = quality.Bands()
    assert bands.limits(10) == (0.35, 2.0) and bands.limits(512) == (0.30, 0.85) and bands.limits(10**9) == (0.25, 0.70)


def test_filtered_keeps_columns_and_agrees(documents, odd):
    docs = documents([(r["doc_id"], r["text"]) for r in table_texts()]).unionAll(odd)
    left = quality.filtered(docs)
    assert left.columns == docs.columns and left.dtypes == docs.dtypes
    judged = {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    assert {r.doc_id for r in left.collect()} == judged and judged
    assert quality.filtered(docs.limit(0)).count() == 0 and quality.judged(docs.limit(0)).count() == 0
