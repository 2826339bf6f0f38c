import random
import zlib

import numpy as np
import pytest

from pulse.llm import language

SYLLABLES = {
    "aa": "ka lo mi tu re".split(),
    "bb": "sch ung ein pf tz".split(),
    "cc": "ёж ша ни ту ко".split(),
}


def prose(rnd, lang, words):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def model(spark):
    rnd = random.Random(1)
    rows = [(lang, prose(rnd, lang, 60)) for lang in SYLLABLES for _ in range(60)]
    return language.trained(spark.createDataFrame(rows, "lang string, text string"))


def test_held_out_accuracy_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_spans_of_a_mixed_text(documents, model):
    rnd = random.Random(2)
    text = " ".join((prose(rnd, "aa", 30), prose(rnd, "bb", 12), prose(rnd, "cc", 20), prose(rnd, "aa", 9)))
    row = language.predicted(documents([(1, text)]), model).first()
    assert [(s.lang, s.words) for s in row.spans] == [("aa", 30), ("bb", 12), ("cc", 20), ("aa", 9)]
    assert [s.first_word for s in row.spans] == [0, 30, 42, 62] and row.lang_pred == "aa" and row.score < 1


def test_one_foreign_word_is_no_span(documents, model):
    rnd = random.Random(3)
    text = " ".join((prose(rnd, "aa", 30), "pf", prose(rnd, "aa", 30)))
    assert [s.lang for s in language.predicted(documents([(1, text)]), model).first().spans] == ["aa"]


def test_scripts_narrow_the_candidates(model):
    words = language.Words(["шшш kkk 字"], model.classes, model.settings.cells)
    scores = model.scores(words)
    cc = model.languages.index("cc")
    assert scores[0].argmax() == cc and (np.delete(scores[0], cc) < -1e5).all() and scores[1][cc] < -1e5
    assert (scores[2] == 0).all()  # a script that no language uses says nothing


def test_viterbi_equals_all_paths():
    rnd = np.random.default_rng(1)
    counts = np.array([3, 0, 5, 1, 4])
    firsts = np.cumsum(counts) - counts
    scores = rnd.normal(0, 3, (counts.sum(), 3))
    label = language.viterbi(scores, firsts, counts, 2.0)

    def worth(path, part):
        return sum(part[k][x] for k, x in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))

    for first, n in zip(firsts, counts):
        if n:
            part = scores[first : first + n]
            best = max(worth(p, part) for p in np.ndindex(*[3] * n))
            assert worth(label[first : first + n].tolist(), part) == pytest.approx(best)


def test_odd_rows(odd, odd_rows, documents, model):
    rows = language.predicted(odd, model).collect()
    assert len(rows) == len(odd_rows)
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {0, 1, 2} and all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert language.identified(documents([])).count() == 0
    nothing = language.identified(documents([(1, "abc", None)])).first()
    assert nothing.lang_pred == "und" and nothing.score == 0
