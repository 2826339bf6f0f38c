import hashlib
import random
import zlib

import pytest

from pulse.llm import manifest

H = lambda text: hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, fanout):
    """All levels, from the nodes to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H("".join(last[k : k + fanout])) for k in range(0, len(last), fanout)])
    return levels


def way(levels, at, fanout):
    """Hashes before and after on each level."""
    path = []
    for level in levels[:-1]:
        run = at - at % fanout
        path.append((level[run:at], level[at + 1 : run + fanout]))
        at //= fanout
    return path


def by_brute_force(rows, fanout=16):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in by_source[s]], fanout)
    top = tree([trees[s][-1][0] for s in sources], fanout)
    out = []
    for place, s in enumerate(sources):
        for at, row in enumerate(by_source[s]):
            path = way(trees[s], at, fanout) + way(top, place, fanout)
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None
            now = leaf((*row[:4], row[4].translate(str.maketrans(manifest.UPPER, manifest.LOWER)))) if changed else leaf(row)
            for before, after in path:
                now = H("".join([*before, now, *after]))
            proof = H("".join(h for before, after in path for h in before + after))
            out.append((row[0], leaf(row), trees[s][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def proved(spark, rows, settings, schema=SCHEMA, **more):
    docs = spark.createDataFrame(rows, schema).repartition(5)
    got = manifest.proved(docs, settings, *manifest.lowered_text(), **more)
    return got, sorted((tuple(r)[:7] for r in got.collect()), key=str)


@pytest.mark.parametrize("fanout,block", [(16, 4096), (16, 16), (2, 2), (2, 8), (3, 3)])
def test_equals_brute_force(spark, fanout, block):
    rng = random.Random(fanout * block)
    rows = []
    for source, n in ((None, 1), ("a", 257 if fanout == 16 else 70), ("é", 16), ("Z", 17), ("", 33), ("b", 2)):
        rows += [(rng.choice([None, rng.randrange(10**6)]), source, rng.choice(["en", None]), k, rng.choice([None, "", "Aé b", "x" * k])) for k in range(n)]
    rows += rows[:20]
    settings = manifest.Settings(fanout=fanout, block=block, salts=3)
    assert proved(spark, rows, settings, with_siblings=False)[1] == by_brute_force(rows, fanout)


def test_many_sources_and_one_row(spark):
    rows = [(k, f"s{k}", "en", 1, "T") for k in range(40)]
    assert proved(spark, rows, manifest.Settings())[1] == by_brute_force(rows)
    assert proved(spark, rows[:1], manifest.Settings())[1] == by_brute_force(rows[:1])


def test_a_proof_leads_to_the_root(spark):
    rows = [(k, "s", "en", 1, f"Text {k}") for k in range(40)]
    got, _ = proved(spark, rows, manifest.Settings(block=16))
    for r in got.collect():
        path = [("".join(level[:at]), "".join(level[at:])) for at, level in zip(r["path"], r["siblings"])]
        assert manifest.folded(r["leaf"], path) == r["root"]
        assert H("".join(before + after for before, after in path)) == r["proof_sha256"]
        assert r["pos"] == r["doc_id"] and r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0)


def test_every_change_is_seen(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k, "s", "en", k, "same") for k in range(30)], SCHEMA)
    got = manifest.proved(docs, now={"n_chars": F.when(F.col("doc_id") == 7, 70).otherwise(F.col("n_chars"))})
    assert [r["doc_id"] for r in got.where("NOT verified").collect()] == [7]


def test_odd_rows_and_clashing_names(spark, odd, documents):
    more = "g string, k string, p long, h string, tie string, block string, piece string, n long"
    values = [f"'x' AS {part.split()[0]}" if part.endswith("string") else f"1L AS {part.split()[0]}" for part in more.split(", ")]
    docs = odd.drop("block").selectExpr("*", *values)
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = manifest.proved(docs, manifest.Settings(), *manifest.lowered_text())
    assert sorted((tuple(r)[:7] for r in got.collect()), key=str) == by_brute_force(rows)
    assert manifest.proved(documents([]).where("false")).collect() == []


def test_no_row_is_passed_down_again(spark):
    """The rounds are one exchange each, in groups by number, and nothing else."""
    nodes = spark.createDataFrame([("s", k, 300, H(str(k))) for k in range(300)], "g string, p long, n long, h string")
    done = manifest.butterfly(nodes, 16)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3 and "Join" not in plan
    levels = tree([H(str(k)) for k in range(300)], 16)
    for r in done.collect():
        want = way(levels, r["p"], 16)
        assert r["top"] == levels[-1][0] and [(x["at"], x["others"]) for x in r["path"]] == [(len(b), b + a) for b, a in want]
