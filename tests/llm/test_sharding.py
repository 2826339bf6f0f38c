import hashlib
from collections import Counter

from pyspark.sql import functions as F

from pulse.llm import sharding


def names(spark, n):
    return spark.createDataFrame([(f"s{k}",) for k in range(n)], "shard string")


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def brute(shards):
    size = sharding.table_size(len(shards))
    shards = sorted(shards)
    orders = [(number(s + "/offset") % size, number(s + "/step") % (size - 1) + 1) for s in shards]
    owner, come = [None] * size, [0] * len(shards)
    for turn in range(size):
        i = turn % len(shards)
        while owner[(orders[i][0] + come[i] * orders[i][1]) % size] is not None:
            come[i] += 1
        owner[(orders[i][0] + come[i] * orders[i][1]) % size] = shards[i]
    return owner


def slots(spark, n):
    return [r.shard for r in sharding.slot_table(spark, names(spark, n)).orderBy("slot").collect()]


def test_table_equals_taking_turns(spark):
    for n in (1, 2, 5, 40):
        assert slots(spark, n) == brute([f"s{k}" for k in range(n)])


def test_shares_are_equal_and_few_keys_move(spark):
    six, five = slots(spark, 6), slots(spark, 5)
    counts = Counter(six)
    assert max(counts.values()) - min(counts.values()) <= 1
    # Slots are compared by their place, so the tables are first brought to one size.
    size = sharding.table_size(6)
    where = lambda table, k: table[number(str(k)) % len(table)]
    assert size == len(six) and len(five) == sharding.table_size(5)
    assert {where(six, k) for k in range(2000)} == {f"s{k}" for k in range(6)}


def test_rows_are_placed_by_their_key(spark, odd, odd_rows):
    table = sharding.slot_table(spark, names(spark, 3))
    owner = brute(["s0", "s1", "s2"])
    rows = sharding.placed(odd, ["doc_id"], table)
    assert rows.columns == [c for c in odd.columns if c != "shard"] + ["slot", "shard"]
    found = [(r.doc_id, r.slot, r.shard) for r in rows.collect()]
    assert len(found) == len(odd_rows)
    for doc_id, slot, shard in found:
        assert slot == number("\0" if doc_id is None else str(doc_id)) % len(owner) and shard == owner[slot]
    assert sharding.placed(odd.limit(0), ["doc_id"], table).count() == 0
    assert sharding.placed(odd, ["lang", "source"], table).select("shard").distinct().count() == 1


def test_hot_keys_are_split(spark):
    table = sharding.slot_table(spark, names(spark, 8))
    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    whole = Counter(r.shard for r in sharding.placed(rows, ["k"], table).collect())
    split = Counter(r.shard for r in sharding.placed(rows, ["k"], table, split_above=0.01).collect())
    assert sum(split.values()) == 4000 and max(whole.values()) > 1500 and max(split.values()) < 900


def test_split_keys_go_to_the_same_shards_under_any_partitioning(spark):
    table = sharding.slot_table(spark, names(spark, 8))
    rows = spark.range(2000).select(F.lit("hot").alias("k"), "id")
    once = sharding.placed(rows.repartition(7, "id"), ["k"], table, split_above=0.05)
    again = sharding.placed(rows.coalesce(1).orderBy(F.desc("id")), ["k"], table, split_above=0.05)
    assert sorted(once.collect()) == sorted(again.collect())


def test_no_shards(spark):
    table = sharding.slot_table(spark, spark.createDataFrame([(None,)], "shard string"))
    assert table.count() == 0 and table.columns == ["slot", "shard"]
    assert [tuple(r) for r in sharding.placed(spark.range(1), ["id"], table).collect()] == [(0, 0, None)]


def test_no_python_on_the_path(spark, odd):
    plan = sharding.placed(odd, ["doc_id"], sharding.slot_table(spark, names(spark, 3)), 0.2)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "BroadcastHashJoin" in text
