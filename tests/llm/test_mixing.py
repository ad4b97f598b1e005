import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import mixing
from tallyhouse.llm.queries import word_count
from tests.llm.fixtures import TEXTS, awkward, empty, key, words


def mixed(docs, folder, **how):
    return mixing.mix(docs, folder, word_count(docs["text"]), **how)


def test_awkward_rows(spark, folder):
    docs = awkward(spark)
    rows = mixed(docs, folder).collect()
    assert len(rows) == docs.count()
    assert sorted(r["size"] for r in rows) == sorted(len(words(r.text)) for r in docs.collect())
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert {r.source for r in rows} == {None, "a", "b", "ä"}
    assert sorted(map(key, rows)) == sorted(map(key, mixed(docs, folder).collect()))


def test_empty_table(spark, folder):
    assert mixed(empty(spark), folder).collect() == []


def test_no_words_at_all(spark, folder):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id bigint, text string, source string")
    assert [r.taken for r in mixed(docs, folder).collect()] == [0, 0]


def test_targets_fill_up_by_weight(spark, folder):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), ("d", 2000), (None, 7)], "source string, size bigint")
    got = {r.source: r.target for r in mixing.source_targets(sizes, (3, 1, 2), 1.5, 2.0).collect()}
    sums, weights = {"a": 10, "b": 1000, "c": 500, "d": 2000, None: 7}, {"a": 3, "b": 1, "c": 2, "d": 3, None: 1}
    full: dict = {}
    while True:  # the excess goes to the others, again and again
        rest = 1.5 * sum(sums.values()) - sum(full.values())
        open_ = [s for s in sums if s not in full]
        now = {s: rest * weights[s] / sum(weights[x] for x in open_) for s in open_}
        above = [s for s in open_ if now[s] > 2 * sums[s]]
        if not above:
            break
        full |= {s: 2.0 * sums[s] for s in above}
    assert got == pytest.approx(full | now)


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 1001])
def test_highest_quotients(spark, seats):
    want = {i: float((i * 37) % 11 * 13) for i in range(20)}
    parts = spark.createDataFrame([(i, w) for i, w in want.items()], "place int, want double")
    got = {r.place: r.quota for r in mixing.apportion(parts, [], "want", F.lit(seats), F.lit(10**6), "place").collect()}
    quotas = dict.fromkeys(want, 0)
    for _ in range(seats):
        best = max((w / (2 * quotas[i] + 1), -i) for i, w in want.items())
        quotas[-best[1]] += 1
    assert got == quotas


def test_sources_come_near_their_targets(spark, folder):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
        F.repeat(F.lit("w "), (F.col("id") * 7919 % 300).cast("int")).alias("text"),
    )
    sums = mixed(docs, folder, shard_size=4096).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    for r in sums.collect():
        assert r.taken == pytest.approx(r.target, rel=0.02)


def test_pieces_add_up(spark, folder):
    rows = mixed(awkward(spark), folder, block=8).collect()
    assert all(r.taken == r.rounds * r["size"] + r.to_1 - r.from_1 + r.to_2 - r.from_2 for r in rows)
    assert all(0 <= r.from_1 <= r.to_1 <= r["size"] and 0 <= r.from_2 <= r.to_2 <= r["size"] for r in rows)
    assert len(rows) == len(TEXTS) + 4
