"""Importance resampling against features, gains and ranks written out."""

import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import resampling
from tallyhouse.llm.queries import QUERIES
from tallyhouse.llm.resampling import _hashes, border, bucket_counts, highest, resample
from tests.conftest import SMALL
from tests.llm.fixtures import LONG, awkward, empty

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text):
    words = _WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return len(words), [zlib.crc32(b" ".join(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(docs, target):
    """(id, text) -> (id, n_features, weight, score, rank), sorted."""
    n = 10_000
    made = [(i, *brute_features(t)) for i, t in docs]
    counts = []
    for features in ([f for _, _, fs in made for f in fs], [f for t in target for f in brute_features(t)[1]]):
        counts.append([0] * n)
        for f in features:
            counts[-1][f % n] += 1
    s, t = counts
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + n) / ((s[b] + 1) * (sum(t) + n)))) for b in range(n)]
    rows = []
    for i, words, features in made:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[f % n] for f in features)
        rows.append((i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    open_ = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = [(*r[:4], k + 1) for k, r in enumerate(open_[: 5 * len(open_) // 100])]
    rest = open_[len(drawn) :] + [r for r in rows if r[4] < 20]
    return drawn, [r[:4] for r in rest]


def agrees(found, docs, target):
    drawn, rest = brute(docs, target)
    key = lambda r: tuple((v is None, v) for v in r)
    rows = [(r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in found.collect()]
    assert sorted((r for r in rows if r[4]), key=lambda r: r[4]) == drawn
    assert sorted((r[:4] for r in rows if not r[4]), key=key) == sorted(rest, key=key)


def test_whole_tables(spark):
    read = lambda t: spark.read.parquet(f"{SMALL}/{t}.parquet").collect()
    found = QUERIES["op11_importance_resampling"](spark, SMALL)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in found.dtypes} == {"bigint"}
    agrees(found, [(r.doc_id, r.text) for r in read("documents")], [r.text for r in read("benchmark")])


def test_awkward_rows(spark, folder):
    docs = awkward(spark)
    agrees(resample(docs, docs.limit(3), folder), [(r.doc_id, r.text) for r in docs.collect()], [r.text for r in docs.limit(3).collect()])
    assert resample(empty(spark), docs, folder).collect() == []
    none = resample(docs, empty(spark), folder)
    agrees(none, [(r.doc_id, r.text) for r in docs.collect()], [])


def test_ties_go_to_the_smaller_id(spark, folder, monkeypatch):
    """Without noise, 120 texts of two kinds tie; NULL ids come last and repeated rows by their place."""
    monkeypatch.setattr(resampling, "noise", lambda id_, seed: F.lit(0))
    text = " ".join(f"w{k}" for k in range(25))
    rows = [(i if i % 10 else None, text) for i in range(100)] + [(5, text), (5, text), (-3, text)] + [(200, text + " more")] * 17
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    target = spark.createDataFrame([(text,)], "text string")
    for percent, ids in ((1, [-3]), (4, [-3, 1, 2, 3]), (8, [-3, 1, 2, 3, 4, 5, 5, 5, 6])):
        out = resample(frame, target, folder, percent=percent).filter("rank IS NOT NULL").orderBy("rank").collect()
        assert [r.doc_id for r in out] == ids[: percent * 120 // 100]
        assert [r["rank"] for r in out] == list(range(1, len(out) + 1))
    out = resample(frame, target, folder, percent=100)
    assert out.filter("rank IS NULL").count() == 0 and out.count() == 120


def test_long_texts_in_pieces(monkeypatch):
    """Over a megabyte; n-grams across pieces are the same as without pieces."""
    text = " ".join([LONG] * 12)
    assert len(text) > 1_000_000
    n, expected = brute_features(text)
    for size in (1 << 20, 50_000, 1):
        monkeypatch.setattr(resampling, "PIECE_BYTES", size)
        part = text if size > 1 else LONG[:3000]
        n, expected = brute_features(part)
        found = list(_hashes(part, 3))
        assert sum(k for k, _ in found) == n
        assert sorted(h for _, hs in found for h in hs.tolist()) == sorted(expected)


@pytest.mark.parametrize("text", ["", "a", "a b", "É É\x00ß\x7fß", "A1-b2_C3", "-- --", "ends in blank "])
def test_short_texts(text):
    n, expected = brute_features(text)
    found = list(_hashes(text, 3))
    assert sum(k for k, _ in found) == n and sorted(h for _, hs in found for h in hs.tolist()) == sorted(expected)


def test_counts_do_not_depend_on_partitions(spark):
    docs = awkward(spark)
    assert bucket_counts(docs.repartition(1), "text") == bucket_counts(docs.repartition(9), "text")


@pytest.mark.parametrize("values", [[3], [5, 5, 5], list(range(-40, 60)), [0, 2**62, -(2**62), 7, 7, 7, 2**62]])
def test_border(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "v bigint")
    for wanted in sorted({1, len(values) // 2 or 1, len(values)}):
        value = sorted(values)[wanted - 1]
        assert border(frame, "v", wanted) == (value, sum(v < value for v in values), sum(v <= value for v in values))


def test_highest_needs_a_unique_order(spark):
    frame = spark.createDataFrame([(1,), (1,)], "v bigint")
    with pytest.raises(ValueError):
        highest(frame, ["v"], 1)
