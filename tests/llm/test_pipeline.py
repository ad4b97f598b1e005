from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as cp
from tallyhouse.llm import rules
from tallyhouse.llm.byte_pairs import BytePairs
from tests.conftest import SMALL
from tests.llm.fixtures import FOLD, awkward, empty, key, words
from tests.llm.test_simhash import groups, slow_fingerprint


def rows(df):
    return sorted(map(key, df.collect()))


def check(stage, spark, docs, expected):
    out = stage(spark, docs, SMALL)
    assert out.dtypes == docs.dtypes
    assert rows(out) == sorted(map(key, expected))
    return out


def clash(spark):
    """More columns, with the names that the operators use themselves."""
    docs = awkward(spark).selectExpr("*", "1L AS n_chars", "'m' AS mark", "2 AS size", "array(1) AS rounds", "text AS copy")
    return docs.withColumnRenamed("fp", "taken")


@pytest.mark.parametrize("table", [clash, empty])
def test_stages_against_brute_force(spark, table):
    docs = table(spark)
    source = docs.collect()
    good = [r for r in source if not any(x.rejects(rules.Text(r.text)) for x in rules.RULES)]
    check(cp.quality_rules, spark, docs, good)
    by_text: dict = {}
    for r in source:
        by_text.setdefault((r.text or "").translate(FOLD), []).append(r)
    largest = [max(g, key=lambda r: (r.doc_id is not None, r.doc_id or 0)) for g in by_text.values()]
    out = cp.exact_dedup(spark, docs, SMALL)
    assert sorted(str((r.doc_id, (r.text or "").translate(FOLD))) for r in out.collect()) == sorted(
        str((r.doc_id, (r.text or "").translate(FOLD))) for r in largest
    )
    assert out.dtypes == docs.dtypes
    near = cp.simhash_dedup(spark, docs, SMALL)
    root = groups([slow_fingerprint(r.text) for r in source], 3)
    assert near.count() == len(set(root)) and near.dtypes == docs.dtypes


@pytest.mark.parametrize("table", [clash, empty])
def test_mixing_takes_what_the_operator_says(spark, folder, table):
    docs = table(spark)
    out = cp.mixing_sources(spark, docs, SMALL)
    assert out.dtypes == docs.dtypes
    got = Counter()
    for r in out.collect():
        got[r.doc_id, r.source] += len(words(r.text))
    want = Counter()
    for r in cp.mixing.mix(docs, folder, cp.word_count(docs["text"])).collect():
        want[r.doc_id, r.source] += r.taken
    assert +got == +want
    texts = [r.text or "" for r in docs.collect()]
    assert all(any(r.text in t for t in texts) for r in out.collect())


def test_run(spark):
    pairs = BytePairs(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})
    folder = cp.SharedFolder.of(spark)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        docs = folder.keep(stage(spark, docs, SMALL), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    expected = Counter()
    for r in docs.collect():
        ids = np.array(library.encode_ordinary(r.text), "<u4").tobytes()
        expected[r.doc_id, len(ids) // 4, sha256(ids).hexdigest(), sha256(r.text.encode()).hexdigest(), ids] += 1
    assert Counter((*r[:4], bytes(r[4])) for r in cp.run(spark, SMALL).collect()) == expected


def test_contract():
    assert 4 <= len(cp.STAGES) <= 5 and cp.ORACLE_SQL is None
