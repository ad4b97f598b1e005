import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyhouse.llm import language_model as lm
from tests.conftest import SMALL
from tests.llm.fixtures import TEXTS, awkward, empty, words

TINY = lm.Settings(words=40, classes=8, frequent=60, size=8, batch=64, noise=16, rounds=2)


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def tokens(text):
    return [w.encode() for w in words(text)] + [lm.END]


def base_scores(rows):
    counts = Counter(t for r in rows if not held(r.doc_id) for t in tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        own = tokens(r.text)
        yield r.doc_id, held(r.doc_id), len(own), sum(t in counts for t in own), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)


def check(found, rows):
    ours = sorted(found, key=lambda r: (str(r.doc_id), r.n_tokens, r.base_score))
    true = sorted(base_scores(rows), key=lambda r: (str(r[0]), r[2], r[5]))
    assert [tuple(r)[:5] for r in ours] == [r[:5] for r in true]
    assert [r.base_score for r in ours] == pytest.approx([r[5] for r in true])
    assert all(math.isfinite(r.score) and r.score < 0 for r in ours)


@pytest.mark.parametrize("settings", [TINY, lm.Settings()])
def test_awkward_rows(spark, folder, settings):
    docs = awkward(spark)
    check(lm.score(docs, folder, settings=settings).collect(), docs.collect())


def test_empty_table(spark, folder):
    assert lm.score(empty(spark), folder, settings=TINY).collect() == []


def test_nothing_to_learn_from(spark, folder):
    ids = [i for i in range(60) if held(i)][:3]
    docs = spark.createDataFrame([(i, "a b") for i in ids], "doc_id bigint, text string")
    rows = lm.score(docs, folder, settings=TINY).collect()
    assert [(r.n_known, r.train_tokens) for r in rows] == [(0, 0)] * 3
    assert all(math.isfinite(r.score) for r in rows)


def test_beats_the_base_on_held_out_texts(spark, folder):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = lm.score(docs, folder).collect()
    check(rows, docs.collect())
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_many_words_of_one_count_are_modelled(spark, folder):
    """300 words once each, more than may travel: a part of them does, and the model is full."""
    docs = spark.createDataFrame([(0, " ".join(f"w{i}" for i in range(300)))], "id bigint, text string")
    vocab = lm.vocabulary(folder.keep(lm.token_counts(docs), "counts"), TINY)
    assert TINY.words <= len(vocab.code) <= TINY.frequent
    assert sum(k < TINY.words for k in vocab.code.values()) == TINY.words
    assert vocab.types == vocab.tokens == vocab.weights.sum() == 301


def test_rows_move_by_the_learners_that_touched_them():
    base = lm.Model(np.ones(5), TINY)
    one, two = lm.deepcopy(base), lm.deepcopy(base)
    one.q[0] += 1
    one.steps[2][0] = 3
    one.q[1] += 1
    one.steps[2][1] = 1
    two.q[1] += 5
    two.steps[2][1] = 3
    after = lm.deepcopy(base)
    after.move(one.moves(base) + two.moves(base))
    assert after.q - base.q == pytest.approx(np.array([1, 4, 0, 0, 0])[:, None] * np.ones(TINY.size), abs=1e-5)
    assert (after.b == base.b).all() and (after.c == base.c).all()


@pytest.mark.parametrize("share, close", [(1 << 22, 1e-6), (1 << 14, 0.01)])
def test_scores_do_not_depend_on_partitions(spark, folder, share, close):
    """Mean held-out scores of a token over 1 and 40 partitions: the same by one learner, close by several."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    means = []
    for n in (1, 40):
        out = [r for r in lm.score(docs.repartition(n), folder, settings=lm.Settings(share=share)).collect() if r.held_out]
        means.append(sum(r.score for r in out) / sum(r.n_tokens for r in out))
    assert means[0] == pytest.approx(means[1], rel=close)


def test_tokens_of_slices():
    import pyarrow as pa

    for part in lm._groups(iter([pa.RecordBatch.from_arrays([pa.array(TEXTS)], names=["text"])]), 0, rows=3):
        different, found, lengths = lm.tokens_of(part.column(0))
        ends = np.cumsum([0, *lengths])
        listed = different.to_pylist()
        for text, a, b in zip(part.column(0).to_pylist(), ends[:-1], ends[1:]):
            assert [listed[i] for i in found[a:b]] == tokens(text)


def test_probabilities_of_all_words_add_up(spark, folder):
    """Over all codes for any context, and over all words of a class with one that no text has."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumnRenamed("doc_id", "id")
    counts = folder.keep(lm.token_counts(docs), "counts")
    vocab = lm.vocabulary(counts, TINY)
    model = lm.Model(vocab.weights, TINY)
    model.c += np.random.default_rng(1).normal(size=model.c.shape).astype(np.float32)
    scorer = lm.Scorer(model)
    for u, v in ((0, 1), (5, 47), (40, 40)):
        total = sum(10 ** scorer.log10(np.array([v, u, w]))[2] for w in range(len(vocab.weights)))
        assert total == pytest.approx(1, abs=1e-4)
    known = {bytes(r.token): r.c for r in counts.collect()}
    model_words = {w for w, k in vocab.code.items() if k < TINY.words}
    for k in range(TINY.classes):
        rest = [c for w, c in known.items() if w not in model_words and lm.class_of(w, TINY) == k]
        assert sum(c + 1 for c in rest) + 1 == vocab.denominators[k]
        assert sum(rest) == vocab.weights[TINY.words + k]
