"""Substring dedup against all windows written out."""

import numpy as np
import pyarrow as pa
import pytest

from tallyhouse.llm.substrings import Chunk, cut_repeats, levels
from tests.llm.fixtures import LONG, awkward, empty


def brute(docs, window):
    """(id, text) in order -> n_words, gone, by comparing whole windows."""
    seen, out = set(), []
    for _, text in docs:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        out.append((len(words), gone, b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return out


def agrees(spark, folder, docs, window=20, **sizes):
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, chunk int, ids string")
    found = {r.doc_id: r for r in cut_repeats(frame.repartition(5), folder, window=window, **sizes).collect()}
    docs = sorted(docs)
    assert len(found) == len(docs)
    for (i, _), (n, gone, kept) in zip(docs, brute(docs, window), strict=True):
        r = found[i]
        assert (r.n_words, r.n_removed, r.kept) == (n, sum(gone), kept)
        spread = np.zeros(n, bool)
        for span in r.cut:
            assert 0 <= span.first < span.end <= n and not spread[span.first : span.end].any()
            spread[span.first : span.end] = True
        assert spread.tolist() == gone


def sentence(seed, n, vocabulary=4000):
    return " ".join(f"w{k}" for k in np.random.default_rng(seed).integers(vocabulary, size=n))


@pytest.mark.parametrize("window,start", [(20, 5), (20, 20), (7, 3), (8, 1), (2, 1), (33, 4)])
def test_shared_passages(spark, folder, window, start):
    passage, other = sentence(1, 60), sentence(2, 25)
    docs = [(i, f"{sentence(10 + i, 30)} {passage if i % 3 == 0 else other} {sentence(50 + i, i % 7)}") for i in range(24)]
    docs += [(100, passage), (101, " ".join(passage.split()[3:22])), (102, " ".join(passage.split()[3:24]) + " end")]
    docs += [(200 + i, sentence(i, 90, vocabulary=3)) for i in range(6)]  # few words: all short windows are repeated
    agrees(spark, folder, docs, window, start=start, chunk_bytes=700)


def test_within_one_document(spark, folder):
    """Periodic texts, overlaps of a window with itself, and a repeat right after its model."""
    once = sentence(3, 20)
    docs = [(1, "a " * 50), (2, "a b " * 30), (3, f"{once} {once}"), (4, f"x {once}"), (5, "a " * 19), (6, "A " * 25), (-5, "a " * 21)]
    agrees(spark, folder, docs)


def test_white_space_is_no_content(spark, folder):
    agrees(spark, folder, [(1, sentence(4, 25)), (2, sentence(4, 25).replace(" ", "\n\t")), (3, sentence(4, 25).replace(" ", " "))])


def test_copies_of_a_long_text(spark, folder):
    """Over a megabyte, longer than a chunk; the copies go whole, but for the words that differ."""
    long = " ".join(f"{LONG} {i}" for i in range(14))
    assert len(long) > 1_000_000
    agrees(spark, folder, [(3, long), (1, long), (2, "new " + long + " end")], chunk_bytes=1 << 16)


def test_awkward_rows(spark, folder):
    docs = awkward(spark)
    found = cut_repeats(docs, folder).collect()
    assert len(found) == docs.count()
    assert sum(r.doc_id is None for r in found) == docs.filter("doc_id IS NULL").count()
    # The long text comes twice, the second time with a word more; the first stays.
    assert [r.n_removed for r in sorted(found, key=lambda r: r.n_words)[-2:]] == [0, len(LONG.split())]
    assert cut_repeats(empty(spark), folder).collect() == []


def test_repeated_rows_keep_one(spark, folder):
    """Equal rows, rows under one id, and NULL ids: each text stays once."""
    text = sentence(5, 40)
    rows = [(1, text), (1, text), (None, text), (None, sentence(6, 30)), (1, sentence(6, 30))]
    found = cut_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), folder).collect()
    assert sorted((r.n_words, r.n_removed) for r in found) == [(30, 0), (30, 30), (40, 0), (40, 40), (40, 40)]
    assert [r.n_removed for r in found if r.doc_id is None and r.n_words == 30] == [30]


def test_words_across_blocks(monkeypatch):
    """Hashes do not depend on where blocks of bytes are cut, nor on what stands around a word."""
    texts = pa.array(["", " one two", None, "three  one " + "x" * 300 + "\n", "two", " \t"])
    whole = Chunk(texts, 2)
    assert np.diff(whole.at).tolist() == [0, 2, 0, 3, 1, 0]
    names = whole._hashes(0)
    monkeypatch.setattr("tallyhouse.llm.substrings._BLOCK", 5)
    assert (Chunk(texts, 2)._hashes(0) == names).all()
    assert names[0] == names[3] and names[1] == names[5] and len(set(names.tolist())) == 4
    sliced = Chunk(texts.slice(3, 2), 2)
    assert (sliced._hashes(0) == names[2:]).all()


def test_early_end(spark, folder):
    """Nothing is repeated: no candidate survives the first length."""
    agrees(spark, folder, [(i, " ".join(f"u{i}x{k}" for k in range(40))) for i in range(5)])


def test_lengths_double():
    assert levels(20, 5) == [5, 10] and levels(20, 20) == [] and levels(33, 4) == [4, 8, 16, 32] and levels(8, 1) == [1, 2, 4]


def test_equal_candidates_share_their_stand_in():
    chunk = Chunk(pa.array([sentence(7, 50), None, "x " + sentence(7, 50)]), 20)
    least, distinct, twice = chunk.stand_ins(5, chunk.open)
    assert (least[:31] == least[51:82]).all()
    assert twice[np.searchsorted(distinct, least[:31])].all()


def test_wrong_lengths(spark, folder):
    with pytest.raises(ValueError):
        cut_repeats(empty(spark), folder, window=4, start=5)
