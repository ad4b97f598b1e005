import random
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tallyhouse.llm import byte_pairs, packing
from tallyhouse.llm.queries import byte_pair_digests, op2_token_files, op8_byte_bpe
from tests.conftest import SMALL
from tests.llm.fixtures import TEXTS, awkward, empty, key

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCRAPS = ["a", "B", "the", "ing", "  ", "\n", "é", "e", "́", "日", "🙂", "ab", "　", "0", "9", "!!", "_", "\x1c", "\xa0", " ", "\x85",
          "İ", "Σ", "ς", "'s", "'S", "<|endoftext|>", "ᄀ", "ᅡ", "<", "̸", "."]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def pairs():
    return byte_pairs.BytePairs(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(pairs):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50000), st.integers(0, 2**60 - 1)), max_size=300))
def test_packing_round_trip(ids):
    ids = np.array(ids, np.uint64)
    assert packing.unpack(packing.pack(ids), len(ids)).tolist() == ids.tolist()


def test_equal_small_ids_share_words():
    assert len(packing.pack(np.zeros(600, np.uint64))) == 10
    assert len(packing.pack(np.full(4, 2**31, np.uint64))) == 4  # escapes


def test_blocks_are_packed_each_by_itself():
    draw = np.random.default_rng(4)
    for ids in (draw.integers(0, 49408, 10_000), draw.integers(0, 4, 8192), 2 ** draw.integers(0, 60, 5000), np.zeros(0, np.int64)):
        words, begins = packing.pack_blocks(ids)
        alone = [packing.pack(ids[i : i + packing.BLOCK_IDS]) for i in range(0, len(ids), packing.BLOCK_IDS)]
        assert words.tolist() == [w for block in alone for w in block.tolist()]
        assert begins.tolist() == [sum(map(len, alone[:i])) for i in range(len(alone))]


def test_segments_round_trip():
    ids = np.arange(10_000) * 7 % 49408
    lengths = [0, 1, 4096, 5000, 903]
    found = list(packing.read_segment(packing.segment([None, -5, 0, 7, 7], lengths, ids)))
    assert [d for d, _ in found] == [None, -5, 0, 7, 7]
    assert [len(x) for _, x in found] == lengths
    assert np.concatenate([x for _, x in found]).tolist() == ids.tolist()


def scraps(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices(SCRAPS, k=rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("most", [5, 10**6])
def test_words_as_the_library(library, most):
    ours = packing.WordIds(WORDS, most)
    texts = [t or "" for t in TEXTS] + scraps(1, 800)
    for i in range(0, len(texts), 50):
        for text, ids in zip(texts[i : i + 50], ours.encode(texts[i : i + 50])):
            assert ids.tolist() == library(text), text


def test_a_core_is_encoded_once_for_all_its_cases_and_marks(library):
    ours = packing.WordIds(WORDS)
    text = "Word word, WORD. (word) wOrd! word word!"
    (ids,) = ours.encode([text])
    assert ids.tolist() == library(text)
    assert sorted(ours.number) == [b"!", b"(word", b")", b",", b".", b"word"]


def test_words_used_often_stay_when_room_is_made(library):
    ours = packing.WordIds(WORDS, most=6)
    for i in range(5):
        texts = [f"often again {chr(97 + i)}nce", "", "  "]
        assert [x.tolist() for x in ours.encode(texts)] == [library(t) for t in texts]
    assert {b"often", b"again"} <= set(ours.number)
    assert len(ours.number) <= 6
    assert ours.encode([]) == [] and [x.tolist() for x in ours.encode([" ", "\n"])] == [[], []]


def test_a_long_text_in_runs(library):
    text = "Some words, seldom more! " * 400_000
    ours = packing.WordIds(WORDS, special=True)
    before, ids, after = ours.encode(["before", text, "after"])
    assert [before.tolist(), after.tolist()] == [library("before"), library("after")]
    assert ids.tolist() == library("Some words, seldom more!") * 400_000
    ((_, found),) = packing.read_segment(packing.segment([3], [len(ids)], ids))
    assert (found == ids).all()


def test_letters_of_two_bytes_by_the_merges_alone(library):
    ours = packing.WordIds(WORDS)
    for text in ["".join(chr(c) + d for c in [*range(0xDF, 0xF7), *range(0xF8, 0x100)]) for d in ("", "a", "n")]:
        for t in (text, *text, "x" + text[::-1]):
            assert ours.encode([t])[0].tolist() == library(t), t


def test_files(spark, folder, library):
    docs = awkward(spark).repartition(5)
    path = folder.fresh("files")
    packing.write_token_files(docs, path, WORDS, end_id=2)
    rows = sorted(packing.read_token_files(spark, path).collect(), key=lambda r: r.start)
    coded = {}
    for r in docs.collect():
        ids = [*library(r.text), 2]
        coded.setdefault((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), []).append(r)
    assert sorted(map(key, [(r.doc_id, r.n_tokens, r.ids_crc32) for r in rows])) == sorted(key(k) for k, v in coded.items() for _ in v)
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert ids == sorted(ids) and all(r.doc_id is None for r in rows[: len(rows) - len(ids)])


def test_files_of_an_empty_table(spark, folder):
    path = folder.fresh("files")
    packing.write_token_files(empty(spark), path, WORDS, end_id=2)
    assert packing.read_token_files(spark, path).collect() == []


def test_op2_on_a_whole_table(spark, library):
    texts = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    start = 0
    for r in op2_token_files(spark, SMALL).orderBy("doc_id").collect():
        ids = [*library(texts[r.doc_id]), 2]
        assert tuple(r) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_byte_pairs_as_the_library(pairs, reference):
    for text in [t or "" for t in TEXTS] + scraps(2, 1500) + ["ab" * 20_000, "́" * 500, "z" * 3000, " " * 3000]:
        ids = np.frombuffer(pairs.encode(text), "<u4")
        assert ids.tolist() == reference.encode_ordinary(text)
        assert pairs.decode(ids) == text.encode()


def test_every_character_is_split_as_by_the_library(pairs, reference):
    for c in [*range(0x3100), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x10000, 0x12000), *range(0x1D000, 0x1FA00)]:
        text = f"a{chr(c)}{chr(c)}1{chr(c)} {chr(c)}  {chr(c)}"
        assert np.frombuffer(pairs.encode(text), "<u4").tolist() == reference.encode_ordinary(text), hex(c)


def test_long_texts_in_parts(pairs, reference):
    text = " ".join(scraps(3, 300)) + " word one two three" * 400
    parts = list(pairs.parts(text, 100))
    assert len(parts) > 10 and "".join(parts) == text
    assert [t for p in parts for t in reference.encode_ordinary(p)] == reference.encode_ordinary(text)


def expected_digests(rows, reference):
    for r in rows:
        text = r.text or ""
        ids = reference.encode_ordinary(text)
        yield r.doc_id, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(text.encode()).hexdigest()


def test_awkward_digests(spark, reference):
    docs = awkward(spark)
    assert sorted(map(key, byte_pair_digests(docs).collect())) == sorted(map(key, expected_digests(docs.collect(), reference)))
    assert byte_pair_digests(empty(spark)).collect() == []


def test_op8_on_a_whole_table(spark, reference):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert sorted(map(tuple, op8_byte_bpe(spark, SMALL).collect())) == sorted(expected_digests(docs, reference))


SPECIAL = ["a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|>y.", "Don't<|startoftext|><|endoftext|>!!", "A<|ENDOFTEXT|>b <|EndOfText|>.",
           "<|endoftext|", "é<|endoftext|>́ İ<|startoftext|>İ", "(<|endoftext|>)", "<<|endoftext|>>", "\x85<|endoftext|>　z"]


def test_special_tokens_as_by_the_librarys_default(spark, folder):
    tokenizer = Tokenizer.from_file(WORDS)
    default = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    assert default(SPECIAL[0]) == [320, 49407, 321]
    ours = packing.WordIds(WORDS, special=True)
    texts = SPECIAL + scraps(3, 800) + [t + "<|startoftext|>" + t.title() for t in scraps(4, 300)]
    for text, ids in zip(texts, ours.encode(texts)):
        assert ids.tolist() == default(text), text
    path = folder.fresh("files")
    packing.write_token_files(spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id bigint, text string"), path, WORDS, end_id=2)
    found = {r.doc_id: r.ids_crc32 for r in packing.read_token_files(spark, path).collect()}
    assert found == {i: zlib.crc32(np.array([*default(t), 2], "<u4").tobytes()) for i, t in enumerate(SPECIAL)}


def test_random_texts_with_special_tokens():
    """Special strings, odd blanks, marks, capitals without small letters, combining characters: as the library's default."""
    library, words, draw = Tokenizer.from_file(WORDS), packing.WordIds(WORDS, most=500, special=True), random.Random(5)
    parts = ["a", "B", "é", "É", "ß", "İ", "1", "'s", "'T", "'", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "|>", " ", "  ", "\n",
             " ", " ", "́", ".", "!", "(", "-", "_", "ÀB", "ñ", "中", "🙂", "\x00", "\x1f", "\x85", "ǅ", "ﬁ", "don't", "It's,", "word"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(6000)]
    for i in range(0, len(texts), 500):
        some = texts[i : i + 500]
        assert [x.tolist() for x in words.encode(some)] == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
