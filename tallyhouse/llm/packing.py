"""Token ids in binary files, packed into 64-bit words (Simple-8b).

A word is a 4-bit selector and 60 bits that hold as many ids as the widest of them allows; an id of
more than 30 bits is escaped into a word of its own. Ids are packed in blocks; a table of block
offsets lets a reader decode any block by itself, and within a block all words of one selector are
decoded at once.

A shard file is a run of segments, each with whole documents in ascending id order:

    4s    magic "S8b1"
    3*u4  documents, ids, blocks
    q     per document: its id (the smallest integer if NULL)
    u4    per document: its number of ids
    u4    per block: its first word
    u8    words

All numbers are little-endian. Segments are the rows of a parquet table (one file per shard), so that
Spark commits them as a whole, retries lost tasks and reaches any store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

MAGIC = b"S8b1"
NO_ID = -(2**63)
BLOCK_IDS, SEGMENT_IDS = 4096, 1 << 16

# Bits per id of selectors 1 to 13; a word holds 60 // bits ids. 15 is the escape.
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30)
ESCAPE = 15

_COUNT = np.ones(16, np.int64)
_WIDTH = np.full(16, 60, np.int64)
for _selector, _bits in enumerate(BITS, 1):
    _COUNT[_selector], _WIDTH[_selector] = 60 // _bits, _bits
_MOST = int(_COUNT.max())
# How many selectors fit tells the selector, as whatever does not fit one fits no narrower one.
_CHOICE = np.array([ESCAPE, *range(len(BITS), 0, -1)], np.uint8)
_STEPS = _COUNT[_CHOICE].astype(np.uint8).tobytes().ljust(256)
_LEVELS = np.searchsorted(np.array([1 << bits for bits in BITS]), np.arange(1 << 16), side="right").astype(np.uint8)
_PLAIN = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$"  # small letters that are NFC
_ALNUM = np.array([bytes([b]).isalnum() for b in range(256)])
# Letters that stand for bytes beyond printable ASCII in byte-level vocabularies, where they are not the bytes' own.
_LETTERS = {chr(b): chr(256 + i) for i, b in enumerate(b for b in range(256) if not 33 <= b <= 126 and not 161 <= b != 173) if b > 126}
_LIMITS = np.array([1 << bits for bits in BITS], np.uint64)


def pack(ids: np.ndarray) -> np.ndarray:
    """One block of ids below 2**60 as words; the last word may have room left."""
    return pack_blocks(ids, max(len(ids), 1))[0]


def pack_blocks(ids: np.ndarray, block: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray]:
    """Ids below 2**60 as the words of all blocks, and each block's first word."""
    n, blocks, width = len(ids), -(-len(ids) // block), block + _MOST
    small = n and int(ids.max()) < len(_LEVELS)
    # Selectors up to an id's level are too narrow; the last word of a block may have room left.
    levels = _spread(_LEVELS[ids] if small else np.searchsorted(_LIMITS, ids, side="right"), block, np.uint8)
    fitting, span = np.zeros(len(levels), np.uint8), 1
    for selector in range(len(BITS), 0, -1):  # from few wide ids to many narrow ones
        # The highest level of so many ids, as that of two shorter runs which cover them.
        more = int(_COUNT[selector]) - span
        np.maximum(levels[:-more], levels[more:], out=levels[:-more])
        span += more
        fitting += levels < selector
    steps = fitting.tobytes().translate(_STEPS)
    starts, filled = bytearray(len(levels)), [min(block, n - b * block) for b in range(blocks)]
    for b, size in enumerate(filled):
        i, end = b * width, b * width + size
        while i < end:
            starts[i] = 1
            i += steps[i]
    first = np.flatnonzero(np.frombuffer(starts, np.uint8))
    selectors = _CHOICE[fitting[first]]
    room = _spread(ids, block, np.uint64)
    words = selectors.astype(np.uint64) << np.uint64(60)
    for selector in np.flatnonzero(np.bincount(selectors, minlength=16)):
        rows = np.flatnonzero(selectors == selector)
        at, packed = first[rows], words[rows]
        for i in range(_COUNT[selector]):
            packed |= room[at + i] << np.uint64(i * _WIDTH[selector])
        words[rows] = packed
    return words, np.searchsorted(first, np.arange(blocks) * width)


def _spread(values: np.ndarray, block: int, kind: type) -> np.ndarray:
    """The values with zeros behind each block, as many as a word may hold, and behind all."""
    whole, rest = divmod(len(values), block)
    out = np.zeros((whole + 1, block + _MOST), kind)
    out[:whole, :block] = values[: whole * block].reshape(whole, block)
    out[whole, :rest] = values[whole * block :]
    return out.ravel()


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` ids of a block."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNT[selectors]
    first = np.cumsum(counts) - counts
    ids = np.zeros(int(counts.sum()), np.uint64)
    for selector in np.unique(selectors):
        rows = np.flatnonzero(selectors == selector)
        within = np.arange(_COUNT[selector])
        mask = np.uint64((1 << int(_WIDTH[selector])) - 1)
        ids[first[rows][:, None] + within] = (words[rows][:, None] >> (within * _WIDTH[selector]).astype(np.uint64)) & mask
    return ids[:n]


def segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    runs = [pack_blocks(ids[i : i + 2 * SEGMENT_IDS]) for i in range(0, len(ids), 2 * SEGMENT_IDS)]
    sizes = np.cumsum([0, *[len(words) for words, _ in runs]])
    blocks = [at + size for (_, begins), size in zip(runs, sizes.tolist()) for at in begins.tolist()]
    return b"".join(
        (
            MAGIC,
            np.array([len(doc_ids), len(ids), len(blocks)], "<u4").tobytes(),
            np.array([NO_ID if d is None else d for d in doc_ids], "<i8").tobytes(),
            np.array(lengths, "<u4").tobytes(),
            np.array(blocks, "<u4").tobytes(),
            *[words.astype("<u8").tobytes() for words, _ in runs],
        )
    )


def read_segment(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """Each document's id and token ids."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of packed ids")
    docs, n, blocks = np.frombuffer(data, "<u4", 3, 4).tolist()
    at = 16
    doc_ids = np.frombuffer(data, "<i8", docs, at).tolist()
    lengths = np.frombuffer(data, "<u4", docs, at := at + 8 * docs).tolist()
    offsets = np.frombuffer(data, "<u4", blocks, at := at + 4 * docs).tolist()
    words = np.frombuffer(data[at + 4 * blocks :], "<u8")
    bounds = [*offsets, len(words)]
    ids = [
        unpack(words[bounds[b] : bounds[b + 1]], min(BLOCK_IDS, n - b * BLOCK_IDS)) for b in range(blocks)
    ]
    whole = np.concatenate(ids) if ids else np.zeros(0, np.uint64)
    end = 0
    for doc_id, length in zip(doc_ids, lengths, strict=True):
        end += length
        yield None if doc_id == NO_ID else doc_id, whole[end - length : end]


class WordIds:
    """Ids of words from a tokenizers file.

    The tokenizer drops white space, never joins characters across it, and folds case, so a text's ids are
    those of its words, and a word's those of its core in lower case and of the ASCII marks behind it if
    the core ends in an ASCII letter or digit. With ``special``, the strings of special tokens have those
    tokens' ids, as by the library's default, and a word with one is encoded whole; otherwise they are
    ordinary text. What has been encoded once is looked up: a core, or marks, or another word has a
    number, and numbers have places in one pool of ids. When it is full the half used least makes room."""

    # Marks that are neither letters nor digits, without the apostrophe, which begins contractions.
    MARKS = b""".,!#$%&*|-+()"=<>/:;?@_~[]{}"""

    def __init__(self, path: str, most: int = 450_000, special: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.tokenizer.encode_special_tokens = not special
        added = self.tokenizer.get_added_tokens_decoder().values() if special else ()
        # Looked for in lower case, as a core that is not special may become so by folding it.
        self.special = [t.content.encode().lower() for t in added]
        if any(len(t.split()) != 1 for t in self.special):
            raise ValueError("a special token with white space is in no word")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.most = most
        self.number: dict[bytes, int] = {}
        self.pool, self.start, self.length = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        parts = [list(slices(t)) for t in texts]
        coded = [self._encode(run) for run in _groups(chain.from_iterable(parts))]
        ids = np.concatenate([np.zeros(0, "<u4"), *[found for found, _ in coded]])
        ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *[lengths for _, lengths in coded]]))
        borders = ends[np.cumsum([0, *map(len, parts)])].tolist()
        return [ids[i:j] for i, j in pairwise(borders)]

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts, and how many each has."""
        split = pc.ascii_split_whitespace(pa.array(parts, pa.large_string()))
        cores, marks, marked = self._cut(split.flatten())
        coded = pa.concat_arrays([cores, marks]).dictionary_encode()
        names = _bytes(coded.dictionary)
        numbers = self._numbers(names)
        if len(new := np.flatnonzero(numbers < 0)):
            unknown = [names[i] for i in new.tolist()]
            self._learn(coded.dictionary.take(pa.array(new)), unknown)
            numbers[new] = self._numbers(unknown)
        self.uses[numbers] += 1
        found = numbers[coded.indices.to_numpy()]
        place = np.arange(len(cores) + 1)  # of a core among all, each with its marks behind it
        place[1:] += np.cumsum(marked)
        each = np.empty(len(found), np.int64)
        each[place[:-1]] = found[: len(cores)]
        each[place[1:][marked] - 1] = found[len(cores) :]
        ends = np.concatenate(([0], np.cumsum(self.length[each])))
        ids = self._ids(each)
        if len(self.number) > self.most:
            self._forget()
        return ids, np.diff(ends[place[split.offsets.to_numpy()]])

    def _forget(self) -> None:
        kept = np.sort(np.argsort(self.uses, kind="stable")[len(self.uses) - self.most // 2 :])
        place = dict(zip(kept.tolist(), range(len(kept))))
        self.number = {w: place[n] for w, n in self.number.items() if n in place}
        lengths = self.length[kept]
        ends = np.cumsum(lengths)
        self.pool = self.pool[np.repeat(self.start[kept] - ends + lengths, lengths) + np.arange(lengths.sum())]
        self.start, self.length, self.uses = ends - lengths, lengths, self.uses[kept] // 2

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers, -1 for unknown ones."""
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))

    def _ids(self, numbers: np.ndarray) -> np.ndarray:
        """All ids of the words with these numbers, in this order."""
        offsets = np.append(self.start, len(self.pool))
        return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(self.pool)).take(pa.array(numbers)).flatten().to_numpy()

    def _add(self, words: Iterable[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.number.update(zip(words, range(len(self.start), len(self.start) + len(lengths)), strict=True))
        self.start = np.concatenate((self.start, len(self.pool) + np.cumsum(lengths) - lengths))
        self.length = np.concatenate((self.length, lengths))
        self.uses = np.concatenate((self.uses, np.zeros(len(lengths), np.int64)))
        self.pool = np.concatenate((self.pool, ids.astype("<u4")))

    def _cut(self, words: pa.LargeStringArray) -> tuple[pa.LargeStringArray, pa.LargeStringArray, np.ndarray]:
        """The core of every word, or the word itself; the marks cut off; behind which words there were some."""
        lower = pc.ascii_lower(words)
        cores = pc.ascii_rtrim(lower, characters=self.MARKS.decode())
        offsets, data = _buffers(words)
        kept = np.diff(_buffers(cores)[0])
        cut = (kept > 0) & ~self._special(lower)
        cut[cut] = _ALNUM[data[(offsets[:-1] + kept)[cut] - 1]]
        cores = pc.if_else(pa.array(cut), cores, words)
        marked = cut & (kept < np.diff(offsets))
        behind = (np.diff(offsets) - kept)[marked]
        ends = np.cumsum(behind)
        marks = data[np.repeat(offsets[1:][marked] - ends, behind) + np.arange(behind.sum())]
        ends = np.append(0, ends)
        return cores, pa.LargeStringArray.from_buffers(len(behind), pa.py_buffer(ends), pa.py_buffer(marks)), marked

    def _special(self, lower: pa.LargeStringArray) -> np.ndarray:
        """Which words, in lower case, hold a special token. Most often none does, which one look at all together tells."""
        held = np.zeros(len(lower), bool)
        together = _buffers(lower)[1].tobytes()
        for token in self.special:
            if token in together:
                held |= pc.match_substring(lower, token.decode()).to_numpy(zero_copy_only=False)
        return held

    def _learn(self, words: pa.LargeStringArray, raw: list[bytes]) -> None:
        """Encode words that are new: small letters by the merges alone, other letters in one call, the rest each by itself."""
        special = self._special(pc.ascii_lower(words))
        small = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False) & ~special
        plain, letters, alone = [raw[i] for i in np.flatnonzero(small).tolist()], [], []
        for i in np.flatnonzero(~small).tolist():
            text = raw[i].decode()
            (letters if text.isalpha() and not special[i] else alone).append(text)
        found = [self._plain(plain), *[self._together(letters[i : i + 4096]) for i in range(0, len(letters), 4096)], self._each(alone)]
        ids, lengths = map(np.concatenate, zip(*found))
        self._add(chain(plain, (t.encode() for t in chain(letters, alone))), ids, lengths)

    def _plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words that are normalised and that the pattern would leave whole: by the library's merges of their bytes."""
        spelt = b"\n".join(words).decode("latin-1")
        for byte, letter in _LETTERS.items():
            spelt = spelt.replace(byte, letter)
        return _joined([[t.id for t in self.model.tokenize(w)] for w in spelt.split("\n")] if words else [])

    def _together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters only, in one call: the last id of each is that of a word's end."""
        (found,) = self.tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(stops, prepend=0)) if len(stops) == len(texts) else self._each(texts)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _joined([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])


def _joined(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and how many each list has."""
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(chain.from_iterable(found), "<u4", lengths.sum()), lengths


def _buffers(strings: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings begin and the last one ends, and the bytes of all."""
    _, offsets, data = strings.buffers()
    if not len(strings):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return offsets, np.frombuffer(data or b"", np.uint8)


def _bytes(strings: pa.LargeStringArray) -> list[bytes]:
    offsets, data = _buffers(strings)
    whole = data.tobytes()
    return [whole[i:j] for i, j in pairwise(offsets.tolist())]


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """One per Python worker and file, so later tasks find its words encoded."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if path not in _encoders:
        _encoders[path] = WordIds(path, special=True)
    return _encoders[path]


def slices(text: str, most: int = 1 << 20) -> Iterator[str]:
    """The text in parts that end at a blank, of ``most`` characters as far as blanks allow."""
    at = 0
    while len(text) - at > most:
        cut = text.find(" ", at + most)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def _groups(texts: Iterable[str], most: int = 1 << 22) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


_SEGMENTS = "shard int, segment int, documents int, ids bigint, data binary"


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every text (NULL: empty), append ``end_id``, and write shards in ascending id order to ``path``.

    NULL ids come first; rows with one id stand in the order of a hash of their texts. An empty table
    writes no segment. Other columns are ignored."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, shard, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4")
        doc_ids, lengths, parts, size = [], [], [], 0

        def full() -> pa.RecordBatch:
            data = segment(doc_ids, lengths, np.concatenate(parts))
            return pa.RecordBatch.from_pylist(
                [{"shard": shard, "segment": number, "documents": len(doc_ids), "ids": size, "data": data}],
                schema=pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("documents", pa.int32()), ("ids", pa.int64()), ("data", pa.binary())]),
            )

        for batch in batches:
            keys, texts, at = batch.column(0).to_pylist(), (t.as_py() or "" for t in batch.column(1)), 0
            for group in _groups(texts):
                for ids in ids_of.encode(group):
                    doc_ids.append(keys[at])
                    at += 1
                    lengths.append(len(ids) + 1)
                    parts += (ids, end)
                    size += lengths[-1]
                    if size >= SEGMENT_IDS:
                        yield full()
                        doc_ids, lengths, parts, size = [], [], [], 0
                        number += 1
        if doc_ids:
            yield full()

    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    (
        docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(encode, _SEGMENTS)
        .write.mode("overwrite")
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, start (ids before it), n_tokens, ids_crc32."""
    segments = spark.read.parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                found = list(read_segment(data.as_py()))
                ends = np.cumsum([0, *[len(ids) for _, ids in found]])
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([shard.as_py()] * len(found), pa.int32()),
                        "segment": pa.array([number.as_py()] * len(found), pa.int32()),
                        id_col: pa.array([d for d, _ in found], pa.int64()),
                        "within": pa.array(ends[:-1], pa.int64()),
                        "n_tokens": pa.array([len(ids) for _, ids in found], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in found], pa.int64()),
                    }
                )

    schema = f"shard int, segment int, {id_col} bigint, within bigint, n_tokens bigint, ids_crc32 bigint"
    found = segments.select("shard", "segment", "data").mapInArrow(decode, schema)
    return found.join(segment_starts(segments), ["shard", "segment"]).select(
        id_col, (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )


def segment_starts(segments: DataFrame) -> DataFrame:
    """shard, segment, before: the ids in all earlier segments. The last window has a row per shard."""
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    shards = segments.groupBy("shard").agg(F.sum("ids").alias("all"))
    shards = shards.select("shard", F.coalesce(F.sum("all").over(earlier(Window.orderBy("shard"))), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("ids").over(earlier(Window.partitionBy("shard").orderBy("segment"))), F.lit(0))
    return (
        segments.select("shard", "segment", inside.alias("inside"))
        .join(shards, "shard")
        .select("shard", "segment", (F.col("base") + F.col("inside")).alias("before"))
    )
