"""Substring dedup by level-wise doubling: passages that occur earlier in the corpus are cut out.

A window of 20 words can only be repeated if every shorter window inside it is. So windows of five words
come first; 20-word windows whose five-word parts are repeated are candidates, of which ten-word windows
are counted next, and so on: each length is made from two windows of half of it, only where the shorter one
was repeated, until the full length is reached or no candidate survives. Per length and candidate one
shorter window stands for the rest, the one with the least hash: equal candidates agree on it.

Documents are sorted by id and packed into chunks, a table dealt by chunk that is never shuffled again.
What goes through a shuffle are hashes, each once per chunk, dealt into buckets by value; back come bits,
one per hash sent. A passage that every document has costs one hash per chunk.

Hashes of shorter windows only choose candidates. Windows of full length are equal if 96 bits from two
independent hashes are: with 10^12 different candidates the chance of any mistake is about 10^-5. All
hashes are sums over bytes or words, made in numpy; no word becomes an object.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tallyhouse.llm.common import SharedFolder

WINDOW, START = 20, 5
CHUNK_BYTES = 4 << 20

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_RADIX = 0xD1342543DE82EF95
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
# What each byte adds to a hash, one row for each of two hashes; blanks add nothing.
_BYTES = np.where(_BLANK, 0, np.random.default_rng(20).integers(1 << 63, size=(2, 256), dtype=np.uint64) | np.uint64(1)).astype(np.uint64)
_BLOCK = 1 << 20


class _Powers:
    """Powers of an odd number modulo 2^64 and their inverses, as many as have been asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.multiply.accumulate(np.append(np.uint64(1), np.full(size - 1, x, np.uint64))) for x in (_RADIX, pow(_RADIX, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _mixed(x: np.ndarray) -> np.ndarray:
    """In place: each bit depends on all."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(_ODD[2])
    x ^= x >> np.uint64(29)
    return x


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    out = right << np.uint64(31)
    out |= right >> np.uint64(33)
    out *= np.uint64(_ODD[1])
    out += left * np.uint64(_ODD[0])
    return _mixed(out)


def _doubled(names: np.ndarray, length: int, wanted: int) -> np.ndarray:
    """Names of windows of ``wanted`` words from those of ``length`` words."""
    while 2 * length <= wanted:
        names, length = _joined(names[:-length], names[length:]), 2 * length
    rest = wanted - length
    return _joined(names[:-rest], names[rest:]) if rest else names


def _sliding(pick: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """``pick`` (least or largest) of every ``width`` neighbours."""
    step = 1
    while 2 * step <= width:
        values, step = pick(values[:-step], values[step:]), 2 * step
    rest = width - step
    return pick(values[:-rest], values[rest:]) if rest else values


def levels(window: int, start: int) -> list[int]:
    """The lengths before the full one: start, twice that, ..."""
    out = [start]
    while 2 * out[-1] < window:
        out.append(2 * out[-1])
    return [n for n in out if n < window]


def _borders(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of sorted hashes, and where each begins (with the end of the last)."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    found, first = np.unique(bucket, return_index=True)
    return found, np.append(first, len(hashes))


class Chunk:
    """Documents in order, as one row of words."""

    def __init__(self, texts: pa.StringArray, window: int):
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data = data[offsets[0] : offsets[-1]]
        self.borders = offsets.astype(np.int64) - offsets[0]
        inside = np.append(~_BLANK[self.data], False)
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        borders = self.borders[:-1]
        begins[borders] = inside[borders]  # a word at the end of a document ends with it
        self.begins = np.flatnonzero(begins)
        self.at = np.searchsorted(self.begins, self.borders)  # the words of document i are at[i] to at[i + 1]
        self.window, self.n = window, len(self.begins)
        last = np.repeat(self.at[1:], np.diff(self.at))
        # Windows that no end of a document cuts.
        self.open = (np.arange(self.n) + window <= last)[: max(0, self.n - window + 1)]
        self.length, self.names = 0, np.zeros(0, np.uint64)

    def _hashes(self, row: int) -> np.ndarray:
        """Of each word, made for blocks of bytes that hold whole words."""
        parts, first = [], 0
        while first < self.n:
            begin = self.begins[first]
            end = max(first + 1, int(np.searchsorted(self.begins, begin + _BLOCK)))
            stop = self.begins[end] if end < self.n else len(self.data)
            at = self.begins[first:end] - begin
            up, down = _powers(int(stop - begin))
            parts.append(np.add.reduceat(_BYTES[row][self.data[begin:stop]] * up, at) * down[at])
            first = end
        return _mixed(np.concatenate([np.zeros(0, np.uint64), *parts]))

    def _named(self, length: int) -> np.ndarray:
        """Names of all windows of ``length`` words; made from those asked for before."""
        if not self.length or self.length > length:
            self.length, self.names = 1, self._hashes(0)
        if self.length < length:
            self.length, self.names = length, _doubled(self.names, self.length, length)
        return self.names

    def stand_ins(self, length: int, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per window its stand-in of ``length`` words; the distinct ones of candidates; those at two places."""
        names = self._named(length) | np.uint64(1)
        width = self.window - length + 1
        least = _sliding(np.minimum, names, width)
        edge = np.zeros(width - 1, np.uint64)
        around = np.concatenate((edge, np.where(candidates, least, np.uint64(0)), edge))
        # A place is taken if it is the least of a candidate around it, that is of the one with the largest least.
        distinct, times = np.unique(names[_sliding(np.maximum, around, width) == names], return_counts=True)
        return least, distinct, times > 1

    def narrowed(self, length: int, candidates: np.ndarray, reply: list[dict] | None, buckets: int) -> np.ndarray:
        """The candidates whose stand-in of ``length`` words is repeated, by the bits that came back."""
        least, distinct, _ = self.stand_ins(length, candidates)
        alive = np.append(_bits(reply, distinct, buckets), False)
        runs = np.flatnonzero(np.append(True, least[1:] != least[:-1]))  # neighbours share their stand-in
        kept = alive[np.searchsorted(distinct, least[runs])]
        return candidates & np.repeat(kept, np.diff(np.append(runs, len(least))))

    def full(self, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Candidates sorted by content, then place: places, two hashes, and which are the first of their kind."""
        places = np.flatnonzero(candidates)
        high = self._named(self.window)[places]
        up, down = _powers(self.n)
        sums = np.append(np.uint64(0), np.cumsum(self._hashes(1) * up))
        low = (((sums[places + self.window] - sums[places]) * down[places]) >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((low, high))
        places, high, low = places[order], high[order], low[order]
        new = np.ones(len(places), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        return places, high, low, new

    def gone(self, again: np.ndarray) -> np.ndarray:
        """Which words the windows at these places cover."""
        begin = np.zeros(self.n + self.window, np.int64)
        begin[again + self.window] = 1
        so_far = np.cumsum(begin)
        return so_far[self.window :] > so_far[: self.n]

    def spans(self, gone: np.ndarray) -> Iterator[tuple[int, list[list[int]], bytes]]:
        """Per document its words, the spans of words that go, and the others, joined by blanks."""
        data = self.data.tobytes()
        for i in range(len(self.at) - 1):
            a, b = self.at[i], self.at[i + 1]
            steps = np.flatnonzero(np.diff(gone[a:b], prepend=False, append=False)).tolist()
            text = data[self.borders[i] : self.borders[i + 1]]
            if steps:
                # What stays lies between the spans.
                edges = [0, *steps, int(b - a)]
                place = lambda k: int(self.begins[a + k] if a + k < b else self.borders[i + 1])
                text = b" ".join(data[place(x) : place(y)] for x, y in zip(edges[::2], edges[1::2], strict=True) if x < y)
            yield int(b - a), [steps[k : k + 2] for k in range(0, len(steps), 2)], b" ".join(text.split())


def _bits(reply: list[dict] | None, hashes: np.ndarray, buckets: int) -> np.ndarray:
    """What all buckets say, one bit per sorted hash."""
    sizes = np.diff(_borders(hashes, buckets)[1])
    parts = [np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=int(n)) for r, n in zip(reply or [], sizes, strict=True)]
    return np.concatenate([np.zeros(0, np.uint8), *parts]).astype(bool)


def chunks(docs: DataFrame, folder: SharedFolder, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """chunk, ids, texts: documents by id, packed; later chunks have larger numbers."""
    id_kind = docs.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        waiting: list[pa.RecordBatch] = []
        size = 0

        def full() -> pa.RecordBatch:
            nonlocal number, size
            rows = pa.Table.from_batches(waiting).combine_chunks()
            columns = [rows.column(k).combine_chunks() for k in range(2)]
            ends = pa.array([0, len(rows)], pa.int32())
            row = [pa.array([number], pa.int64()), *(pa.ListArray.from_arrays(ends, c) for c in columns)]
            number, size = number + 1, 0
            waiting.clear()
            return pa.RecordBatch.from_arrays(row, names=["chunk", "ids", "texts"])

        for batch in batches:
            lengths = [len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(1).cast(pa.binary())]
            begin = 0
            for i, n in enumerate(lengths):
                if size and size + n > chunk_bytes:
                    waiting.append(batch.slice(begin, i - begin))
                    yield full()
                    begin = i
                size += n + 1
            waiting.append(batch.slice(begin))
        if any(len(b) for b in waiting):
            yield full()

    order = [F.col("id").asc_nulls_last(), F.xxhash64("text")]
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    packed = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        pack, f"chunk bigint, ids array<{id_kind}>, texts array<string>"
    )
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return folder.keep_bucketed(packed, "chunks", buckets, "chunk")


def _opened(
    batches: Iterator[pa.RecordBatch], lengths: Sequence[int], window: int, buckets: int
) -> Iterator[tuple[pa.RecordBatch, int, Chunk, np.ndarray]]:
    """Each chunk: where it stands, its words, and its candidates after the replies for ``lengths``."""
    for batch in batches:
        texts = batch.column("texts")
        for i in range(len(batch)):
            chunk = Chunk(texts[i].values, window)
            candidates = chunk.open
            for length in lengths:
                if not candidates.any():
                    break
                candidates = chunk.narrowed(length, candidates, batch.column(f"bits_{length}")[i].as_py(), buckets)
            yield batch, i, chunk, candidates


def _asked(known: DataFrame, lengths: Sequence[int], length: int, window: int, buckets: int) -> DataFrame:
    """bucket, chunk, data: the distinct hashes of a chunk's candidates, at ``length`` words."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, chunk, candidates in _opened(batches, lengths, window, buckets):
            if not candidates.any():
                continue
            if length < window:
                _, hashes, twice = chunk.stand_ins(length, candidates)
                parts = [(hashes & ~np.uint64(1)) | twice]  # the last bit says: twice in this chunk
            else:
                _, hashes, low, new = chunk.full(candidates)
                hashes = hashes[new]
                parts = [hashes, low[new]]
            found, at = _borders(hashes, buckets)
            data = [b"".join(p[a:b].tobytes() for p in parts) for a, b in zip(at[:-1], at[1:], strict=True)]
            number = np.full(len(found), batch.column("chunk")[i].as_py())
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int32()), pa.array(number), pa.array(data, pa.binary())], names=["bucket", "chunk", "data"]
            )

    return known.mapInArrow(ask, "bucket int, chunk bigint, data binary")


def _answered(asked: DataFrame, buckets: int, full: bool) -> DataFrame:
    """chunk, bucket, bits, alive: which hashes are repeated (at ``full`` length: which an earlier chunk has), and how many."""
    kind = np.dtype("<u8"), np.dtype("<u4")
    width = kind[0].itemsize + full * kind[1].itemsize

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, asked_schema)
        if not len(table):
            return
        blobs = [x.as_py() for x in table.column("data")]
        owners = table.column("chunk").to_numpy()
        sizes = np.array([len(x) // width for x in blobs])
        high = np.concatenate([np.frombuffer(x, kind[0], n) for x, n in zip(blobs, sizes, strict=True)])
        if full:
            low = np.concatenate([np.frombuffer(x, kind[1], n, 8 * n) for x, n in zip(blobs, sizes, strict=True)])
            order = np.lexsort((np.repeat(owners, sizes), low, high))
            again = np.zeros(len(order), bool)
            again[1:] = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
        else:
            order = np.argsort(high)
            same = high[order][1:] >> np.uint64(1) == high[order][:-1] >> np.uint64(1)
            again = (high[order] & np.uint64(1)).astype(bool)
            again[1:] |= same
            again[:-1] |= same
        yes = np.zeros(len(order), bool)
        yes[order] = again
        parts = np.split(yes, np.cumsum(sizes)[:-1])
        bits = pa.array([np.packbits(part).tobytes() for part in parts], pa.binary())
        alive = pa.array([int(part.sum()) for part in parts], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [table.column("chunk").combine_chunks(), table.column("bucket").combine_chunks(), bits, alive],
            names=["chunk", "bucket", "bits", "alive"],
        )

    asked_schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary())])
    return asked.repartitionById(buckets, F.col("bucket")).mapInArrow(answer, "chunk bigint, bucket int, bits binary, alive bigint")


def _with_replies(known: DataFrame, replies: DataFrame, length: int) -> DataFrame:
    """Each chunk with the bits of its buckets, in order; replies are dealt like the chunks, which stay where they are."""
    bits = F.array_sort(F.collect_list(F.struct("bucket", "bits")))
    return known.join(replies.groupBy("chunk").agg(bits.alias(f"bits_{length}")).hint("shuffle_hash"), "chunk", "left")


def cut_repeats(
    docs: DataFrame,
    folder: SharedFolder,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    start: int = START,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, cut (spans [first, end) of words), kept (the other words).

    A word goes if a window of ``window`` words over it begins earlier, too: in a document with a smaller id
    or further up in the same one. NULL ids come after all others; rows with one id are ordered by a hash of
    their texts, and of equal rows all but one lose what they share. A NULL, blank or short text (fewer words
    than a window) has no window and loses nothing. Long texts are never split: a task holds one chunk, that
    is ``chunk_bytes`` or the longest text, about twenty times over. An empty table gives an empty result.
    Other columns are ignored, whatever their names."""
    if not 0 < start <= window:
        raise ValueError("start must be between 1 and window")
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = chunks(docs, folder, id_col, text_col, chunk_bytes)
    done: list[int] = []
    for length in [*levels(window, start), window]:
        asked = _asked(known, list(done), length, window, buckets)
        replies = folder.keep(_answered(asked, buckets, length == window), f"replies-{length}")
        known = _with_replies(known, replies, length)
        done.append(length)
        if not replies.agg(F.sum("alive")).first()[0]:
            break  # no candidate survives
    narrow = [n for n in done if n < window]
    kinds = known.schema["ids"].dataType.elementType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, chunk, candidates in _opened(batches, narrow, window, buckets):
            again = np.zeros(0, np.int64)
            if candidates.any():
                places, hashes, _, new = chunk.full(candidates)
                earlier = _bits(batch.column(f"bits_{window}")[i].as_py(), hashes[new], buckets)
                again = places[~new | earlier[np.cumsum(new) - 1]]
            found = list(chunk.spans(chunk.gone(again)))
            pairs = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("ids")[i].values,
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([sum(b - a for a, b in spans) for _, spans, _ in found], pa.int64()),
                    pa.array([[{"first": a, "end": b} for a, b in spans] for _, spans, _ in found], pairs),
                    pa.array([kept for _, _, kept in found], pa.binary()).cast(pa.string()),
                ],
                names=["id", "n_words", "n_removed", "cut", "kept"],
            )

    schema = f"id {kinds}, n_words bigint, n_removed bigint, cut array<struct<first: bigint, end: bigint>>, kept string"
    return known.mapInArrow(cut, schema).withColumnRenamed("id", id_col)
