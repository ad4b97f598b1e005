"""SimHash near-duplicates by exact comparison of tiles of fingerprints.

Every distinct fingerprint is compared with every other one that can be near. Fingerprints are sorted by
the population counts of their halves and quarters and cut into tiles; bits differ in at least as many
places as population counts do, so pairs of tiles whose counts differ by more than the radius are
skipped, first between tiles by a join on the counts, then between parts of tiles. What is left is
compared by exclusive-or and bit counts. A pair of tiles yields a spanning forest of its links, so a
large group of near copies gives as many edges as it has members, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.llm.common import SharedFolder, keyed, words

SHINGLE, RADIUS, SEED = 3, 3, 42
TILE, PART = 8192, 256
QUARTERS = (0, 16, 32, 48)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if it is in over half of the hashes of the shingles, repeats included."""
    from xxhash import xxh64_intdigest

    found = words(text)
    if not found:
        return 0
    if len(found) < shingle:
        shingles, n = iter([b" ".join(found)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(found[k:] for k in range(shingle)))), len(found) - shingle + 1
    counts = np.zeros(64, np.int64)
    for start in range(0, n, 1 << 16):
        size = min(1 << 16, n - start)
        hashes = np.fromiter((xxh64_intdigest(next(shingles), seed) for _ in range(size)), "<u8", size)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str, shingle: int, seed: int) -> DataFrame:
    """The other columns of ``docs`` and fp, a 64-bit integer."""
    others = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(0)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps.view(np.int64))], names=[*others, "fp"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select(text, *others).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "fp bigint"]))


def _counts(fps: np.ndarray) -> np.ndarray:
    """Population counts of the quarters, a column each."""
    return np.stack([np.bitwise_count((fps >> np.uint64(q)) & np.uint64(0xFFFF)) for q in QUARTERS], axis=1).astype(np.int16)


def tiles(fps: DataFrame, size: int = TILE) -> DataFrame:
    """tile, high, low (counts of the halves, the same all over a tile), least and most (counts of quarters), data."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        rest = np.zeros(0, np.uint64)

        def full(part: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            counts = _counts(part)
            number += 1
            row = {
                "tile": number, "high": int(counts[0, 2:].sum()), "low": int(counts[0, :2].sum()),
                "least": counts.min(axis=0).tolist(), "most": counts.max(axis=0).tolist(), "data": part.astype("<u8").tobytes(),
            }
            ints = pa.list_(pa.int32())
            return pa.RecordBatch.from_pylist([row], pa.schema([("tile", pa.int64()), ("high", pa.int32()), ("low", pa.int32()), ("least", ints), ("most", ints), ("data", pa.binary())]))

        for batch in batches:
            rest = np.concatenate((rest, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            halves = _counts(rest)[:, 2:].sum(axis=1) * 64 + _counts(rest)[:, :2].sum(axis=1)
            borders = np.flatnonzero(np.diff(halves)) + 1
            runs = np.split(rest, borders)
            rest = runs.pop()  # may go on in the next batch
            for run in runs:
                for i in range(0, len(run), size):
                    yield full(run[i : i + size])
            while len(rest) > size:
                yield full(rest[:size])
                rest = rest[size:]
        if len(rest):
            yield full(rest)

    # shiftrightunsigned, so that the top half has no sign
    part = lambda at, mask: F.bit_count(F.shiftrightunsigned("fp", at).bitwiseAND(F.lit(mask)))
    order = [part(32, 0xFFFFFFFF), part(0, 0xFFFFFFFF), part(0, 0xFFFF), part(32, 0xFFFF), F.col("fp")]
    sorted_ = fps.select("fp").repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_.mapInArrow(cut, "tile bigint, high int, low int, least array<int>, most array<int>, data binary")


def _apart(a: str, b: str) -> Column:
    """At least so many bits differ between two tiles, by the counts of quarters."""
    gaps = [
        F.greatest(F.lit(0), F.col(f"{a}least")[k] - F.col(f"{b}most")[k], F.col(f"{b}least")[k] - F.col(f"{a}most")[k])
        for k in range(len(QUARTERS))
    ]
    return sum(gaps[1:], gaps[0])


def tile_pairs(tiled: DataFrame, radius: int) -> DataFrame:
    """Pairs of tiles (a <= b) that may hold near fingerprints."""
    steps = [(h, w) for h in range(-radius, radius + 1) for w in range(-radius, radius + 1) if abs(h) + abs(w) <= radius]
    near = F.explode(F.array(*[F.struct((F.col("high") + h).alias("h"), (F.col("low") + w).alias("w")) for h, w in steps]))
    a = tiled.select(F.col("tile").alias("a"), F.col("least").alias("a_least"), F.col("most").alias("a_most"), near.alias("cell"))
    b = tiled.select(F.col("tile").alias("b"), F.col("least").alias("b_least"), F.col("most").alias("b_most"), F.struct(F.col("high").alias("h"), F.col("low").alias("w")).alias("cell"))
    return a.join(b, "cell").filter((F.col("a") <= F.col("b")) & (_apart("a_", "b_") <= radius)).select("a", "b")


class _Forest:
    """Sets of joined items; says which links joined two sets."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def _flat(self) -> np.ndarray:
        while not np.array_equal(up := self.root[self.root], self.root):
            self.root = up
        return self.root

    def join(self, i: np.ndarray, j: np.ndarray) -> list[int]:
        """Positions of the links that were needed."""
        needed = []
        while True:
            root = self._flat()
            ri, rj = root[i], root[j]
            open_ = np.flatnonzero(ri != rj)
            if not len(open_):
                return needed
            # Per larger root the first link from it: these never close a circle.
            high, low = np.maximum(ri[open_], rj[open_]), np.minimum(ri[open_], rj[open_])
            roots, first = np.unique(high, return_index=True)
            root[roots] = low[first]
            needed += open_[first].tolist()


def links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles, or within one if ``b`` is None."""
    same = b is None
    b = a if same else b
    forest = _Forest(len(a) if same else len(a) + len(b))
    boxes = []
    for fps in (a, b):
        counts, starts = _counts(fps), np.arange(0, len(fps), PART)
        boxes.append((np.minimum.reduceat(counts, starts), np.maximum.reduceat(counts, starts)))
    (a_least, a_most), (b_least, b_most) = boxes
    gaps = np.maximum(a_least[:, None] - b_most[None], b_least[None] - a_most[:, None])
    near = np.maximum(gaps, 0).sum(axis=2) <= radius
    left, right = [], []
    for p, q in np.argwhere(np.triu(near) if same else near):
        part, other = a[p * PART : (p + 1) * PART], b[q * PART : (q + 1) * PART]
        i, j = np.nonzero(np.bitwise_count(part[:, None] ^ other[None]) <= radius)
        if same and p == q:
            i, j = i[i < j], j[i < j]
        if len(i):
            i, j = i + p * PART, j + q * PART
            needed = forest.join(i, j if same else j + len(a))
            left.append(a[i[needed]])
            right.append(b[j[needed]])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def edges(tiled: DataFrame, radius: int, folder: SharedFolder) -> DataFrame:
    """u > v: links that join all fingerprints within ``radius``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x, y in zip(*batch.columns, strict=True):
                first = np.frombuffer(x.as_py(), "<u8")
                second = None if a.as_py() == b.as_py() else np.frombuffer(y.as_py(), "<u8")
                u, v = (z.view(np.int64) for z in links(first, second, radius))
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    pairs = folder.keep(tile_pairs(tiled.drop("data"), radius), "tile-pairs")
    data = lambda name, value: tiled.select(F.col("tile").alias(name), F.col("data").alias(value))
    work = pairs.join(data("a", "x"), "a").join(data("b", "y"), "b").select("a", "b", "x", "y")
    return work.mapInArrow(compare, "u bigint, v bigint").distinct()


def components(found: DataFrame, folder: SharedFolder) -> DataFrame:
    """node, component (its smallest node), for every node of the edges u > v but the smallest of each.

    Large and small stars in turns: the nodes of a component end at its smallest one."""
    state = None
    found = folder.keep(found, "edges")
    while True:
        both = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = folder.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = folder.keep(large.filter("u != v").distinct(), "large-stars")
        least = folder.keep(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        found = folder.keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-stars")
        now = found.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return found.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now


def near_duplicates(
    docs: DataFrame,
    folder: SharedFolder,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    seed: int = SEED,
    tile: int = TILE,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (hexadecimal), component_id, kept.

    component_id is the smallest id that links reach; that row stays (one of them if rows are repeated).
    NULL and blank texts have fingerprint zero and link like any other. NULL ids come after all others. An
    empty table gives an empty result. ``carry`` names columns to pass on, others are ignored."""
    rows = keyed(docs, "row", id=id_col, text=text_col, **{f"carry_{c}": c for c in carry})
    marked = folder.keep(fingerprints(rows, "text", shingle, seed), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    distinct = folder.keep(marked.groupBy("fp").agg(first.alias("first")), "distinct")
    tiled = folder.keep(tiles(distinct, tile), "tiles")
    stars = components(edges(tiled, radius, folder), folder)
    label = distinct.join(stars, distinct["fp"] == stars["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    label = folder.keep(label, "labels")
    least = folder.keep(label.groupBy("component").agg(F.min("first").alias("least")), "components")
    known = folder.keep(label.join(least, "component").select("fp", "least"), "known")
    return marked.join(known, "fp").select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("least.id").alias("component_id"),
        (F.col("row") == F.col("least.row")).alias("kept"),
        *[F.col(f"carry_{c}").alias(c) for c in carry],
    )
