import numpy as np
import pytest
import xxhash

from tallyhouse.llm import simhash
from tests.llm.fixtures import TEXTS, awkward, empty, words


def slow_fingerprint(text):
    w = words(text)
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= radius:
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("tile", [2, 8192])
def test_awkward_rows(spark, folder, tile):
    docs = awkward(spark)
    rows = simhash.near_duplicates(docs, folder, tile=tile, carry=["text"]).collect()
    source = docs.collect()
    fps = [slow_fingerprint(r.text) for r in source]
    root = groups(fps, 3)
    least = {g: min((source[i].doc_id for i in range(len(root)) if root[i] == g and source[i].doc_id is not None), default=None) for g in root}
    expected = sorted((str(r.doc_id), f"{f:016x}", str(least[g])) for r, f, g in zip(source, fps, root))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows) == expected
    assert sum(r.kept for r in rows) == len(set(root))


def test_empty_table(spark, folder):
    assert simhash.near_duplicates(empty(spark), folder).collect() == []


def near_copies(rng, centers, copies):
    fps = set()
    for c in rng.integers(0, 2**63, centers, dtype=np.uint64).tolist():
        for _ in range(copies):
            f = c
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                f ^= 1 << int(b)
            fps.add(f)
    return sorted(fps, key=lambda f: f * 2654435761 % 2**32)


@pytest.mark.parametrize("tile", [16, 100, 8192])
def test_tiles_lose_no_link(spark, folder, tile):
    fps = near_copies(np.random.default_rng(tile), 30, 12)
    signed = [f - (f >> 63 << 64) for f in fps]
    tiled = folder.keep(simhash.tiles(spark.createDataFrame([(f,) for f in signed], "fp bigint"), tile), "tiles")
    found = {r.node: r.component for r in simhash.components(simhash.edges(tiled, 3, folder), folder).collect()}
    ours, true = [found.get(f, f) for f in signed], groups(fps, 3)
    assert len(set(zip(ours, true))) == len(set(true)) == len(set(ours))


def test_a_long_chain_is_one_component(spark, folder):
    n = 300
    chain = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(1001, 1000)], "u bigint, v bigint")
    found = {r.node: r.component for r in simhash.components(chain, folder).collect()}
    assert found == {i: 0 for i in range(1, n + 1)} | {1001: 1000}


def test_a_forest_has_no_circles():
    fps = np.array(near_copies(np.random.default_rng(9), 3, 400), np.uint64)
    u, _ = simhash.links(fps, None, 3)
    assert len(u) == len(fps) - len(set(groups(fps.tolist(), 3)))
