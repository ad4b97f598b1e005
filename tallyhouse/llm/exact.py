"""Exact duplicates by deterministic block naming.

Every text is cut into blocks of equal size. Distinct blocks are sorted and numbered, so a block has
one integer name; then distinct pairs of adjacent names are sorted and numbered, and so on until
each text has a single name. Names are given to contents, never to hashes: two texts share a name if
and only if they are equal. Whole blocks are shuffled once, to be sorted. Afterwards a text refers to
its blocks by a 64-bit digest, and blocks of different content that share a digest (counted over all
blocks) are looked up by content instead.
"""

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.llm.common import SharedFolder, ascii_lower, keyed

BLOCK_BYTES = 4096


def _numbered(distinct: DataFrame, by: list[str], name: str) -> DataFrame:
    """Sorted in their partitions and numbered; to be written before use."""
    return distinct.sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id())


def _blocks(text: Column, size: int) -> Column:
    data = text.cast("binary")
    last = F.greatest(F.lit(0), F.ceil(F.length(data) / size).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _key(digest: Callable[[Column], Column], block: Column) -> Column:
    # The length is part of it: a block and its prefix never meet.
    return F.struct(digest(block).alias("h"), F.length(block).alias("n"))


def exact_duplicates(
    docs: DataFrame,
    folder: SharedFolder,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    digest: Callable[[Column], Column] = F.xxhash64,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are the same after A-Z become lower case; NULL counts as empty. The row with
    the largest id of a group stays (NULL ids are smallest); of repeated rows with that id one stays.
    An empty table gives an empty result. ``carry`` names columns of ``docs`` to pass on, others are ignored."""
    rows = keyed(docs, "row", id=id_col, text=text_col, **{f"carry_{c}": c for c in carry}).withColumn("text", ascii_lower(F.col("text")))
    cut = _blocks(F.col("text"), block_bytes)
    distinct = rows.select(F.explode(cut).alias("block")).distinct()
    numbered = _numbered(distinct, ["block"], "name").select(_key(digest, F.col("block")).alias("key"), "name")
    per_key = folder.keep(
        folder.keep(numbered, "block-names").groupBy("key").agg(F.min("name").alias("name"), F.count("*").alias("n")),
        "block-keys",
    )
    shared = per_key.filter("n > 1").select("key")
    hard = not shared.isEmpty()
    if hard:  # different blocks share a digest: row numbers are needed twice, so they must be written
        rows = folder.keep(rows, "whole-texts")
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / block_bytes)).cast("int")
    texts = folder.keep(
        rows.select(
            "row", "id", F.sha2("text", 256).alias("sha"), count.alias("blocks"),
            F.transform(cut, lambda b: _key(digest, b)).alias("keys"), *[f"carry_{c}" for c in carry],
        ),
        "texts",
    )
    refs = texts.select("row", "blocks", F.posexplode("keys").alias("pos", "key"))
    parts = refs.join(per_key.filter("n = 1").select("key", "name"), "key").select("row", "blocks", "pos", "name")
    if hard:
        parts = parts.unionByName(_named_by_content(rows.select("row", count.alias("blocks"), F.posexplode(cut).alias("pos", "block")), shared, digest, folder))
    identity = folder.keep(_named(folder.keep(parts, "parts"), folder).join(texts.drop("keys", "blocks"), "row"), "identities")
    groups = folder.keep(
        identity.groupBy("level", "name").agg(F.max(F.struct("id", "row")).alias("keep"), F.count("*").alias("group_size")),
        "groups",
    )
    return identity.join(groups, ["level", "name"]).select(
        F.col("id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *[F.col(f"carry_{c}").alias(c) for c in carry],
    )


def _named_by_content(contents: DataFrame, shared: DataFrame, digest, folder: SharedFolder) -> DataFrame:
    """Names of the blocks whose digest has several contents; negative, so that they differ from the others."""
    hard = contents.withColumn("key", _key(digest, F.col("block"))).join(shared, "key", "left_semi")
    numbered = _numbered(hard.select("block").distinct(), ["block"], "k")
    names = folder.keep(numbered.select("block", (-1 - F.col("k")).alias("name")), "hard-blocks")
    return hard.join(names, "block").select("row", "blocks", "pos", "name")


def _named(parts: DataFrame, folder: SharedFolder) -> DataFrame:
    """row, level, name: adjacent names are paired until one is left. The level tells lengths apart."""
    done = [parts.filter("blocks = 1").select("row", F.lit(0).alias("level"), "name")]
    most = parts.select(F.max("blocks")).first()[0] or 1
    # Texts of 2^(k-1) + 1 to 2^k blocks have one name after k rounds.
    rounds = F.length(F.bin(F.col("blocks") - 1))
    open_ = parts.filter("blocks > 1").withColumn("rounds", rounds).drop("blocks")
    for level in range(1, (most - 1).bit_length() + 1):
        second = F.col("pos") % 2 == 1
        pairs = folder.keep(
            open_.groupBy("row", "rounds", F.shiftright("pos", 1).alias("pos")).agg(
                F.max(F.when(~second, F.col("name"))).alias("left"), F.max(F.when(second, F.col("name"))).alias("right")
            ),
            "pairs",
        )
        distinct = pairs.select("left", "right").distinct()
        number = folder.keep(_numbered(distinct, ["left", "right"], "name"), "pair-names")
        same = (pairs["left"] == number["left"]) & pairs["right"].eqNullSafe(number["right"])
        named = folder.keep(pairs.join(number, same).select("row", "rounds", "pos", "name"), "open")
        done.append(named.filter(F.col("rounds") == level).select("row", F.lit(level).alias("level"), "name"))
        open_ = named.filter(F.col("rounds") > level)
    return reduce(DataFrame.unionByName, done)
