"""Mixing sources to target weights: equal blocks, apportioned by the highest quotients.

The mix is a number of blocks of equally many words. Blocks are dealt to sources, and then to the
shards of a source, to the highest quotients target / (2k + 1), k being the blocks a source has
already. Only the quotients near the border are written out: what a source gets at least and at
most follows from its share, and the two differ by about its share of the number of sources.

In a shard, documents stand in a seeded order that is one long stream of words. A shard takes all
its blocks as often as its quota allows and the rest as a run of blocks from a seeded place on;
as the order of documents is random already, a run is a random choice that cuts two documents only.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyhouse.llm.common import SharedFolder, keyed

WEIGHTS = (3, 1, 2)
SHARE, TIMES = 1.5, 2.0
BLOCK = 64
SHARD, MOST_SHARDS = 1 << 16, 1 << 16
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, times: float) -> DataFrame:
    """Per source: place (code point order, NULL last), weight, source_size, target in words.

    ``share`` of all words is divided by weight; a target stops at ``times`` its source, and what is
    above goes to the others by weight. Sources reach their limit in the order of limit to weight."""
    place = Window.orderBy(F.col("source").asc_nulls_last())
    each = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    sources = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(place))
        .withColumn("weight", each)
        .withColumn("limit", F.col("source_size") * times)
    )
    before = Window.orderBy(F.col("limit") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    nothing = F.lit(0)
    full = F.col("limit") * (F.col("weights") - F.col("weights_before")) <= F.col("weight") * (
        F.col("total") - F.col("limits_before")
    )
    return (
        sources.withColumn("weights_before", F.coalesce(F.sum("weight").over(before), nothing))
        .withColumn("limits_before", F.coalesce(F.sum("limit").over(before), nothing))
        .withColumn("weights", F.sum("weight").over(all_))
        .withColumn("total", F.sum("source_size").over(all_) * share)
        .withColumn("full", full)
        .withColumn("left", F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(all_), nothing))
        .withColumn("left_weight", F.sum(F.when(~F.col("full"), F.col("weight"))).over(all_))
        .withColumn(
            "target",
            F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * F.col("left") / F.col("left_weight")),
        )
        .select("source", "place", "weight", "source_size", "target", "total")
    )


def apportion(parts: DataFrame, within: Sequence[str], want: str, seats: Column, most: Column, order: str) -> DataFrame:
    """Add ``quota``: ``seats`` per group dealt to the highest quotients want / (2k + 1).

    Ties go to the smaller ``order``; no part gets more than ``most``. With n parts the divisor lies between
    sum / (seats + n/2) and sum / (seats - n/2), which gives each part's least and largest quota."""
    group = Window.partitionBy(*within)
    share = F.when(F.col("_sum") > 0, F.col(want) / F.col("_sum")).otherwise(F.lit(0.0))
    least = F.greatest(F.lit(0), F.ceil(share * (F.col("_seats") - F.col("_parts") / 2) - 1.5).cast("long"))
    largest = F.floor(share * (F.col("_seats") + F.col("_parts") / 2) + 1.5).cast("long")
    bounded = (
        parts.withColumn("_sum", F.sum(want).over(group))
        .withColumn("_parts", F.count("*").over(group))
        .withColumn("_seats", seats)
        .withColumn("_most", F.when(F.col(want) > 0, F.least(most, largest)).otherwise(F.lit(0)))
        .withColumn("_least", F.least(least, F.col("_most")))
        .withColumn("_open", F.col("_seats") - F.sum("_least").over(group))
    )
    k = F.explode_outer(
        F.when(F.col("_most") > F.col("_least"), F.sequence("_least", F.col("_most") - 1))
    )
    highest = Window.partitionBy(*within).orderBy(F.desc("_quotient"), order)
    won = F.coalesce((F.row_number().over(highest) <= F.col("_open")) & F.col("_k").isNotNull(), F.lit(False))
    return (
        bounded.withColumn("_k", k)
        .withColumn("_quotient", F.coalesce(F.col(want) / (2 * F.col("_k") + 1), F.lit(-1.0)))
        .withColumn("_won", won.cast("long"))
        .groupBy(*parts.columns)
        .agg((F.max("_least") + F.sum("_won")).alias("quota"))
    )


def _overlap(start: Column, end: Column) -> list[Column]:
    """Where a document, at ``at`` in its shard's stream, is inside [start, end): from and to, in its words."""
    at, size = F.col("at"), F.col("size")
    low = F.greatest(F.lit(0), F.least(size, start - at))
    return [low, F.greatest(low, F.least(size, end - at))]


def mix(
    docs: DataFrame,
    folder: SharedFolder,
    size: Column,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    times: float = TIMES,
    block: int = BLOCK,
    shard_size: int = SHARD,
    most_shards: int = MOST_SHARDS,
    seed: str = SEED,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, taken, and where it is taken.

    ``size`` is the number of words, as an expression of ``docs``. The document is in the mix ``rounds``
    times as a whole, and its words [from_1, to_1) and [from_2, to_2) once more; ``taken`` adds these up.
    A NULL source is a source like any other, the last one; a NULL id is ordered like an empty one;
    repeated rows each take their own place. Documents without words take nothing, an empty table gives
    an empty result. ``carry`` names columns of ``docs`` to pass on; others are ignored."""
    ticket = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    sized = folder.keep(
        docs.select(
            docs[id_col].alias("id"), docs[source_col].alias("source"), size.cast("long").alias("size"),
            ticket.alias("ticket"), *[docs[c].alias(f"carry_{c}") for c in carry],
        ),
        "sizes",
    )
    sources = source_targets(sized, weights, share, times)
    blocks = lambda words: F.ceil(F.col(words) / block).cast("long")
    limit = F.ceil(times * blocks("source_size")).cast("long")
    shards = F.least(F.lit(most_shards), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_size))).cast("long")
    sources = folder.keep(
        apportion(sources, [], "target", F.floor(F.max("total").over(Window.partitionBy()) / block + 0.5).cast("long"), limit, "place")
        .withColumn("shards", shards),
        "sources",
    )
    first_digits = F.conv(F.substring("ticket", 1, 8), 16, 10).cast("long")
    by_source = sized["source"].eqNullSafe(sources["source"])
    placed = sized.join(sources, by_source).select(
        sized["*"], "place", "source_size", "target", "quota", (first_digits % F.col("shards")).alias("shard")
    )
    per_shard = placed.groupBy("place", "shard").agg(
        F.sum("size").alias("shard_size"), F.max("quota").alias("source_quota")
    )
    quotas = apportion(
        per_shard, ["place"], "shard_size", F.col("source_quota"), F.ceil(times * blocks("shard_size")).cast("long"), "shard"
    )
    n, rest = blocks("shard_size"), F.col("quota") - F.col("rounds") * F.col("n")
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "place", "shard")), 1, 8), 16, 10).cast("long")
    runs = (
        quotas.withColumn("n", F.greatest(n, F.lit(1)))
        .withColumn("rounds", F.floor(F.col("quota") / F.col("n")).cast("long"))
        .withColumn("start", start % F.col("n"))
        .withColumn("rest", rest)
        .select(
            F.col("place").alias("run_place"), F.col("shard").alias("run_shard"), "rounds", "quota",
            (F.col("start") * block).alias("begin"),
            (F.least(F.col("start") + F.col("rest"), F.col("n")) * block).alias("stop"),
            (F.greatest(F.lit(0), F.col("start") + F.col("rest") - F.col("n")) * block).alias("stop_2"),
        )
    )
    stream = Window.partitionBy("place", "shard").orderBy("ticket", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = placed.drop("quota").withColumn("at", F.coalesce(F.sum("size").over(stream), F.lit(0)))
    joined = ordered.join(runs, (F.col("place") == F.col("run_place")) & (F.col("shard") == F.col("run_shard")))
    from_1, to_1 = _overlap(F.col("begin"), F.col("stop"))
    from_2, to_2 = _overlap(F.lit(0), F.col("stop_2"))
    return joined.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        (F.col("rounds") * F.col("size") + to_1 - from_1 + to_2 - from_2).alias("taken"),
        "rounds", from_1.alias("from_1"), to_1.alias("to_1"), from_2.alias("from_2"), to_2.alias("to_2"),
        *[F.col(f"carry_{c}").alias(c) for c in carry],
    )
