"""Row numbers, NTILE and running sums over a global order, without a single-task window.

A window without PARTITION BY, or with one huge partition, moves its rows into one task. Here the
rows are range-partitioned on the whole order instead, so the slices stay even whatever the
distribution of the leading column, and each slice is handled on its own. What crosses a slice
border is one carried value per slice, taken from a frame that has at most one row per shuffle
partition; that frame is the only thing broadcast.

Running sums keep their slices in a table bucketed so that bucket i is slice i. Spark knows that, so the
window over a slice needs no second shuffle of the rows. Where only a few places of the order matter
(the borders of tiles, the first rows), narrow keys are sorted or a range is counted, never the rows.

``order`` must be total (end it with a unique key): the slices are written to the shared folder
once, so retries and later reads see the same split.
"""

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyhouse.sources.shared import SharedFolder

_SLICE, _POS, _TAIL, _LOCAL, _CARRY, _KEY = "__slice", "__pos", "__tail", "__local", "__carry", "__key"


def _sliced(df: DataFrame, order: Sequence[Column], slices: int | None) -> DataFrame:
    """Range-partition and sort; tag each row with its slice and its 1-based place in it."""
    ranged = df.repartitionByRange(slices, *order) if slices else df.repartitionByRange(*order)
    # monotonically_increasing_id: partition number in the upper bits, row in the lower 33.
    return (
        ranged.sortWithinPartitions(*order)
        .withColumn("__id", F.monotonically_increasing_id())
        .withColumn(_SLICE, F.shiftright("__id", 33).cast("int"))
        .withColumn(_POS, F.col("__id").bitwiseAND(F.lit(2**33 - 1)) + 1)
        .drop("__id")
    )


def _slice_keys(df: DataFrame, slices: int) -> DataFrame:
    """A number per slice that Spark's hash sends to the bucket of the slice's own number."""
    # So many numbers that no bucket is missed: the chance is below slices * e^-40.
    tried = df.sparkSession.range(40 * slices + 1000).select(F.col("id").cast("int").alias(_KEY))
    return tried.groupBy(F.pmod(F.hash(_KEY), F.lit(slices)).alias(_SLICE)).agg(F.min(_KEY).alias(_KEY))


def _keep_slices(
    df: DataFrame, order: Sequence[Column], folder: SharedFolder, slices: int | None
) -> DataFrame:
    """The sliced rows as a table whose bucket i, and so task i of a scan, is slice i."""
    conf = df.sparkSession.conf
    wanted = slices or int(conf.get("spark.sql.shuffle.partitions"))
    buckets = min(wanted, int(conf.get("spark.sql.sources.bucketing.maxBuckets")))
    sliced = _sliced(df, order, slices and buckets if wanted == buckets else buckets)
    keyed = sliced.join(F.broadcast(_slice_keys(df, buckets)), _SLICE)
    return folder.keep_bucketed(keyed, "sliced", buckets, _KEY, one_per_task=True)


def _ranked(
    df: DataFrame, order: Sequence[Column], folder: SharedFolder, slices: int | None
) -> DataFrame:
    """Add ``__r`` (global row number) and ``__n`` (row count)."""
    kept = folder.keep(_sliced(df, order, slices), "ranked")
    by_slice = Window.orderBy(_SLICE)
    before = F.sum("__rows").over(by_slice.rowsBetween(Window.unboundedPreceding, -1))
    offsets = (
        kept.groupBy(_SLICE)
        .agg(F.max(_POS).alias("__rows"))
        .select(
            _SLICE,
            F.coalesce(before, F.lit(0)).alias("__before"),
            F.sum("__rows").over(Window.partitionBy()).alias("__n"),
        )
    )
    return (
        kept.join(F.broadcast(offsets), _SLICE)
        .withColumn("__r", F.col("__before") + F.col(_POS))
        .drop(_SLICE, _POS, "__before")
    )


def global_row_number(
    df: DataFrame, order: Sequence[Column], name: str, folder: SharedFolder, slices: int | None = None
) -> DataFrame:
    """ROW_NUMBER() OVER (ORDER BY order): dense, from 1."""
    return _ranked(df, order, folder, slices).withColumnRenamed("__r", name).drop("__n")


def global_ntile(
    df: DataFrame,
    buckets: int,
    order: Sequence[Column],
    name: str,
    folder: SharedFolder,
    slices: int | None = None,
) -> DataFrame:
    """NTILE(buckets) OVER (ORDER BY order), from the row number and the row count."""
    ranked = _ranked(df, order, folder, slices)
    return ranked.withColumn(name, tile("__r", "__n", buckets)).drop("__r", "__n")


def tile(place: str, rows: str, buckets: int) -> Column:
    """The NTILE bucket of a place (from 1) among all rows, as SQL names or numbers."""
    small, larger = f"({rows} div {buckets})", f"({rows} % {buckets})"
    bucket = F.expr(
        f"""CASE WHEN {place} <= {larger} * ({small} + 1) THEN ({place} - 1) div ({small} + 1) + 1
                 ELSE {larger} + ({place} - 1 - {larger} * ({small} + 1)) div {small} + 1 END"""
    )
    return bucket.cast("int")


@dataclass(frozen=True)
class Key:
    """A column to order by, with a place for NULLs."""

    name: str
    descending: bool = False
    nulls_first: bool = False

    def order(self, name: str | None = None) -> Column:
        c = F.col(name or self.name)
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()

    def after(self, value: object) -> Column:
        """Whether a row comes strictly after ``value`` by this column."""
        c = F.col(self.name)
        if value is None:
            return c.isNotNull() if self.nulls_first else F.lit(False)
        beyond = F.coalesce(c < F.lit(value) if self.descending else c > F.lit(value), F.lit(False))
        return beyond if self.nulls_first else beyond | c.isNull()


def _after(keys: Sequence[Key], border: Sequence[object]) -> Column:
    """Whether a row comes strictly after the row with these values."""
    out = F.lit(False)
    for key, value in reversed(list(zip(keys, border, strict=True))):
        out = key.after(value) | (F.col(key.name).eqNullSafe(F.lit(value)) & out)
    return out


def tile_ends(rows: int, buckets: int) -> list[int]:
    """The last place (from 1) of every NTILE bucket that has a later one with rows."""
    small, larger = divmod(rows, buckets)
    ends = {small * k + min(k, larger) for k in range(1, buckets)}
    return sorted(e for e in ends if 0 < e < rows)


def ntile_scores(
    df: DataFrame, buckets: int, scores: Mapping[str, Key], tiebreak: Key, folder: SharedFolder
) -> DataFrame:
    """NTILE(buckets) OVER (ORDER BY key, tiebreak) for each of ``scores``, for few buckets.

    A score says how many borders of buckets a row has passed. The borders are looked up in one sorted table
    for all scores, which holds their keys only; the rows themselves are neither sorted nor numbered.
    (key, tiebreak) must be unique; ``df`` is read twice, so it should be a table."""
    names = list(scores)
    kinds = {f.name: f.dataType for f in df.schema}

    def entry(i: int) -> Column:
        values = [
            (F.col(scores[n].name) if k == i else F.lit(None).cast(kinds[scores[n].name])).alias(f"v{k}")
            for k, n in enumerate(names)
        ]
        return F.struct(F.lit(i).alias("score"), *values, F.col(tiebreak.name).alias("tie"))

    keys = df.select(F.inline(F.array(*map(entry, range(len(names))))))
    order = [F.col("score").asc(), *(scores[n].order(f"v{k}") for k, n in enumerate(names)), tiebreak.order("tie")]
    kept = folder.keep(_sliced(keys, order, None), "keys")
    sizes = kept.groupBy(_SLICE).agg(F.max(_POS).alias("n")).orderBy(_SLICE).collect()  # one row per slice
    rows = sum(r["n"] for r in sizes) // len(names)
    wanted = [i * rows + end for i in range(len(names)) for end in tile_ends(rows, buckets)]
    at, before = F.lit(False), 0
    for r in sizes:
        inside = [w - before for w in wanted if before < w <= before + r["n"]]
        if inside:
            at = at | ((F.col(_SLICE) == r[_SLICE]) & F.col(_POS).isin(inside))
        before += r["n"]
    found = kept.filter(at).collect() if wanted else []
    passed = {n: F.lit(1) for n in names}
    for r in found:
        name = names[r["score"]]
        border = (r[f"v{r['score']}"], r["tie"])
        passed[name] = passed[name] + _after([scores[name], tiebreak], border).cast("int")
    return df.withColumns(passed)


def first_rows(
    df: DataFrame, value: str, tiebreak: str, share: tuple[int, int], name: str, folder: SharedFolder, spare: float = 0.002
) -> tuple[DataFrame, int]:
    """The rows in the first ``share`` (part, whole) tiles of the order ``value`` descending, then ``tiebreak``,
    numbered, and the number of all rows.

    A sketch of the values proposes a bound, an exact count of the rows above it accepts or lowers it, and
    only those rows are sorted. ``df`` is read three times, so it should be a table."""
    part, whole = share
    rows = df.count()
    wanted = rows // whole * part + min(part, rows % whole)
    above, margin = df, max(spare, 1.0 / max(rows, 1))
    while rows and wanted / rows + margin < 1:
        at = 1 - wanted / rows - margin
        bound = df.agg(F.percentile_approx(value, F.lit(at), F.lit(math.ceil(4 / margin)))).first()[0]
        candidate = df.filter(F.col(value) >= F.lit(bound)) if bound is not None else df
        if candidate.count() >= wanted:
            above = candidate
            break
        margin *= 4
    order = [F.col(value).desc_nulls_last(), F.col(tiebreak).asc_nulls_first()]
    return global_row_number(above, order, name, folder).filter(F.col(name) <= wanted), rows


def _same_group(left: DataFrame, right: DataFrame, within: Sequence[str]) -> Column:
    same = left[_SLICE] == right["__in"]
    for c in within:
        same = same & left[c].eqNullSafe(right[f"__g_{c}"])
    return same


def _carried(kept: DataFrame, step: Column, within: Sequence[str]) -> DataFrame:
    """What a slice's first group already has in earlier slices: at most one row per slice.

    Rows are sorted by group first, so only the last group of a slice can continue in the next."""
    tails = kept.groupBy(_SLICE).agg(step.alias(_TAIL))
    if within:
        last = F.max_by(F.struct(*within), F.col(_POS)).alias("last")
        last_groups = kept.groupBy(F.col(_SLICE).alias("__in")).agg(last).select(
            "__in", *[F.col("last")[c].alias(f"__g_{c}") for c in within]
        )
        in_last_group = kept.join(
            F.broadcast(last_groups), _same_group(kept, last_groups, within), "left_semi"
        )
        tails = in_last_group.groupBy(_SLICE, *within).agg(step.alias(_TAIL))
    so_far = Window.partitionBy(*within).orderBy(_SLICE)
    return tails.select(
        F.lead(_SLICE).over(Window.orderBy(_SLICE)).alias("__in"),
        *[F.col(c).alias(f"__g_{c}") for c in within],
        F.sum(_TAIL).over(so_far.rowsBetween(Window.unboundedPreceding, 0)).alias(_CARRY),
    ).filter("__in IS NOT NULL")


def _accumulated(
    df: DataFrame,
    step: Column,
    within: Sequence[str],
    order: Sequence[Column],
    name: str,
    folder: SharedFolder,
    slices: int | None,
    in_order: bool = False,
) -> DataFrame:
    """Accumulate the aggregate ``step`` inside each slice and add what earlier slices carry over.

    One shuffle: by range into slices. With ``in_order`` the result is sorted by (within, order) at no
    further cost: task i holds slice i, and the window leaves its rows in that order."""
    groups = [F.col(c).asc_nulls_first() for c in within]
    kept = _keep_slices(df, [*groups, *order], folder, slices)
    carried = _carried(kept, step, within)

    # All rows of a key are one slice; the key is what the table is dealt by.
    rows_so_far = (
        Window.partitionBy(_KEY, *within)
        .orderBy(_POS)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = kept.withColumn(_LOCAL, step.over(rows_so_far))
    # NULL only while neither side has seen a value.
    total = F.coalesce(F.col(_LOCAL) + F.col(_CARRY), F.col(_LOCAL), F.col(_CARRY))
    summed = local.join(F.broadcast(carried), _same_group(local, carried, within), "left")
    summed = summed.withColumn(name, total)
    if in_order:
        summed = summed.sortWithinPartitions(_SLICE, _POS)
    return summed.select(*df.columns, name)


def grouped_row_number(
    df: DataFrame,
    within: Sequence[str],
    order: Sequence[Column],
    name: str,
    folder: SharedFolder,
    slices: int | None = None,
) -> DataFrame:
    """ROW_NUMBER() OVER (PARTITION BY within ORDER BY order), across slices like a running sum, so
    that no group has to fit in one task."""
    return _accumulated(df, F.count(F.lit(1)), within, order, name, folder, slices)


def running_sum(
    df: DataFrame,
    value: str,
    order: Sequence[Column],
    name: str,
    folder: SharedFolder,
    within: Sequence[str] = (),
    slices: int | None = None,
    in_order: bool = False,
) -> DataFrame:
    """SUM(value) OVER (PARTITION BY within ORDER BY order ROWS UNBOUNDED PRECEDING)."""
    return _accumulated(df, F.sum(value), within, order, name, folder, slices, in_order)


def peer_totals(
    df: DataFrame, value: str, name: str, folder: SharedFolder, slices: int | None = None
) -> DataFrame:
    """One row per distinct ``value``: ``peers`` rows share it and add up to ``peer_sum``; ``name``
    is SUM(value) OVER (ORDER BY value DESC) with its default RANGE frame."""
    per_value = df.groupBy(value).agg(
        F.count(F.lit(1)).alias("peers"), F.sum(value).alias("peer_sum")
    )
    largest_first = [F.col(value).desc_nulls_last()]
    return running_sum(per_value, "peer_sum", largest_first, name, folder, slices=slices)


def peers_within(
    df: DataFrame, value: str, share: str, folder: SharedFolder, slices: int | None = None
) -> int:
    """How many rows have a RANGE running sum (largest first) of at most ``share`` of the sum of all.

    Each slice gives its totals; they add up to the sum of all and to what comes before each slice. Largest
    first, a running sum rises and then may fall, so a slice lies whole within the share, or whole beyond it,
    or it is crossed; only crossed slices, two at most, are added up row by row."""
    per_value = df.groupBy(value).agg(
        F.count(F.lit(1)).alias("__peers"), F.coalesce(F.sum(value), F.lit(0)).alias("__sum")
    )
    kept = folder.keep(_sliced(per_value, [F.col(value).desc_nulls_last()], slices), "values")
    so_far = Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    totals = kept.groupBy(_SLICE).agg(
        F.sum("__peers").alias("n"),
        F.sum("__sum").alias("own"),
        F.sum(F.greatest(F.col("__sum"), F.lit(0))).alias("rise"),
        F.min_by("__sum", _POS).alias("first"),
        F.max(value).isNotNull().alias("known"),
    ).withColumns(
        {"before": F.coalesce(F.sum("own").over(so_far), F.lit(0)), "all": F.sum("own").over(Window.partitionBy())}
    )
    cut = F.lit(share).cast("decimal(18,6)") * F.col("all")
    lowest = F.col("before") + F.least(F.col("first"), F.col("own"))
    judged = totals.withColumn("cut", cut).select(
        "*",
        (F.col("before") + F.col("rise") <= F.col("cut")).alias("inside"),
        (lowest > F.col("cut")).alias("outside"),
        F.max("known").over(Window.partitionBy()).alias("any_known"),
    ).collect()  # one row per slice
    if not judged or not judged[0]["any_known"]:
        return 0
    count = sum(r["n"] for r in judged if r["inside"])
    for r in judged:
        if not r["inside"] and not r["outside"]:
            rows = Window.orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
            added = kept.filter(F.col(_SLICE) == r[_SLICE]).withColumn("s", F.sum("__sum").over(rows) + F.lit(r["before"]))
            count += added.filter(F.col("s") <= F.lit(r["cut"])).agg(F.coalesce(F.sum("__peers"), F.lit(0))).first()[0]
    return count


def running_sum_with_peers(
    df: DataFrame, value: str, name: str, folder: SharedFolder, slices: int | None = None
) -> DataFrame:
    """Each row of ``df`` with its RANGE running sum; equal values share one result."""
    totals = peer_totals(df, value, name, folder, slices).select(F.col(value).alias("__value"), name)
    return df.join(totals, df[value].eqNullSafe(totals["__value"])).drop("__value")
