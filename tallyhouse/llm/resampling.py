"""Importance resampling towards a target distribution.

Documents and target texts are bags of hashed n-grams. A bucket's gain says how much likelier it is in the target;
a document's weight is the sum of the gains of its features, read from one array. Weights plus Gumbel noise make a
draw without replacement the same as taking the highest scores. How high is found by bisection: jobs
that count persisted scores halve the range of the cutoff, several times each, then that of the ids tied at it.
Only rows above the cutoff are sorted, by range, for their ranks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.llm.common import SharedFolder
from tallyhouse.operators.ordering import global_row_number

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
PIECE_BYTES = 1 << 20
CUTS = 15  # per count job: four halvings

# Letters and digits of ASCII, A-Z in lower case, and all of UTF-8 beyond ASCII are words; the rest separates.
_FOLD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b > 127 else 32 for b in range(256))


def _hashes(text: str | None, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """Piece by piece of a text: its words, and the crc32 of all n-grams that end in it.

    The crc of an n-gram goes on from that of the one a word shorter."""
    data = text.encode().translate(_FOLD) if text else b""
    begin, kept = 0, []
    while begin < len(data):
        end = data.find(b" ", begin + PIECE_BYTES)
        end = len(data) if end < 0 else end
        new = data[begin:end].split()
        words, n, begin = kept + new, len(kept), end
        spaced = [b" " + w for w in words[1:]]
        crcs = list(map(crc32, words))
        found = [crcs[n:]]
        for k in range(1, longest):
            crcs = list(map(crc32, spaced[k - 1 :], crcs))
            found.append(crcs[max(0, n - k) :])
        kept = words[len(words) - longest + 1 :] if 1 < longest <= len(words) else words[: longest - 1]
        yield len(new), np.fromiter(chain.from_iterable(found), np.uint32, sum(map(len, found)))


def bucket_counts(texts: DataFrame, text_col: str, buckets: int = BUCKETS, longest: int = LONGEST) -> list[int]:
    """How many features of all texts fall into each bucket. A task sends a row per bucket that it has seen."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, hashes in _hashes(text.as_py(), longest):
                    seen += np.bincount(hashes % buckets, minlength=buckets)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at])], names=["bucket", "n"])

    out = [0] * buckets
    found = texts.select(texts[text_col].alias("text")).mapInArrow(count, "bucket int, n bigint")
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of add-one shares, per bucket."""
    b = len(source)
    all_source, all_target = float(sum(source) + b), float(sum(target) + b)
    return [math.floor(1000 * math.log((t + 1) * all_source / ((s + 1) * all_target))) for s, t in zip(source, target, strict=True)]


def weights(rows: DataFrame, gain: list[int], longest: int) -> DataFrame:
    """row, id, n_words, n_features, weight of row, id, text; the array of gains goes with the tasks."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(gain, np.int64)
        for batch in batches:
            found = np.zeros((3, len(batch)), np.int64)
            for i, text in enumerate(batch.column("text")):
                for n_words, hashes in _hashes(text.as_py(), longest):
                    found[:, i] += (n_words, len(hashes), int(table[hashes % len(table)].sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), *map(pa.array, found)], names=["row", "id", "n_words", "n_features", "weight"]
            )

    return rows.mapInArrow(weigh, "row bigint, id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(id_: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variable that depends on the id alone."""
    ticket = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    share = (ticket.cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(share)))


def border(rows: DataFrame, column: str, wanted: int) -> tuple[int, int, int]:
    """The least value that ``wanted`` rows do not exceed, the rows below it, and the rows up to it.

    Every job counts the rows up to ``CUTS`` values between the bounds, exactly, and keeps one gap."""
    least, most, up_to = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    below = 0
    while least < most:
        cuts = sorted({least + (most - least) * k // (CUTS + 1) for k in range(1, CUTS + 1)})
        inside = rows.filter(F.col(column).between(least, most))
        counted = inside.agg(*[F.count_if(F.col(column) <= c).alias(f"c{k}") for k, c in enumerate(cuts)]).first()
        totals = [below + c for c in counted]
        for cut, total in zip(cuts, totals):
            if total >= wanted:
                most, up_to = cut, total
                break
            least, below = cut + 1, total
    return least, below, up_to


def highest(rows: DataFrame, order: list[str], wanted: int) -> Column:
    """Which rows are the first ``wanted`` by integer columns, the last of which is unique."""
    chosen, tied = F.lit(False), F.lit(True)
    for column in order:
        value, below, up_to = border(rows.filter(tied), column, wanted)
        if up_to == wanted:
            return chosen | (tied & (F.col(column) <= value))
        chosen = chosen | (tied & (F.col(column) < value))
        tied, wanted = tied & (F.col(column) == value), wanted - below
    raise ValueError("the last column of the order must be unique")


def resample(
    docs: DataFrame,
    target: DataFrame,
    folder: SharedFolder,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_features, weight, score, rank (NULL if not drawn).

    Of the documents with at least ``least_words`` words, ``percent`` of a hundred (rounded down) are drawn, the
    highest scores first, ties by id (integer), NULL ids last, then by the place in the table. A NULL or empty
    text has no words: weight 0, never drawn (unless ``least_words`` is 0). Repeated rows each count and have
    one score. Long texts are hashed in pieces of a megabyte; a task holds one text and its piece. An empty table
    gives an empty result, an empty target one whose gains only follow how rare a bucket is. Other columns are
    ignored, whatever their names."""
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_col, buckets, longest))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    scored = weights(rows, gain, longest).select(
        "*", (F.col("weight") + noise(F.col("id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("open")
    )
    # Highest score first: its negative is the first key.
    scored = scored.select("*", (-F.col("score")).alias("k1"), F.col("id").isNull().cast("int").alias("k2"), F.coalesce("id", F.lit(0)).alias("k3"), F.col("row").alias("k4"))
    scored = folder.keep(scored, "scored")
    order = ["k1", "k2", "k3", "k4"]
    wanted = percent * scored.filter("open").count() // 100
    drawn = F.col("open") & (highest(scored.filter("open"), order, wanted) if wanted else F.lit(False))
    ranked = global_row_number(scored.filter(drawn), [F.col(k) for k in order], "rank", folder)
    out = ranked.unionByName(scored.filter(~drawn).withColumn("rank", F.lit(None).cast("bigint")))
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", F.col("rank").cast("bigint").alias("rank"))
