"""A training corpus from raw documents: filter, deduplicate, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns to
the shared folder and hands it to the next. All but the last return the columns of ``docs``, whatever
these are; doc_id, text and source are used. Documents may be NULL in any column or repeated; an empty
table stays empty."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyhouse.llm import byte_pairs, exact, mixing, rules, simhash
from tallyhouse.llm.queries import word_count
from tallyhouse.sources.shared import SharedFolder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table under names that nothing clashes with, and the new name of each old one."""
    names = {c: f"doc_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _original(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*[docs[new].alias(old) for old, new in names.items()])


def _marked(docs: DataFrame, folder: SharedFolder) -> tuple[DataFrame, dict[str, str]]:
    """Written with a mark per row, so that what is decided finds its row even among equal ones."""
    plain, names = _renamed(docs)
    return folder.keep(plain.withColumn("mark", F.monotonically_increasing_id()), "marked"), names


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    plain, names = _renamed(docs)
    judged = rules.cascade(plain, id_col=names["doc_id"], text_col=names["text"], pass_on=[*names.values()])
    return _original(judged.filter("kept"), names)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    folder = SharedFolder.of(spark)
    marked, names = _marked(docs, folder)
    found = exact.exact_duplicates(marked, folder, names["doc_id"], names["text"], carry=["mark"])
    return _original(marked.join(found.filter("kept").select("mark"), "mark", "left_semi"), names)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest id stays."""
    folder = SharedFolder.of(spark)
    marked, names = _marked(docs, folder)
    found = simhash.near_duplicates(marked, folder, names["doc_id"], names["text"], carry=["mark"])
    return _original(marked.join(found.filter("kept").select("mark"), "mark", "left_semi"), names)


def _words(text: Column, first: str, end: str) -> Column:
    """The words [first, end) of a text with the blanks behind each; the whole text if it has no others."""
    starts = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])", -1)
    # Blanks before the first word are a part of their own.
    lead = F.when(starts[0].rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    part = F.array_join(F.slice(starts, F.col(first).cast("int") + 1 + lead, (F.col(end) - F.col(first)).cast("int")), "")
    return F.when(F.col(end) - F.col(first) == F.col("size"), text).otherwise(part)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; one that a block border cuts comes with the words inside."""
    folder = SharedFolder.of(spark)
    marked, names = _marked(docs, folder)
    text = names["text"]
    mixed = mixing.mix(
        marked, folder, word_count(marked[text]), id_col=names["doc_id"], source_col=names["source"], carry=["mark"]
    ).filter("taken > 0")
    taken = marked.join(mixed.drop(names["doc_id"], names["source"]), "mark")
    pieces = F.array(*[F.when(F.col(f"to_{k}") > F.col(f"from_{k}"), _words(F.col(text), f"from_{k}", f"to_{k}")) for k in (1, 2)])
    copies = F.concat(F.array_repeat(F.col(text), F.col("rounds").cast("int")), F.filter(pieces, lambda p: p.isNotNull()))
    out = taken.withColumn("copy", F.explode(copies))
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        changed = F.when(F.col("copy") == F.col(text), F.col(names["n_chars"])).otherwise(F.char_length("copy").cast(kind))
        out = out.withColumn(names["n_chars"], changed)
    return _original(out.withColumn(text, F.col("copy")), names)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids (little-endian 32-bit integers), and digests of the ids and of the decoded text."""
    coded = byte_pairs.byte_pair_ids(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "token_ids",
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("mixing sources to target weights", mixing_sources),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

# SQL has neither the 64-bit hash of the fingerprints nor byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = SharedFolder.of(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = folder.keep(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs
