"""Small awkward tables, and brute-force versions."""

import re

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

LONG = " ".join(f"word{i % 977} Straße é{i % 31}," for i in range(6000))
SENTENCE = "The quick brown fox jumps over the lazy dog while seven wizards quietly bake their bread in old ovens."
TEXTS = [
    None, "", " \t\r\n\x0b\x0c ", "one", "One", "ONE", "two words", "three words here", "Äpfel ÄPFEL äpfel", "äpfel ÄPFEL äpfel",
    SENTENCE, SENTENCE, SENTENCE.upper(), SENTENCE + " x", LONG, LONG + " end", "a\n\na\nb\na", " em space no-break",
    "İstanbul ǅ ⅷ Ⅷ ß ẞ 🙂🙂 é", "# * $ % & | < >", "!!! " * 30, "same words again " * 40,
    "mail a.b@c.de or +1 (555) 010-9999, 10.0.0.256 and 10.0.0.255, 4111 1111 1111 1111.",
]


def awkward(spark: SparkSession) -> DataFrame:
    """Texts in all sources, a NULL source, NULL and repeated ids, a repeated row, and names that might clash."""
    rows = [(i if i % 9 else None, t, ["b", "a", None, "ä"][i % 4]) for i, t in enumerate(TEXTS)]
    rows += [rows[10], rows[10], (1000, SENTENCE, "b"), (3, "another text under id three", "a")]
    kept = [(*r, 7, "r", True, "n") for r in rows]
    return spark.createDataFrame(
        kept, "doc_id bigint, text string, source string, row int, fp string, kept boolean, name string"
    )


def empty(spark: SparkSession) -> DataFrame:
    return awkward(spark).limit(0)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(FOLD))


def key(row) -> tuple:
    return tuple((v is None, str(v)) for v in row)
