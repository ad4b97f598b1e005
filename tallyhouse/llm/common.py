"""What several of these operators share."""

from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.sources.shared import SharedFolder

__all__ = ["LOWER", "UPPER", "WORD", "SharedFolder", "ascii_lower", "keyed", "words"]

# A word, and the letters that are folded.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# Any letter beyond ASCII that lower() would change, or that it may know and regular expressions don't.
_OTHER_CAPITAL = r"[\p{IsUppercase}\p{Lt}\p{Cn}&&[^\x00-\x7F]]"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is.

    lower() is many times faster than translate() and does the same while no other capital occurs."""
    text = F.coalesce(text, F.lit(""))
    plain = (F.octet_length(text) == F.char_length(text)) | ~text.rlike(_OTHER_CAPITAL)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: str | None) -> list[bytes]:
    """The words of a text with A-Z in lower case, as UTF-8: bytes know ASCII cases and blanks only."""
    return text.encode().lower().split() if text else []


def keyed(docs: DataFrame, row: str, **columns: str) -> DataFrame:
    """The named columns under new names, and a row number ``row`` that tells repeated rows apart.

    Only fit to be written before use: the number depends on how the table is read."""
    picked = docs.select(*[docs[old].alias(new) for new, old in columns.items()])
    return picked.withColumn(row, F.monotonically_increasing_id())
