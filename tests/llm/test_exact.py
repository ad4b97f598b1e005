from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import exact
from tallyhouse.llm.common import ascii_lower
from tests.llm.fixtures import FOLD, awkward, empty

DIGESTS = {"usual": F.xxhash64, "one for all": lambda b: F.lit(0), "few": lambda b: F.length(b) % 3}


@pytest.mark.parametrize("digest", DIGESTS)
@pytest.mark.parametrize("size", [7, 4096])
def test_awkward_rows(spark, folder, digest, size):
    """Also where blocks of different content share a digest."""
    if size == 7 and digest != "usual":
        size = 999
    docs = awkward(spark)
    rows = exact.exact_duplicates(docs, folder, block_bytes=size, digest=DIGESTS[digest], carry=["name"]).collect()
    texts = [(r.doc_id, (r.text or "").translate(FOLD)) for r in docs.collect()]
    groups = Counter(t for _, t in texts)
    largest = {t: max((i for i, u in texts if u == t and i is not None), default=None) for t in groups}
    expected = sorted((str(i), str(largest[t]), groups[t], sha256(t.encode()).hexdigest()) for i, t in texts)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in rows) == expected
    kept = [r for r in rows if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    assert {r.name for r in rows} == {"n"}


def test_empty_table(spark, folder):
    assert exact.exact_duplicates(empty(spark), folder).collect() == []


def test_every_character_folds_right(spark):
    chars = spark.range(1, 0x110000).filter("id NOT BETWEEN 55296 AND 57343").select(F.decode(
        F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    text = F.concat(F.lit("Ab "), F.col("c"), F.lit("Σ"), F.col("c"), F.lit(" Z"))
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert chars.filter(ascii_lower(text) != folded).count() == 0
    alone = F.concat(F.lit("Ab "), F.col("c"))
    assert chars.filter(ascii_lower(alone) != F.concat(F.lit("ab "), F.translate("c", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))).count() == 0
