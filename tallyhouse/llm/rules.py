"""Quality rules as a short-circuit cascade.

A document is kept if no rule rejects it, so the order of rules cannot change a verdict, only the
work: what each rule costs and rejects is measured on a sample, and rules that reject much for little
go first. A document is not looked at further once a rule has rejected it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from time import perf_counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
SAMPLE = 1000

# One odd factor per place of a window.
_FACTORS = [(0x9E3779B97F4A7C15 * (2 * k + 1) ** 3 | 1) & 0xFFFFFFFFFFFFFFFF for k in range(WINDOW)]


def _repeated_words(words: list[bytes]) -> int:
    """Words in windows of 8 that occur twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    sums = sum(hashes[k : k + n] * np.uint64(f) for k, f in enumerate(_FACTORS))
    sums.sort()
    if not (sums[1:] == sums[:-1]).any():
        return 0  # different sums mean different windows
    index: dict[bytes, int] = {}
    names = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    step = 1
    while step < WINDOW:  # names of pairs of windows, until a name stands for eight words
        names = np.unique(names[:-step] * (int(names.max()) + 1) + names[step:], return_inverse=True)[1]
        step *= 2
    again = np.flatnonzero(np.bincount(names)[names] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


class Text:
    """What rules look at; each figure is computed once, when it is first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def data(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, BLANKS))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def n_capitals(self) -> int:
        """Characters that lower case would change."""
        lower = self.text.lower()
        if len(lower) != len(self.text):
            return sum(c != c.lower() for c in self.text)
        as_array = lambda t: np.frombuffer(t.encode("utf-32-le"), "<u4")
        return int((as_array(self.text) != as_array(lower)).sum())

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines with a word."""
        return [line for line in self.data.split(b"\n") if line and not line.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return _repeated_words(self.words)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]
    base: bool = False


RULES = (
    Rule("few_words", lambda t: t.n_words < 20, base=True),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 30 * t.n_words, base=True),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("capitals", lambda t: 2 * t.n_capitals > t.word_chars),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > len(t.lines)),
)


@dataclass(frozen=True)
class Measured:
    name: str
    documents: int
    rejected: int
    seconds: float

    @property
    def rank(self) -> tuple[float, str]:
        """Rejections per second, most first; names break ties."""
        return (-self.rejected / max(self.seconds, 1e-9), self.name)


def measure(docs: DataFrame, rules: Sequence[Rule], id_col: str, text_col: str, sample: int = SAMPLE) -> list[Measured]:
    """Cost and rejections of each rule by itself, on the ``sample`` rows with the smallest hash of their id."""
    ticket = F.xxhash64(F.lit("rules"), docs[id_col])
    border = docs.select(ticket.alias("t")).orderBy("t").limit(sample).select(F.max("t")).first()[0]
    if border is None:
        return [Measured(r.name, 0, 0, 0.0) for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for rule in rules:
                began = perf_counter()
                rejected = sum(rule.rejects(Text(t)) for t in texts)
                yield pa.RecordBatch.from_pydict(
                    {"name": [rule.name], "documents": [len(texts)], "rejected": [rejected], "seconds": [perf_counter() - began]}
                )

    few = docs.filter(ticket <= border).select(docs[text_col].alias("text")).limit(sample)
    found = few.mapInArrow(run, "name string, documents bigint, rejected bigint, seconds double")
    return [
        Measured(r.name, r.documents, r.rejected, r.seconds)
        for r in found.groupBy("name").agg(*[F.sum(c).alias(c) for c in ("documents", "rejected", "seconds")]).collect()
    ]


def cascade(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
    figures: Sequence[str] = (),
    sample: int = SAMPLE,
    pass_on: Sequence[str] = (),
) -> DataFrame:
    """One row per row of ``docs``: id, kept, base_failed (a base rule rejects it), then ``figures``.

    ``figures`` names attributes of Text to return; they, and base_failed, are computed for every row,
    so ask for none (``base_failed`` included) to let the cascade save work. A NULL text has no words. Ids
    may be NULL or repeated; an empty table gives an empty result. ``pass_on`` names columns to return
    as they are, others are ignored."""
    known = {m.name: m.rank for m in measure(docs, rules, id_col, text_col, sample)}
    ordered = sorted(rules, key=lambda r: known.get(r.name, (0.0, r.name)))
    base = [r for r in rules if r.base]
    full = bool(figures)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(0):
                text = Text(value.as_py())
                rejected = any(r.rejects(text) for r in ordered)
                row = {"kept": not rejected}
                if full:
                    row["base_failed"] = any(r.rejects(text) for r in base)
                    row |= {f: getattr(text, f) for f in figures}
                rows.append(row)
            names = ["kept", *(["base_failed", *figures] if full else [])]
            results = [pa.array([r[n] for r in rows], pa.bool_() if n in ("kept", "base_failed") else pa.int64()) for n in names]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *results], names=[*keep, *names])

    keep = list(dict.fromkeys([id_col, *pass_on]))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "kept boolean", *(["base_failed boolean", *(f"{f} bigint" for f in figures)] if full else [])])
    return docs.select(docs[text_col].alias("_text"), *[docs[c] for c in keep]).mapInArrow(judge, schema)
