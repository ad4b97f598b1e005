from collections import Counter

import pytest

from tallyhouse.llm import rules
from tests.llm.fixtures import LONG, SENTENCE, TEXTS, awkward, empty, words


def slow_repeats(text):
    w = [x for x in (text or "").encode().split()]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    return len({i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)})


@pytest.mark.parametrize("text", [*TEXTS, "a b " * 9, "a " * 9, "a b c d e f g h x a b c d e f g h", LONG + " " + LONG])
def test_repeated_words(text):
    assert rules.Text(text).n_repeat_words == slow_repeats(text)


def test_sums_that_collide_are_looked_at_again(monkeypatch):
    monkeypatch.setattr(rules, "_FACTORS", [0] * 8)
    text = " ".join(f"w{i}" for i in range(50))
    assert rules.Text(text).n_repeat_words == 0
    assert rules.Text(f"{text} {text}").n_repeat_words == 100


def test_figures():
    t = rules.Text("A  b# İ\n\nA  b# İ\n \t\nA  b#\n")
    assert (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_capitals) == (8, 11, 3, 1, 5)


@pytest.mark.parametrize("text, kept", [
    (None, False), ("", False), (SENTENCE, False), (LONG, True), (SENTENCE * 2, False), (LONG.upper(), False),
    (LONG.replace(" ", " ## "), False), ("x " + LONG, True), ("\n".join(["some line of text that is here"] * 30), False),
])
def test_verdicts(text, kept):
    assert not any(r.rejects(rules.Text(text)) for r in rules.RULES) is kept


def test_awkward_rows(spark):
    figures = ["n_words", "n_repeat_words"]
    docs = awkward(spark)
    rows = rules.cascade(docs, figures=figures).collect()
    expected = [(r.doc_id, not any(x.rejects(rules.Text(r.text)) for x in rules.RULES), rules.Text(r.text).n_words) for r in docs.collect()]
    assert sorted(map(str, expected)) == sorted(str((r.doc_id, r.kept, r.n_words)) for r in rows)
    assert all(not (r.kept and r.base_failed) for r in rows)


def test_short_cut_gives_the_same_verdicts(spark):
    docs = awkward(spark)
    short = rules.cascade(docs).collect()
    assert Counter(map(str, short)) == Counter(str(r) for r in rules.cascade(docs, figures=["n_words"]).select("doc_id", "kept").collect())


def test_empty_table(spark):
    assert rules.cascade(empty(spark)).collect() == []


def test_measured_rules(spark):
    measured = {m.name: m for m in rules.measure(awkward(spark), rules.RULES, "doc_id", "text")}
    assert measured.keys() == {r.name for r in rules.RULES}
    assert all(m.documents == len(TEXTS) + 4 for m in measured.values())
    assert measured["few_words"].rejected == sum(len(words(t)) < 20 for t in TEXTS) + 4
    cheap = rules.Measured("a", 10, 5, 0.1)
    assert sorted([rules.Measured("b", 10, 5, 1.0), cheap, rules.Measured("c", 10, 0, 0.0)], key=lambda m: m.rank)[0] is cheap
