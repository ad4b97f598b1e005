import re
from hashlib import sha256

import pytest

from tallyhouse.llm import identifiers as ids
from tallyhouse.llm.queries import op9_personal_data
from tests.conftest import SMALL
from tests.llm.fixtures import awkward, empty

# The contract's expressions, as they are written there.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": True,
        "ip": all(int(p) <= 255 for p in value.split(".")) if kind == "ip" else None,
        "card": 14 <= len(digits) <= 19 and luhn(digits),
        "phone": 10 <= len(digits) <= 15,
    }[kind]


def base(text):
    found = [(m.start(), list(BASE).index(k), m.end(), k) for k, e in BASE.items() for m in re.finditer(e, text or "") if valid(k, m.group())]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


TRICKY = [
    "a@b.c+d@e.f@g.h", "x@y", "x@y.", "a..b@c.d.e-f", "@a.b", "aé@b.c", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256", "0001.02.3.255",
    "99999999999999999999.1.1.1", "1.2.3", "4111-1111-1111-1111", "4111 1111 1111 1112", "4111  1111 1111 1111", "1 " * 50, "4" * 40,
    "+1 (555) 010-9999", "+12345678901234567", "+1(((((2", "++1 234 567 8901", "+1 555 010 9999 4111 1111 1111 1111", "🙂 é +49 30 12345678, a@b.de",
    "378282246310005 30569309025904 6011111111111117", "." * 50 + "1.1.1.1" + "." * 9, "a" * 3000 + "@" + "b." * 500, "1-2 3-4" * 200, "-1.1.1.1@a.b-",
    "-" * 2000 + "@x.y", "9" * 5000, "+" * 500 + "1 2 3 4 5 6 7 8 9 0 1", "\u0661\u0662.1.1.1", "a@b.c\n\nd@e.f",
]


def test_base_spans(spark, folder):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in ids.personal_data(docs, folder).collect()}
    for i, text in enumerate(TRICKY):
        assert found[i].base == base(text), text
        assert found[i].spans == base(text), text


def test_whole_table(spark):
    texts = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    rows = op9_personal_data(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = base(texts[r.doc_id])
        assert r.base_sha256 == sha256(spans.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(s.startswith(k) for s in spans.split(",")) for k in BASE]
        assert set(filter(None, spans.split(","))) <= set(r.spans.split(","))


def test_awkward_rows(spark, folder):
    docs = awkward(spark)
    rows = ids.personal_data(docs, folder).collect()
    assert sorted(str((r.doc_id, r.base)) for r in rows) == sorted(str((r.doc_id, base(r.text))) for r in docs.collect())
    assert ids.personal_data(empty(spark), folder).collect() == []


@pytest.fixture()
def contexts(spark):
    phones = [f"please call phone: +1 (555) 010-{n:04} now and the rest of it" for n in range(20)]
    common = [f"and the +1 (555) 020-{n:04} of the house and the garden and the door" for n in range(5)]
    unseen = ["my phone: 555-0199-22 is new", "then the 555-0199-23 is not", "card no. 4111 1111 1111 1112", "Phone: 030/1234567", "phone: none", "phone: 12"]
    return spark.createDataFrame(list(enumerate(phones + common + unseen)), "doc_id bigint, text string")


def test_unseen_identifiers_after_a_reliable_word(contexts, folder):
    rows = {r.doc_id: r for r in ids.personal_data(contexts, folder).collect()}
    assert [(rows[25 + i].base, rows[25 + i].spans) for i in range(6)] == [
        ("", "phone:10:21"), ("", ""), ("", ""), ("", "phone:7:18"), ("", ""), ("", ""),
    ]
    assert all(rows[i].base == rows[i].spans != "" for i in range(25))


def test_too_few_seeds_make_no_pattern(contexts, folder):
    few = contexts.filter("doc_id < 2 OR doc_id >= 25")
    assert all(r.base == r.spans for r in ids.personal_data(few, folder).collect())


def spans_of(text):
    return set(filter(None, text.split(",")))


DISCOVERED = [
    ("phone: 030 123 4567", "phone:7:19"),
    ("phone: (030) 123 45 67.", "phone:7:22"),
    ("phone: 555-123-4567, or later", "phone:7:19"),
    ("phone: 5551234567", "phone:7:17"),
    ("Mail: john(at)example.com", "email:6:25"),
    ("Mail: john [at] example [dot] com now", "email:6:33"),
    ("the 030 123 4567", ""),
    ("the john(at)example.com", ""),
    ("phone: john(at)example.com", ""),  # no pattern of that kind
    ("reach me 030 123 4567", "phone:9:21"),  # two words, each of them common
    ("me 030 123 4567", ""),
    ("so 030 123 4567 (office)", "phone:3:15"),  # the word behind
]


def test_discovered(spark, folder):
    seeds = [
        line.format(n)
        for n in range(60)
        for line in ("a phone: +1 555 010 99{:02}.", "my Mail: u{}@example.com or", "reach me +1 555 020 99{:02}", "x +1 555 030 99{:02} (office)")
    ]
    common = ["me and the reach of the house x to me"] * 90
    docs = spark.createDataFrame([*enumerate(seeds + common), *enumerate((text for text, _ in DISCOVERED), 9000)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in ids.personal_data(docs, folder).filter("doc_id >= 9000").collect()}
    for i, (text, found) in enumerate(DISCOVERED, 9000):
        assert (rows[i].base, rows[i].spans) == ("", found), text


def test_found_instances_support_new_patterns(spark, folder):
    """``phone:`` finds numbers; these make ``Rufnummer`` a pattern, which no seed follows."""
    seeds = [f"phone: +1 555 010 99{n:02}" for n in range(9)]
    linked = [f"phone: 030 123 {n:04}" for n in range(9)] + [f"Rufnummer 030-123-{n:04}" for n in range(9)]
    docs = spark.createDataFrame(list(enumerate([*seeds, *linked, "Rufnummer 040 7654321"])), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in ids.personal_data(docs, folder).collect()}
    assert rows[27].spans == "phone:10:21"
    without = ids.personal_data(docs.filter("doc_id < 9 OR doc_id >= 18"), folder).collect()
    assert {r.doc_id: r.spans for r in without}[27] == ""


def twin(texts, reliable=ids.RELIABLE, support=ids.SUPPORT):
    """The numbers that are discovered, by loops over plain dictionaries."""
    blank = "[\x20\x09-\x0D]"
    word = lambda part: [w for w in re.split(f"{blank}+", part.lower()) if w]
    places, occurs = [], {}
    for i, text in enumerate(texts):
        all_words = word(text)
        for key in all_words + [" ".join(p) for p in zip(all_words, all_words[1:])]:
            occurs[key] = occurs.get(key, 0) + 1
        seeds = [(m.start(), m.end()) for m in re.finditer(BASE["phone"], text) if valid("phone", m.group())]
        for kind, spans in (("phone", seeds), ("number", [m.span() for m in re.finditer(ids._NUMBER, text)])):
            ends = [0, *[b for _, b in spans]]
            starts = [*[a for a, _ in spans], len(text)]
            for k, (a, b) in enumerate(spans):
                digits = re.sub("[^0-9]", "", text[a:b])
                if kind == "number" and (len(digits) < 4 or any(x < b and a < y for x, y in seeds)):
                    continue
                left, right = text[ends[k] : a], text[b : starts[k + 1]]
                before = word(left) if re.search(f"{blank}$", left) else []
                around = [("<", before[-1])] if before else []
                around += [("<", " ".join(before[-2:]))] if len(before) > 1 else []
                around += [(">", word(right)[0])] if re.match(f"{blank}+[^\x20\x09-\x0D]", right) else []
                places.append((i, a, kind, digits, around))
    r = {(k, v): 1.0 for _, _, k, v, _ in places if k == "phone"}
    while True:
        totals, different = {}, {}
        for _, _, k, v, around in places:
            for pattern in around if (k, v) in r else []:
                totals[pattern] = totals.get(pattern, 0) + r[k, v]
                different.setdefault(pattern, set()).add((k, v))
        p = {x: min(1.0, t / occurs[x[1]]) for x, t in totals.items()}
        p = {x: y for x, y in p.items() if y >= reliable and len(different[x]) >= support}
        new = dict(r)
        for _, _, k, v, around in places:
            if k == "number" and (best := max((p.get(x, 0) for x in around), default=0)):
                new[k, v] = max(best, new.get((k, v), 0))
        if new == r:
            return {(i, a) for i, a, k, _, around in places if k == "number" and any(x in p for x in around)}
        r = new


def test_graph_against_plain_loops(spark, folder):
    import random

    rng = random.Random(5)
    vocabulary = ["tel", "call", "the", "of", "fax", "at", "me", "id", "(home)"]
    number = lambda: f"{rng.randrange(30):02}{rng.choice(' -/')}{rng.randrange(40, 60)}{rng.choice(['', ' '])}77"
    phone = lambda: f"+1 555 010 {rng.randrange(9000, 9040)}"
    texts = []
    for _ in range(400):
        line = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 6))]
        lead = rng.choice(["tel", "fax", "call me", "of"])
        value = phone() if rng.random() < {"tel": 0.8, "fax": 0.2, "call me": 0.6, "of": 0.1}[lead] else number()
        texts.append(" ".join([*line, lead, value, rng.choice(["ok", "(home)", "the"])]))
    rows = ids.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), folder).collect()
    found = {(r.doc_id, int(x.split(":")[1])) for r in rows for x in spans_of(r.spans) - spans_of(r.base)}
    assert found == twin(texts) and 0 < len(found) < 400


def test_masked_seeds_come_back(spark, folder):
    """A tenth of the identifiers is written so that no fixed pattern fits; nine tenths of these are found."""
    lines, masked = [], {}
    for n in range(400):
        plain, hidden, at = [
            (f"please phone: +49 30 {1000000 + n} soon", f"please phone: 030 {1000000 + n} soon", "phone:14:25"),
            (f"write to Mail: u{n:03}@example.com today", f"write to Mail: u{n:03}(at)example.com today", "email:15:34"),
            (f"the card no. 411111111111{n:04} of", None, ""),
        ][n % 3]
        if n % 10 == 3 and hidden:
            masked[n] = at
        lines.append((n, hidden if n in masked else plain))
    rows = {r.doc_id: r.spans for r in ids.personal_data(spark.createDataFrame(lines, "doc_id bigint, text string"), folder).collect()}
    assert sum(masked[n] in spans_of(rows[n]) for n in masked) >= 0.9 * len(masked) > 20


def test_very_long_texts(spark, folder):
    """Over a megabyte each: one word, many words, many numbers, a number with a long tail."""
    texts = ["x" * 1_200_000, "phone: 12 " * 120_000, "12345 a " * 150_000, "1" + "!" * 1_200_000, "9" * 1_200_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r.spans for r in ids.personal_data(docs, folder).collect()] == [""] * 5
