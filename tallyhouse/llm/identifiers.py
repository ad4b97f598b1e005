"""Personal data: fixed patterns, and identifiers that stand where those stand.

What the fixed patterns find are seeds. The words around an identifier are lexical patterns: the word
before it, the two words before it, the word after it. ``phone:`` is nearly always followed by an
identifier, ``the`` hardly ever. Patterns and instances form a graph, and reliability goes back and
forth on it: a pattern's is the share of all its occurrences in the corpus that stand next to a
reliable instance, weighted by the reliability of the instances; a candidate's is that of the best
pattern around it. A pattern counts if it is reliable and several different reliable instances support it, and
what it discovers supports other patterns in the next round, until nothing changes.

Candidates have the shape of the seeds: words with digits and the groups of digits behind them for
numbers, and addresses with a spelt-out at sign for mail. Their kind is that of their best pattern.

All of this is columns and joins. Positions come from splitting a text by the same expression whose
matches are extracted, and adding up lengths.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyhouse.llm.common import WORD, SharedFolder, ascii_lower, keyed

KINDS = ("email", "ip", "card", "phone")
RELIABLE, SUPPORT = 0.5, 3
#: What a number must have to be a candidate; the longest word of a pattern, and how far around an identifier its words are.
LEAST_DIGITS, LONGEST_WORD, REACH = 4, 64, 192

# A match begins where a run of its characters does, or where the last match ended: the same matches as
# without, but a long run is read once. Possessive quantifiers, as nothing shorter could match either.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Candidates: a word with a digit and the groups of digits behind it; an address with (at) and (dot).
_NUMBER = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+(?:\x20\(?[0-9][0-9()./-]*+(?![^\x20\x09-\x0D,;:!?]))*+"
_AT, _DOT = (rf"\x20?[\[({{]\x20?(?i:{word})\x20?[\])}}]\x20?" for word in ("at", "dot"))
_MAIL = rf"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:(?:\.|{_DOT})[A-Za-z0-9-]++)*+"
_EXPRESSIONS = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE, "number": _NUMBER, "mail": _MAIL}
# What a text must have to be searched.
_NEEDS = {"email": "@", "ip": r"\.", "card": "[0-9]", "phone": r"\+", "number": "[0-9]", "mail": r"(?i)[\[({]\x20?at"}
# The kinds that a candidate may turn out to be.
_SHAPES = {"number": ("ip", "card", "phone"), "mail": ("email",)}

_FINDS = "array<struct<kind: string, i: int, skip: int, left: string, right: string, value: string>>"


def _finds(text: Column, kind: str) -> Column:
    """Per match: its number, the length of the gap before it, the text around it, and the match."""
    expression = _EXPRESSIONS[kind]
    gaps, found = F.split(text, expression, -1), F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    each = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), F.slice(gaps, 2, F.size(found)).alias("next"), found.alias("value")),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.char_length(x["gap"]).alias("skip"),
            F.substring(x["gap"], -REACH, REACH).alias("left"),
            F.substring(x["next"], 1, REACH).alias("right"), x["value"].alias("value"),
        ),
    )
    return F.when(text.rlike(_NEEDS[kind]), each).otherwise(F.array().cast(_FINDS))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """From the right, every second digit is doubled, and nine taken off what is above nine."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: d.cast("int") * (1 + i % 2) - F.when((i % 2 == 1) & (d.cast("int") > 4), 9).otherwise(0),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", ~value.rlike(r"(?:^|\.)0*(?:[1-9][0-9]{3,}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])(?:\.|$)"))
        .when((kind == "card") & n.between(14, 19), _luhn(digits))
        .when(kind == "phone", n.between(10, 15))
        .when(kind == "number", n >= LEAST_DIGITS)
        .when(kind == "mail", True)
        .otherwise(False)
    )


def _marked(rows: DataFrame) -> DataFrame:
    """row, id, finds: all matches of a row, without their places yet."""
    finds = F.concat(*[_finds(F.col("text"), kind) for kind in _EXPRESSIONS])
    return rows.select("row", "id", finds.alias("finds"))


def _base(kind: Column) -> Column:
    return kind.isin(*KINDS)


def _around() -> Column:
    """The patterns around a find: ``<`` and the one or two words before it, ``>`` and the word after it.

    A word is one up to blanks or the ends of the text between two finds."""
    word, blank = rf"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]{{1,{LONGEST_WORD}}}+)", r"[\x20\x09-\x0D]"
    left, right = ascii_lower(F.col("left")), ascii_lower(F.col("right"))
    one = F.regexp_extract(left, rf"{word}{blank}+$", 1)
    two = F.regexp_extract(left, rf"{word}{blank}+[^\x20\x09-\x0D]{{1,{LONGEST_WORD}}}+{blank}+$", 1)
    after = F.regexp_extract(right, rf"^{blank}+{word}(?![^\x20\x09-\x0D])", 1)
    each = F.array(
        F.when(one != "", F.concat(F.lit("<"), one)),
        F.when((one != "") & (two != ""), F.concat(F.lit("<"), two, F.lit(" "), one)),
        F.when(after != "", F.concat(F.lit(">"), after)),
    )
    return F.array_compact(each)


def _instance(kind: Column, value: Column) -> Column:
    """What tells instances apart: numbers by their digits alone, addresses in small letters."""
    return F.when(kind.isin("card", "phone", "number"), _digits(value)).otherwise(ascii_lower(value))


def _placed(marked: DataFrame) -> DataFrame:
    """row, kind, start, end, value, around (its patterns), of all kinds and of candidates."""
    found = marked.select("row", F.explode("finds").alias("x")).select("row", "x.*")
    size = F.char_length("value")
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("skip") + size).over(so_far)
    # What ends a sentence or closes a bracket behind a number is not part of it.
    tail = F.when(F.col("kind") == "number", F.char_length(F.regexp_extract("value", r"(?<![^0-9A-Za-z])[^0-9A-Za-z]*+$", 0))).otherwise(0)
    return (
        found.withColumn("end", end)
        .filter(_valid(F.col("kind"), F.col("value")))
        .select(
            "row", "kind", (F.col("end") - size).alias("start"), (F.col("end") - tail).alias("end"),
            _instance(F.col("kind"), F.col("value")).alias("value"), _around().alias("around"),
        )
    )


def without_overlaps(found: DataFrame) -> DataFrame:
    """All spans but the candidates that share a character with another one; of two candidates the first stays."""
    base = _base(F.col("kind"))
    order = Window.partitionBy("row").orderBy("start", "end", "kind")
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # From the end on: a frame that shrinks would be added up anew for every row.
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("end"), F.desc("kind"))
    after = F.min(F.when(base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hit = (F.coalesce(before, F.lit(-1)) > F.col("start")) | (F.coalesce(after, F.col("end")) < F.col("end"))
    kept = found.withColumn("hit", hit).filter(base | ~F.col("hit")).drop("hit")
    other = F.max(F.when(~base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return kept.withColumn("other", other).filter(base | (F.coalesce("other", F.lit(-1)) <= F.col("start"))).drop("other")


def graph(found: DataFrame, support: int) -> DataFrame:
    """pattern, value, kind (of a seed, or the candidate's shape), n.

    Without patterns around fewer than ``support`` different instances: they can never count."""
    edges = found.select(F.explode("around").alias("pattern"), "value", "kind").groupBy("pattern", "value", "kind").agg(F.count("*").alias("n"))
    values = edges.select("pattern", "value").distinct().groupBy("pattern").count()
    return edges.join(values.filter(F.col("count") >= support).select("pattern"), "pattern")


def occurrences(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """pattern, occurs: how often the words of a pattern stand anywhere in the corpus."""
    wanted = edges.select("pattern").distinct().withColumn("key", F.expr("substring(pattern, 2)"))
    found = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0))
    worded = rows.select(found.alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.size("w")), lambda x, y: F.concat(x, F.lit(" "), y))
    # Only keys of patterns leave the tasks that read the texts.
    keys = worded.select(F.explode(F.concat(F.col("w"), pairs)).alias("key"))
    counted = keys.join(wanted.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("occurs"))
    return counted.join(wanted, "key").select("pattern", "occurs")


def patterns(found: DataFrame, rows: DataFrame, folder: SharedFolder, reliable: float, support: int) -> DataFrame:
    """pattern, kind, p: the reliable patterns, when no round changes them any more."""
    edges = folder.keep(graph(found, support), "graph")
    occurs = folder.keep(occurrences(rows, edges), "occurrences")
    seed = _base(F.col("kind"))
    shapes = F.create_map(*[F.lit(x) for k, v in _SHAPES.items() for x in (k, ",".join(v))])
    fits = F.find_in_set(F.col("to"), F.element_at(shapes, F.col("kind"))) > 0
    # Instances that are found, with their reliability: seeds at first. A value has one kind.
    known = edges.filter(seed).select("value", "kind", F.col("kind").alias("to"), F.lit(1.0).alias("r")).distinct()
    state = None
    while True:
        known = folder.keep(known, "instances")
        support_ = edges.join(known, ["value", "kind"]).groupBy("pattern", "to").agg(
            F.sum(F.col("n") * F.col("r")).alias("total"), F.countDistinct("value").alias("different")
        )
        per_pattern = support_.groupBy("pattern").agg(
            F.max_by("to", F.struct("total", "to")).alias("to"), F.sum("total").alias("total"), F.sum("different").alias("different")
        )
        p = F.least(F.lit(1.0), F.col("total") / F.col("occurs"))
        trusted = per_pattern.join(occurs, "pattern").filter((p >= reliable) & (F.col("different") >= support))
        trusted = folder.keep(trusted.select("pattern", "to", p.alias("p")), "patterns")
        now = trusted.select(F.count("*"), F.sum(F.round("p", 6).cast("decimal(38,6)"))).first()
        if now == state:
            return trusted.select("pattern", F.col("to").alias("kind"), "p")
        state = now
        best = F.max_by(F.struct("to", "p"), F.struct("p", "pattern"))
        new = edges.filter(~seed).join(trusted, "pattern").filter(fits).groupBy("value", "kind").agg(best.alias("best"))
        known = known.filter(seed).unionByName(new.select("value", "kind", F.col("best.to").alias("to"), F.col("best.p").alias("r")))


def _listed(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def _told(items: Column) -> Column:
    each = F.transform(
        F.array_sort(items), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    )
    return F.array_join(each, ",")


def personal_data(
    docs: DataFrame,
    folder: SharedFolder,
    id_col: str = "doc_id",
    text_col: str = "text",
    reliable: float = RELIABLE,
    support: int = SUPPORT,
) -> DataFrame:
    """One row per row of ``docs``: id, n_email, n_ip, n_card, n_phone, base (all seeds) and spans (seeds and
    what was discovered) as ``kind:start:end`` by start and kind, comma-joined; code points, end exclusive.

    NULL and blank texts have no spans beyond what they hold, and no text has others than its seeds if no
    reliable pattern stands in it. Of equally reliable patterns around a candidate the greatest decides on its
    kind. Repeated rows and NULL ids are kept, texts are read whole, an empty table gives an empty result, other
    columns are ignored. Words longer than 64 characters are no patterns."""
    rows = keyed(docs, "row", id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    marked = folder.keep(_marked(rows), "finds")
    all_spans = folder.keep(without_overlaps(_placed(marked)), "spans")
    trusted = folder.keep(patterns(all_spans, rows, folder, reliable, support), "reliable")
    is_base = _base(F.col("kind"))
    base = all_spans.filter(is_base).select("row", "kind", "start", "end", F.lit(True).alias("seed"))
    beside = all_spans.filter(~is_base).select("row", "start", "end", F.col("kind").alias("shape"), F.explode("around").alias("pattern"))
    allowed = F.array_contains(F.when(F.col("shape") == "mail", F.array(*map(F.lit, _SHAPES["mail"]))).otherwise(F.array(*map(F.lit, _SHAPES["number"]))), F.col("kind"))
    new = (
        beside.join(trusted, "pattern")
        .filter(allowed)
        .groupBy("row", "start", "end")
        .agg(F.max_by("kind", F.struct("p", "pattern")).alias("kind"))
        .select("row", "kind", "start", "end", F.lit(False).alias("seed"))
    )
    item = F.struct("start", _listed(F.col("kind")).alias("place"), "end", "kind")
    per_row = (
        base.unionByName(new)
        .groupBy("row")
        .agg(
            *[F.count(F.when(F.col("seed") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS],
            F.collect_list(F.when(F.col("seed"), item)).alias("base"),
            F.collect_list(item).alias("spans"),
        )
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    told = lambda c: F.coalesce(_told(F.col(c)), F.lit("")).alias(c)
    return marked.select("row", "id").join(per_row, "row", "left").select(
        F.col("id").alias(id_col), *[zero(f"n_{k}") for k in KINDS], told("base"), told("spans")
    )

