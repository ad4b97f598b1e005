"""URL filters: rules, and trust along links where no rule fits.

Rules judge a url by its host and path. For other urls the host counts: trust flows from hosts that rules
allow along links (a personalised PageRank), distrust flows from hosts that rules block against links,
to those that link to them, by the share of their links that leads there. So distrust lies between 0 and 1: it
is how likely a walk along links, which ends at any step with probability 0.15, comes to a blocked page. It
depends on where a host links to, not on how many others link there, so a hundred hosts that link to one
blocked host are blocked like a single one. A host is blocked if its distrust is above a border and above its trust.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.llm.common import SharedFolder, ascii_lower

DAMPING, BORDER, STILL = 0.85, 0.5, 1e-6

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Absolute targets of links, and the host in each.
_TARGET = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^\s"'<>/?#]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str  # with all its subdomains
    path: str  # how the url's path begins

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Empty for a NULL and for a url without ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(url, _URL, k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def rule_of(rules: Sequence[Rule], host: Column, path: Column, field: str) -> Column:
    """name or verdict of the longest rule that fits (of equal ones the first), or NULL."""
    found = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        found = F.when(rule.fits(host, path), F.lit(getattr(rule, field))).otherwise(found)
    return found


def host_edges(pages: DataFrame, host: Column, html: Column) -> DataFrame:
    """src, dst, n: the pages of a host that link to another host. Links within a host don't count."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(_TARGET), F.lit(1)), ascii_lower))
    links = pages.select(host.alias("src"), F.explode(targets).alias("dst")).filter("src != '' AND src != dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def host_scores(hosts: DataFrame, links: DataFrame, folder: SharedFolder, damping: float, still: float) -> DataFrame:
    """host, trust, distrust. ``hosts``: host, trust_seed, distrust_seed.

    Rounds go on until none moves a score by ``still`` or more. Each shrinks what is left by the damping, so the scores
    are then within still * damping / (1 - damping) of where they would end."""
    links = folder.keep(links, "links")
    out = links.groupBy("src").agg(F.sum("n").alias("n_out"))
    edges = folder.keep(links.join(out, "src").select("src", "dst", (F.col("n") / F.col("n_out")).alias("share")), "edges")
    # Hosts that are linked to but have no page here pass trust and distrust on, too.
    none = F.lit(0.0)
    everyone = hosts.unionByName(
        edges.select(F.col("dst").alias("host")).distinct().join(hosts, "host", "left_anti").select(
            "host", none.alias("trust_seed"), none.alias("distrust_seed")
        )
    )
    seeds = folder.keep(everyone, "seeds")
    scores = seeds.select("host", F.col("trust_seed").alias("trust"), F.col("distrust_seed").alias("distrust"))
    moved = still
    while moved >= still:
        trust = edges.join(scores, edges["src"] == scores["host"]).select(
            F.col("dst").alias("host"), (F.col("trust") * F.col("share")).alias("t"), none.alias("d")
        )
        distrust = edges.join(scores, edges["dst"] == scores["host"]).select(
            F.col("src").alias("host"), none.alias("t"), (F.col("distrust") * F.col("share")).alias("d")
        )
        got = trust.unionByName(distrust).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        flow = lambda c: damping * F.coalesce(F.col(c), none)
        # A walk that has come to a blocked page is there.
        distrusted = F.col("distrust_seed") + (1 - F.col("distrust_seed")) * flow("d")
        new = folder.keep(
            seeds.join(got, "host", "left").select(
                "host", (F.col("trust_seed") + flow("t")).alias("trust"), distrusted.alias("distrust")
            ),
            "scores",
        )
        old = scores.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
        change = F.abs(F.col("trust") - F.col("t")) + F.abs(F.col("distrust") - F.col("d"))
        moved = new.join(old, "host").select(F.max(change)).first()[0] or 0.0
        scores = new
    return scores


def judge(
    pages: DataFrame,
    folder: SharedFolder,
    rules: Sequence[Rule] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    damping: float = DAMPING,
    still: float = STILL,
    border: float = BORDER,
) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, trust, distrust.

    A url that is NULL or has no host is allowed unless a rule says otherwise: nothing speaks against it. A NULL
    html has no links, one of any length is searched whole. Repeated rows are kept and count as often; an empty table gives an empty result;
    other columns are ignored."""
    host, path = host_and_path(pages[url_col])
    parsed = folder.keep(pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path")), "urls")
    told = lambda field: rule_of(rules, F.col("host"), F.col("path"), field)
    judged = parsed.withColumn("rule", told("name")).withColumn("told", told("verdict"))
    share = lambda verdict: F.avg(F.when(F.col("told") == verdict, 1.0).otherwise(0.0))
    hosts = (
        judged.filter("host != ''").groupBy("host").agg(share("allow").alias("trust_seed"), share("block").alias("distrust_seed"))
    )
    scores = host_scores(hosts, host_edges(pages, host, pages[html_col]), folder, damping, still)
    bad = (F.col("distrust") > border) & (F.col("distrust") > F.col("trust"))
    return judged.join(scores, "host", "left").select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("told", F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "trust",
        "distrust",
    )
