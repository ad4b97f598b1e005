"""Main text of web pages by paths that the pages of a host agree on.

Each page's containers are scored by the text that stands in them, and the page votes for the
generalised path (tags and classes, without numbers) of the best one. Spark counts the votes per host.
Then every page is read again and gives the text below the host's path; a page without that path
falls back on its own best one. So a page whose article is short is still read where its neighbours are.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyhouse.llm.common import SharedFolder, keyed
from tallyhouse.llm.link_graph import host_and_path

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
DROPPED = RAW | frozenset("head nav header footer aside button select template svg canvas object video audio menu dialog".split())
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption "
    "blockquote pre figure figcaption address details summary center hgroup fieldset hr".split()
)
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr caption blockquote pre figcaption ul ol dl table thead tbody tfoot".split())
# What an opening tag closes if it is still open, and where the search for it stops.
CLOSES = {"li": ("li", {"ul", "ol"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr", {"table"})}
_WORDS = (
    r"(?:ad|ads|adv|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|"
    r"side|aside|header|masthead|footer|cookies?|consent|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|"
    r"signup|login|search|share|sharing|social|related|recommended|comments?|commentlist|disqus|replies|respond)"
)
_ENDS = r"(?:ads?|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|cookies?|consent|newsletter|signup|popup|comments?)"
# A name is one of these words, ends with one behind a hyphen (site-footer, but not no-sidebar), or begins so (ad-box).
NOT_TEXT = re.compile(
    rf"(?i)(?<!\S)(?:{_WORDS}|(?!(?:no|with|without|has|hide|show)[-_])[^\s_-]+(?:[-_]+[^\s_-]+)*?[-_]+{_ENDS}|"
    r"(?:ads?|advert|sponsor|cookie|newsletter|comments?)[-_]\S+)(?!\S)"
)
# What speaks for the text around it.
MARKS = frozenset("article main h1".split())
ASKS = frozenset("input textarea select button".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())

_MARKUP = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'](?=[^<\"']*>))*)>", re.S)
_ATTRIBUTE = re.compile(r"""(?i)(?<![\w-])(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NUMBERS = re.compile(r"\d+")


@dataclass
class Suspect:
    """An element that is dropped for its class, id, role or being a form, unless the page's text is in it."""

    outer: Suspect | None
    form: bool
    chars: int = 0  # of text that is no link
    paragraphs: int = 0
    asks: bool = False  # a form with something to fill in or press
    marks: frozenset[str] = frozenset()


@dataclass(eq=False)
class Node:
    """An open element. Paths are put together for the few nodes that are asked for one, so that deep nesting
    costs no more than wide pages; ``length`` is that of the path."""

    tag: str
    step: str
    parent: Node | None
    dropped: bool
    suspect: Suspect | None = None  # what it is dropped for
    score: float = 0.0
    worth: float = 0.0  # of all blocks below
    full: bool = False  # whether there are any

    def __post_init__(self):
        self.length = self.parent.length + len(self.step) if self.parent is not None else 0
        # The container that text in here stands in.
        self.container = self if self.tag not in _LEAVES or self.parent is None else self.parent.container

    @property
    def path(self) -> str:
        steps, node = [], self
        while node is not None:
            steps.append(node.step)
            node = node.parent
        return "".join(reversed(steps))


@dataclass
class Block:
    text: str
    inside: Node
    worth: float


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


def _step(tag: str, classes: str) -> str:
    named = sorted({_NUMBERS.sub("", c) for c in classes.split()} - {""})
    return ".".join([tag, *named])


@dataclass
class Page:
    nodes: list[Node]  # parents before children
    blocks: list[Block]  # in page order, without those in dropped elements


def parse(page: str | None) -> Page:
    """The elements of a page, with scores, and its text."""
    kept: set[int] = set()
    while True:
        read, more = _parse(page or "", kept)
        if more <= kept:
            return read
        kept |= more


def _holding(suspects: dict[int, Suspect], chars: int, marks: set[str]) -> set[int]:
    """Numbers of those that hold the page's text. ``chars`` and ``marks``: what stands outside of all."""
    total = chars + sum(s.chars for s in suspects.values())
    for s in reversed(suspects.values()):
        if s.outer is not None:
            s.outer.chars += s.chars
            s.outer.paragraphs += s.paragraphs
            s.outer.asks |= s.asks
            s.outer.marks |= s.marks

    def holds(s: Suspect) -> bool:
        if s.marks & {"main", "h1"} or s.marks and not marks:
            return True
        if s.form and (not s.asks or s.paragraphs > 1) and 2 * s.chars > total:
            return True  # a form around the page; others have a line that says what they ask for
        return s.chars > 0 and chars == 0 and 2 * s.chars > total and (s.outer is None or s.outer.chars == s.chars)

    return {k for k, s in suspects.items() if holds(s)}


def _parse(page: str, kept: set[int]) -> tuple[Page, set[int]]:
    """The page if the suspects of these numbers, in page order, are kept, and the numbers of those that should be."""
    root = Node("", "", None, False)
    nodes, opened = [root], Counter()
    here, blocks, pieces, links, in_link = root, [], [], 0, False
    suspects: dict[int, Suspect] = {}
    number, chars, marks = 0, 0, set()

    def flush() -> None:
        nonlocal pieces, links
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                # Links weigh against a container; what stands deeper counts half a level up. A paragraph is no
                # container: its parent gets the whole of it.
                worth, node = len(text) - 2.0 * links, here.container
                blocks.append(Block(text, here, worth))
                here.worth, here.full = here.worth + worth, True
                while abs(worth) >= 1:
                    node.score += worth
                    if node.parent is None:
                        break
                    worth, node = worth / 2, node.parent.container
            pieces, links = [], 0

    def words(text: str) -> None:
        nonlocal links, chars
        if not text:
            return
        if not here.dropped:
            pieces.append(text)
            if in_link:
                links += len(text)
            else:
                chars += len(text.strip())
        elif here.suspect is not None and not in_link:
            here.suspect.chars += len(text.strip())

    def leave(node: Node) -> Node:
        """Close everything that is open below ``node``."""
        left = here
        while left is not node:
            opened[left.tag] -= 1
            left = left.parent
        return node

    def inside(tag: str, step: str, attributes: dict[str, str]) -> Node:
        nonlocal number
        hard = tag in DROPPED or "hidden" in attributes and tag not in ("html", "body")
        dropped, suspect = here.dropped or hard, None if hard else here.suspect
        if not hard and _suspicious(tag, attributes):
            if number not in kept and (suspect is not None or not dropped):
                dropped, suspect = True, Suspect(here.suspect, tag == "form" or attributes.get("role", "").lower() == "form")
                suspects[number] = suspect
            number += 1
        if tag in MARKS:
            if suspect is not None:
                suspect.marks |= {tag}
            elif not dropped:
                marks.add(tag)
        elif tag == "p" and suspect is not None:
            suspect.paragraphs += 1
        nodes.append(Node(tag, step, here, dropped, suspect))
        opened[tag] += 1
        return nodes[-1]

    at = 0
    while match := _MARKUP.search(page, at):
        words(page[at : match.start()])
        at = match.end()
        if not match[2]:
            continue
        tag = match[2].lower()
        if tag in ASKS and here.suspect is not None and not re.search(r"(?i)type\s*=\s*[\"']?hidden", match[3]):
            here.suspect.asks = True
        if not match[1] and tag in RAW:
            # Up to its own closing tag, whatever stands between.
            close = re.compile(rf"(?i)</{re.escape(tag)}(?=[\s/>])[^>]*>?").search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag == "br":
            words("\n")
        elif tag in ("td", "th"):
            words(" ")
        elif tag == "a":
            in_link = not match[1]
        if tag not in BLOCKS and tag not in DROPPED and tag != "form":
            if match[1]:
                here = leave(_closed(here, tag, opened, inline=True))
            elif tag not in VOID and match[3] and _unwanted(attributes := _attributes(match[3])):
                # An unwanted inline element hides its text, but parts no blocks.
                here = inside(tag, "", attributes)
            continue
        flush()
        in_link = False
        if match[1]:
            here = leave(_closed(here, tag, opened))
        elif tag not in VOID:
            if tag in BLOCKS:
                here = leave(_closed_by(here, tag, opened))
            attributes = _attributes(match[3])
            here = inside(tag, "/" + _step(tag, attributes.get("class", "")), attributes)
    words(page[at:])
    flush()
    for node in reversed(nodes[1:]):
        node.parent.worth += node.worth
        node.parent.full |= node.full
    return Page(nodes, blocks), kept | _holding(suspects, chars, marks) if suspects else kept


def _suspicious(tag: str, attributes: dict[str, str]) -> bool:
    if tag in ("html", "body"):
        return False
    return (
        tag == "form"
        or attributes.get("role", "").lower() in ROLES
        or any(NOT_TEXT.search(attributes.get(k, "")) for k in ("class", "id"))
    )


def _unwanted(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or _suspicious("", attributes)


def _closed(here: Node, tag: str, opened: Counter[str], inline: bool = False) -> Node:
    """What is open after </tag>: an end without a beginning changes nothing."""
    if not opened[tag]:
        return here
    node = here
    while node.parent is not None:
        if node.tag == tag:
            return node.parent
        if inline and node.tag in BLOCKS:
            break
        node = node.parent
    return here


def _closed_by(here: Node, tag: str, opened: Counter[str]) -> Node:
    """What is open before <tag>: blocks end a paragraph, an item ends the one before."""
    if here.tag == "p":
        return here.parent
    ends, stops = CLOSES.get(tag, ("", ()))
    node = here
    if not any(opened[end] for end in ends.split()):
        return here
    while node.parent is not None and node.tag not in stops:
        if node.tag in ends.split():
            return node.parent
        node = node.parent
    return here


def best_path(page: Page) -> tuple[str, float] | None:
    """Path of the whole around the best container, and that one's score; of equal ones the shortest path, then the
    first in the page."""
    found = [n for n in page.nodes if n.full and n.container is n]
    if not found:
        return None
    best = min(found, key=lambda n: (-n.score, n.length))
    return _whole(best).path, best.score


def _whole(best: Node) -> Node:
    """The highest container around ``best`` that adds more text than links: what is beside the largest section belongs
    to it. An article, and then a main element, is taken as it is, and nothing outside of main is."""
    around = [best]
    while around[-1].parent is not None:
        around.append(around[-1].parent)
    last = {n.tag: i for i, n in enumerate(around)}  # of each tag the outermost
    at = last.get("article", last.get("main", 0))
    for i in range(at + 1, last.get("main", at if "article" in last else len(around) - 1) + 1):
        if around[i].container is around[i] and around[i].worth > around[at].worth:
            at = i
    return around[at]


def _below(page: Page, path: str) -> list[str]:
    """The blocks below containers of that path; a path is put together only where its length and end fit."""
    inside: set[Node] = set()
    for n in page.nodes:
        if n.parent in inside or (n.container is n and n.length == len(path) and path.endswith(n.step) and n.path == path):
            inside.add(n)
    return [b.text for b in page.blocks if b.inside in inside]


def text_below(page: Page, path: str | None) -> str:
    """The text in all containers of that path, or of the page's own best one if it has none."""
    below = _below(page, path) if path is not None else []
    if not below and page.blocks:
        below = _below(page, best_path(page)[0])
    return "\n\n".join(below)


def host_paths(pages: DataFrame, folder: SharedFolder) -> DataFrame:
    """host, best: the path that most of its pages vote for; then the higher sum of scores, then the path."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: Counter[tuple[str, str]] = Counter()
            scores: defaultdict[tuple[str, str], float] = defaultdict(float)
            for host, page in zip(batch.column(0), batch.column(1)):
                if best := best_path(parse(page.as_py())):
                    key = (host.as_py(), best[0])
                    votes[key] += 1
                    scores[key] += best[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([h for h, _ in votes], pa.string()), pa.array([p for _, p in votes], pa.string()),
                    pa.array(votes.values(), pa.int64()), pa.array([scores[k] for k in votes], pa.float64()),
                ],
                names=["host", "path", "votes", "score"],
            )

    cast = pages.select("host", "html").mapInArrow(vote, "host string, path string, votes bigint, score double")
    counted = cast.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))
    order = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc(F.round("score")), "path")
    winners = counted.withColumn("place", F.row_number().over(order)).filter("place = 1")
    return folder.keep(winners.select("host", F.col("path").alias("best")), "host-paths")


def main_texts(
    pages: DataFrame, folder: SharedFolder, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars.

    Pages without a host (a NULL url, too) vote together. A NULL or blank html, or one with nothing but dropped
    elements, has an empty text. A page of any length is read whole, in time and memory that grow with its length, nested
    as deep as it may be. Of equal votes the higher score wins, then the path that is first. Repeated rows are kept and vote each; an empty table gives an empty
    result; other columns are ignored."""
    picked = keyed(pages, "row", id=id_col, url=url_col, html=html_col).drop("row")
    hosted = picked.withColumn("host", host_and_path(F.col("url"))[0])
    id_kind, url_kind = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_below(parse(p.as_py()), best.as_py()) for p, best in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[id_col, url_col, "text", "n_chars"],
            )

    known = hosted.join(host_paths(hosted, folder), "host", "left").select("id", "url", "html", "best")
    return known.mapInArrow(read, f"`{id_col}` {id_kind}, `{url_col}` {url_kind}, text string, n_chars bigint")
