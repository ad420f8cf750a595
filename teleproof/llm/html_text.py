"""Main text of web pages as the maximum-scoring run of their words and tags.

A page becomes a row of events: text runs, each worth as many points as it has words, and tags, each with a negative weight. The weights come from pages
that mark their article themselves: a tag that comes inside articles costs next to nothing, one that only stands outside costs more than the text
that it leads there would bring. One linear scan finds the contiguous run of events with the highest sum. What the page itself
names as furniture (menus, footers, forms, adverts and so on) has no words, wherever it stands.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
RAW = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
VOID = set("area base br col embed hr img input link meta source track wbr".split())
# Elements that hold no article text.
FURNITURE = set("head nav header footer aside form button select menu dialog svg canvas object audio video".split()) | set(RAW)
# Whole class or id tokens and roles that name such parts; a few words before or after the name may say more about it.
NAME = (
    r"(?:ads?|advert|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|nav|navbar|navigation|menu|menubar|breadcrumbs?|sidebar|side|footer|header|masthead|"
    r"cookies?|consent|notices?|alert|popup|modal|newsletter|subscribe|share|social|related|recommended|recommendations|comments?|replies|disqus|login|search|complementary|contentinfo)"
)
NAMED = re.compile(rf"{NAME}(?:[_-](?:{NAME}|box|bar|block|list|section|area|wrap|wrapper|container|links?|items?|unit|slot|form|buttons?|posts?|articles?|thread|\d+))*", re.I)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\s\"'>]+))", re.I)
INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
KEEPS_WORDS = set("html body article main h1 h2 h3 h4 h5 h6".split())  # never furniture by name
# Elements whose end tag may be left out, and the start tags that end them.
BLOCKS = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDED_BY = {
    "p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
    "tr": {"tr", "tbody", "tfoot"}, "option": {"option", "optgroup"},
}

INSIDE, UNSEEN = -0.01, -0.25


@dataclass
class Events:
    """``text[k]`` is a decoded run or None for a tag, ``name[k]`` the tag with its first class, ``breaks[k]`` whether it ends a block."""

    text: list[str | None] = field(default_factory=list)
    name: list[str] = field(default_factory=list)
    breaks: list[bool] = field(default_factory=list)

    def add(self, text: str | None, name: str = "", breaks: bool = False) -> None:
        self.text.append(text)
        self.name.append(name)
        self.breaks.append(breaks)


def hidden_until(page: str, place: int, name: str) -> tuple[int, bool]:
    """Where the hidden element ``name`` that began before ``place`` ends, and whether an article or main lies inside it.

    It ends at its own end tag; where that may be left out, also before the next sibling or the end of what holds it.
    """
    open_, whole = [name], False
    while True:
        found = TAG.search(page, place)
        if not found:
            return len(page), whole
        close, tag, _ = found.groups()
        tag = (tag or "").lower()
        if not close and tag in RAW:
            end = RAW[tag].search(page, found.end())
            place = end.end() if end else len(page)
            continue
        if tag and not close:
            whole |= tag in ("article", "main")
            while open_ and tag in ENDED_BY.get(open_[-1], ()):
                open_.pop()
            if not open_:
                return found.start(), whole
            if tag not in VOID:
                open_.append(tag)
        elif tag in open_:
            while open_.pop() != tag:
                pass
            if not open_:
                return found.end(), whole
        elif tag and name in ENDED_BY and tag != "p" and tag not in INLINE:
            return found.start(), whole
        place = found.end()


def events(page: str) -> Events:
    """Tags and text of a page in order, without what is furniture; an unfinished tag or comment at the end is dropped.

    An element is hidden by name only if it holds no article or main element; inside these its id alone does not count.
    """
    out, place = Events(), 0
    inside = 0
    while True:
        found = TAG.search(page, place)
        run = page[place : found.start() if found else len(page)]
        if run:
            out.add(html.unescape(run))
        if not found:
            return out
        place = found.end()
        close, name, rest = found.groups()
        if not name:
            continue
        name = name.lower()
        if name in RAW and not close:
            end = RAW[name].search(page, place)
            place = end.end() if end else len(page)
            continue
        if close:
            inside -= name in ("article", "main") and inside > 0
            out.add(None, f"/{name}", name not in INLINE)
            continue
        found_ = [(kind.lower(), x) for kind, *a in ATTRIBUTE.findall(rest) for x in a if x]
        tokens = " ".join(x for _, x in found_).split()
        # A mere id is an anchor of the article when it stands inside one.
        naming = " ".join(x for kind, x in found_ if kind != "id" or not inside).split()
        by_name = name not in KEEPS_WORDS and any(NAMED.fullmatch(t) for t in naming)
        if name not in VOID and (name in FURNITURE or by_name):
            end, whole = hidden_until(page, place, name)
            if name in FURNITURE or not whole:
                place = end
                out.add(None, f"{name}!", True)
                continue
        inside += name in ("article", "main")
        first = tokens[0].lower() if tokens else ""
        out.add(" " if name == "br" else None, f"{name}.{first}" if first else name, name not in INLINE)


def best_run(row: Events, weights: dict[str, float]) -> tuple[int, int]:
    """First and last event + 1 of the run with the highest sum; the earliest and shortest among equals; empty if nothing is positive."""
    best, begin, end = 0.0, 0, 0
    score, start = 0.0, 0
    for k, text in enumerate(row.text):
        score += weights.get(row.name[k], UNSEEN) if row.name[k] else len(text.split())
        if score <= 0:
            score, start = 0.0, k + 1
        elif score > best:
            best, begin, end = score, start, k + 1
    return begin, end


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """Blocks of the best run, white space made single spaces, joined by line ends."""
    if not page:
        return ""
    row = events(page)
    begin, end = best_run(row, weights)
    blocks, parts = [], []
    for k in range(begin, end):
        if row.breaks[k]:
            blocks.append("".join(parts))
            parts = []
        elif row.text[k]:
            parts.append(row.text[k])
    blocks.append("".join(parts))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def observed(page: str, apart: frozenset[str] = frozenset()) -> dict[str, list[int]] | None:
    """For a page with one whole article: per tag how often it is inside and outside, the words that follow it inside and outside, and, for a tag
    in ``apart``, the most words that come outside between it and the next of them."""
    row = events(page)
    if row.name.count("/article") != 1 or sum(n.split(".")[0] == "article" for n in row.name) != 1:
        return None
    seen: dict[str, list[int]] = {}
    inside, last, lead, led = False, "", "", 0
    for name, text in zip(row.name, row.text):
        if not name:
            words = len(text.split())
            if last:
                seen[last][2 if inside else 3] += words
            if lead and not inside:
                led += words
                seen[lead][4] = max(seen[lead][4], led)
            continue
        if name == "/article":
            inside = False
        counts = seen.setdefault(name, [0, 0, 0, 0, 0])
        counts[0 if inside else 1] += 1
        if name in apart:
            lead, led = name, 0
        inside, last = inside or name.split(".")[0] == "article", name
    return seen


def weight(inside: int, outside: int, within: int, without: int, led: int) -> float:
    """What a tag costs. One that no article holds costs more than all the text it leads brings; another, what the text after it brings outside
    more than inside, on average over all its places, so that no single page decides."""
    return INSIDE - 2 * (led + 1 if not inside else max(0, without - within) / (inside + outside))


def learn(pages: DataFrame, sample: int = 2_000) -> dict[str, float]:
    """Weights of tags from at most ``sample`` pages with an article element, those whose ``page_id`` has the smallest hash."""
    marked = pages.where(F.col("html").contains("</article>"))
    picked = marked.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    shown = marked.join(picked, "page_id", "left_semi").select("html")
    columns = ["inside", "outside", "within", "without", "led"]

    def counted(apart: frozenset[str]) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(name, *x) for page in batch.column(0) for name, x in (observed(page.as_py(), apart) or {}).items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["name", *columns])

        seen = shown.mapInArrow(run, "name string, " + ", ".join(f"{c} long" for c in columns))
        sums = [(F.max if c == "led" else F.sum)(c).alias(c) for c in columns]
        # Tags that few pages have are left unseen, so what is collected is bounded by the vocabulary of common markup.
        return seen.groupBy("name").agg(*sums, F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(4_096).collect()

    apart = frozenset(r.name for r in counted(frozenset()) if not r.inside)
    return {r.name: weight(*(r[c] for c in columns)) for r in counted(apart)}


def extract(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``page_id, url, text`` for every row: the main text of the whole ``html``, empty if there is none; null html is empty.

    Character references are decoded, white space inside a block is one space, blocks stand on lines of their own in page order. Equal rows
    give equal rows, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), weights) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    wanted = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return wanted.mapInArrow(run, "page_id long, url string, text string")
