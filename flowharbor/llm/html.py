"""Main text of HTML pages by consensus host paths.

Every page's containers are scored by the text that they hold beside links; the best one votes for its generalised
path, a chain of tag.class steps without positions. Votes are summed by host in Spark, and a page's text is then taken
from the containers on its host's winning path, or, where it has none, on its own best one.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, staged, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never read.
RAW = frozenset("script style noscript template svg textarea title iframe object select".split())
#: Boilerplate by tag, by ARIA role and by words of class or id.
SKIP_TAGS = frozenset("nav header footer aside button dialog menu head".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
SKIP_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side "
    "footer header masthead cookie cookies consent notice notices popup modal newsletter subscribe subscription signup share sharing social related recommended "
    "recommendations comment comments commentlist respond reply replies disqus pagination pager widget widgets toolbar login search tags skip".split()
)
#: Words that say nothing beside one of SKIP_WORDS: comment-list is boilerplate, share-price may not be.
NEUTRAL_WORDS = frozenset(
    "list area box container wrap wrapper section block content item items body links link slot unit user reader site page inner outer left right top bottom bar "
    "thread count button buttons icons article post posts entry story blog".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li "
    "main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: A form is boilerplate, unless it wraps the page: at least so many characters, and hardly any text beside it.
FORM_TEXT = 200
#: From this depth on elements no longer are containers of their own: browsers, too, flatten what is nested hundreds deep.
DEPTH = 200
#: Elements that can hold a page's main text.
CONTAINERS = frozenset("article main section div td body".split())
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
#: A start tag ends an open element of these kinds, up to the nearest of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"}),
}
#: A quote opens a value only behind =, and only if it is closed; else the tag ends at the next >.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?", re.S)
_MARKED = re.compile(r">(article|main)(\.[^>]*)?$")
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


@dataclass
class Container:
    path: str
    depth: int
    text: int = 0
    linked: int = 0
    paragraphs: int = 0
    above: tuple[int, ...] = ()

    def score(self) -> float:
        return self.text - 2.0 * self.linked + 25.0 * self.paragraphs


@dataclass
class Page:
    """Text blocks in page order, each with the containers (positions in `containers`) that it lies in, and their linked characters."""

    blocks: list[tuple[str, tuple[int, ...]]] = field(default_factory=list)
    containers: list[Container] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)


def _words(value: str) -> set[str]:
    return {x.lower() for x in _SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()) if x}


def _skipped(tag: str, attributes: dict[str, str]) -> bool:
    if tag in SKIP_TAGS or "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in SKIP_ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return True
    return False


def _suspect(tag: str, attributes: dict[str, str]) -> str:
    """"sure" if a whole class or id consists of boilerplate words, beside neutral ones; "maybe" if one has some
    (has-comments, share-price); "form" for a form; else nothing."""
    if tag in ("body", "html", "main", "article"):
        return ""
    if tag == "form":
        return "form"
    names = [_words(x) for x in f"{attributes.get('class', '')} {attributes.get('id', '')}".split()]
    if any(x - NEUTRAL_WORDS and x - NEUTRAL_WORDS <= SKIP_WORDS for x in names):
        return "sure"
    return "maybe" if any(not SKIP_WORDS.isdisjoint(x) for x in names) else ""


@functools.lru_cache(4096)
def _tag_facts(tag: str, raw: str) -> tuple[str, bool, str]:
    """Of a start tag: its step of a generalised path, whether it is skipped, and what its class words say."""
    attributes = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw else {}
    names = ".".join([tag, *sorted({re.sub(r"\d+", "", x) for x in attributes.get("class", "").lower().split()} - {""})])
    return names, _skipped(tag, attributes), _suspect(tag, attributes)


@functools.lru_cache(64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|$)", re.I)


def _boilerplate(suspects: list[tuple[str, bool]], marked: list[tuple[int, ...]], sizes: dict[tuple[int, ...], int], links: dict[tuple[int, ...], int]) -> set[int]:
    """The suspects that are boilerplate. One that holds the page's only article or main is a wrapper, and so is a "maybe" one
    beside which hardly any text would be kept. A "maybe" one inside an article or main is judged by what it holds: it stays
    unless half its text is links; a form that holds nearly all of the page's text is a wrapper too. `marked`, `sizes` and
    `links` are by the suspects around an article, a text and its links; each is added up once, whatever the suspects."""
    inner, linked, articles = [0] * len(suspects), [0] * len(suspects), [0] * len(suspects)
    held_by: list[list[tuple[int, ...]]] = [[] for _ in suspects]
    for within, n in sizes.items():
        for i in within:
            inner[i] += n
            linked[i] += links[within]
            held_by[i].append(within)
    for within in marked:
        for i in within:
            articles[i] += 1
    active = {i for i, (why, inside) in enumerate(suspects) if why != "maybe" or not inside or 2 * linked[i] >= inner[i]}
    outer = sum(n for within, n in sizes.items() if active.isdisjoint(within))
    elsewhere = any(active.isdisjoint(within) for within in marked)
    for i in sorted(active, key=lambda i: (suspects[i][0] == "sure", i)):
        if elsewhere:
            break
        why = suspects[i][0]
        if articles[i] or (10 * outer < inner[i] and (why == "maybe" or (why == "form" and inner[i] >= FORM_TEXT))):
            active.discard(i)
            outer += sum(sizes[within] for within in held_by[i] if active.isdisjoint(within))
            elsewhere = bool(articles[i]) and any(active.isdisjoint(within) for within in marked)
    return active


def parse(source: str | None) -> Page:
    """Tolerant one-pass reading: unclosed, crossed and cut-off tags are closed as far as needed; a page that ends
    inside an element keeps what came before. Skipped elements leave no block."""
    page, stack = Page(), []  # stack: tag, skip, path, containers, inside a link, suspects around
    text, source = [], source or ""  # text: words, linked characters, suspects around
    blocks, suspects, around = [], [], []  # around: each container's suspects
    pos, size = 0, len(source)
    opened, endless, marks = Counter(), set(), []  # open elements by tag; raw tags of which no end follows; containers that are marked

    def flush() -> None:
        nonlocal text
        if text:
            blocks.append((text, stack[-1][3] if stack else ()))
        text = []

    def close(upto: int) -> None:
        if any(x[0] in BLOCKS for x in stack[upto:]):
            flush()
        opened.subtract(x[0] for x in stack[upto:])
        del stack[upto:]

    def words(raw: str) -> None:
        if raw and not (stack and stack[-1][1]):
            text.append((html.unescape(raw), len(raw.strip()) if stack and stack[-1][4] else 0, stack[-1][5] if stack else ()))

    while pos < size:
        at = source.find("<", pos)
        if at < 0:
            words(source[pos:])
            break
        found = _TOKEN.match(source, at)
        if not found:
            words(source[pos : at + 1])
            pos = at + 1
            continue
        words(source[pos:at])
        pos = found.end()
        if not found[3]:
            continue
        tag = found[3].lower()
        if found[2]:
            if opened[tag]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag in RAW:
            end = None if tag in endless else _end_of(tag).search(source, pos)
            if not end:
                endless.add(tag)
            pos = end.end() if end else (size if tag in ("script", "style", "title", "textarea") else pos)
            continue
        if tag == "br" or tag == "hr":
            text.append((" ", 0, ())) if tag == "br" else flush()
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P and opened["p"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p" or stack[i][0] in CONTAINERS), None)
            if depth is not None and stack[depth][0] == "p":
                close(depth)
        if tag in IMPLIED and any(opened[x] for x in IMPLIED[tag][0]):
            ends, bound = IMPLIED[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in bound:
                    break
                if stack[i][0] in ends:
                    close(i)
                    break
        if tag in BLOCKS:
            flush()
        names, skipped, why = _tag_facts(tag, found[4] or "")
        above = stack[-1] if stack else ("", False, "", (), False, ())
        flat = len(above[3]) >= DEPTH or len(above[5]) >= DEPTH or len(above[2]) >= 64 * DEPTH
        path = f"{above[2]}>{names}" if tag in BLOCKS and not flat else above[2]
        skip, inside = above[1] or skipped, above[3]
        within = above[5]
        if why and not skip and not flat:
            suspects.append((why, any(marks[i] for i in inside)))
            within = (*within, len(suspects) - 1)
        if tag in CONTAINERS and not skip and not flat:
            marks.append(bool(_MARKED.search(path)))
            page.containers.append(Container(path, len(inside), above=inside))
            around.append(within)
            inside = (*inside, len(page.containers) - 1)
        if not found[0].rstrip().endswith("/>") or tag in BLOCKS:
            stack.append((tag, skip, path, inside, above[4] or tag == "a", within))
            opened[tag] += 1
    flush()
    return _settled(page, blocks, suspects, around)


def _settled(page: Page, blocks: list, suspects: list[tuple[str, bool]], around: list[tuple[int, ...]]) -> Page:
    """The page without the suspects that are boilerplate."""
    sizes, links, held = {}, {}, set()
    for pieces, inside in blocks if suspects else ():
        for raw, linked, within in pieces:
            sizes[within] = sizes.get(within, 0) + len(raw.strip())
            links[within] = links.get(within, 0) + linked
            held.update(inside if raw.strip() else ())
    marked = [around[i] for i in sorted(held) if _MARKED.search(page.containers[i].path)]
    gone = _boilerplate(suspects, marked, sizes, links)
    kept = [i for i, within in enumerate(around) if gone.isdisjoint(within)]
    place = {old: new for new, old in enumerate(kept)}
    out = Page(containers=[page.containers[i] for i in kept])
    for box in out.containers:
        box.above = tuple(place[i] for i in box.above if i in place)
    for pieces, inside in blocks:
        pieces = [x for x in pieces if gone.isdisjoint(x[2])]
        block = " ".join("".join(x[0] for x in pieces).split())
        if block:
            inside, linked = tuple(place[i] for i in inside if i in place), sum(x[1] for x in pieces)
            out.blocks.append((block, inside))
            out.linked.append(linked)
            for i in inside:
                box = out.containers[i]
                box.text += len(block)
                box.linked += linked
                box.paragraphs += len(block) >= 40
    return out


def best(page: Page) -> Container | None:
    """The deepest container that holds nearly all of what the page's best-scored one holds, then the outermost around it
    whose own blocks belong to the text; a semantic article or main element goes before others."""
    if not page.containers:
        return None
    marked = [c for c in page.containers if _MARKED.search(c.path) and c.text]
    pool = marked or page.containers
    top = max(c.score() for c in pool)
    chosen = max((c for c in pool if c.score() >= 0.9 * top - 1e-9), key=lambda c: (c.depth, c.score()))
    for i in reversed(chosen.above):
        wider = page.containers[i]
        if any(wider is c for c in pool) and wider.text > chosen.text:
            if not _extends(page, wider, chosen):
                break
            chosen = wider
    return chosen


def _extends(page: Page, wider: Container, chosen: Container) -> bool:
    """True if what `wider` adds are blocks of its own, and neither these nor a container beside `chosen` are mostly links."""
    at, inner = (next(i for i, c in enumerate(page.containers) if c is x) for x in (wider, chosen))
    text, linked = {}, {}
    for (block, inside), n in zip(page.blocks, page.linked, strict=True):
        if at in inside and inner not in inside:
            child = next((i for i in inside[inside.index(at) + 1 :]), at)
            text[child] = text.get(child, 0) + len(block)
            linked[child] = linked.get(child, 0) + n
    return at in text and all(2 * linked[x] <= text[x] for x in text)


def ballot(source: str | None) -> tuple[str | None, float]:
    chosen = best(parse(source))
    return (chosen.path, max(0.0, chosen.score())) if chosen else (None, 0.0)


def extract(source: str | None, path: str | None) -> str:
    """Blocks inside containers on `path`; if the page has none with text, inside its own best one; else all blocks."""
    page = parse(source)
    boxes = {i for i, c in enumerate(page.containers) if c.path == path}
    if not any(boxes.intersection(inside) for _, inside in page.blocks):
        own = best(page)
        boxes = {i for i, c in enumerate(page.containers) if own and c.path == own.path}
    kept = [b for b, inside in page.blocks if boxes.intersection(inside)] if boxes else [b for b, _ in page.blocks]
    return "\n".join(kept)


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages plus `main_text` (empty for a null or textless page); a column of that name is replaced.

    Votes are (host, path) sums, partly added up before they are shuffled, and one winner a host is joined back to pages
    as a column; a hot host's pages are not gathered. Of paths with equal votes the higher sum of scores wins, then the
    first by name. Pages without a host share the null one; repeated rows vote and are extracted each; an empty table
    gives no rows.
    """
    own = [F.col(f"`{c}`") for c in pages.columns if c.lower() != "main_text"]
    host = F.lower(F.regexp_extract(F.col(url_col), _HOST, 1))

    @F.pandas_udf("path string, score double")
    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for sources in batches:
            yield pd.DataFrame([ballot(s) for s in sources], columns=["path", "score"])

    @F.pandas_udf("string")
    def take(sources: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([extract(s, p) for s, p in zip(sources, paths, strict=True)], dtype=object)

    votes = pages.select(host.alias("__host"), vote(F.col(html_col)).alias("v")).where(F.col("v.path").isNotNull())
    sums = votes.groupBy("__host", F.col("v.path").alias("path")).agg(F.count("*").alias("n"), F.sum("v.score").alias("score"))
    first = F.row_number().over(Window.partitionBy("__host").orderBy(F.desc("n"), F.desc(F.round("score", 3)), "path"))
    winners = staged(sums.withColumn("nth", first).where("nth = 1").select(F.col("__host").alias("__voter"), F.col("path").alias("__path")), "paths")
    joined = pages.select(*own, host.alias("__host")).join(winners, F.col("__host").eqNullSafe(F.col("__voter")), "left")
    return joined.select(*own, take(F.col(html_col), F.col("__path")).alias("main_text"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    out = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
