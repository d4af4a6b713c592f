"""Main text of web pages by consensus paths of their hosts.

Every page is parsed into containers and blocks of text. A block's characters, less those of its
links, count for its container and half for the one around it. From the best container a page climbs
to the article element around it, else while the next one around holds more of the text: blocks of
its own, or containers beside with a sentence. It votes for what it has reached by a generalised path
of tags and first classes (digits made 0). Spark counts the votes of a host's pages, and every page is
read again: of the host's winning paths (the leader, and any with a quarter of the votes) that the
page has, the one with the most text gives its text; else the page's own container.

Parts of the page furniture never count as text. Their tag, role, or a class or id tells them: a
furniture word beside nothing but words of layout, or any of the surest words. A name that has a
furniture word beside others ("social-studies") is in doubt: the host's pages vote on its path too,
and it is furniture if most of the pages that have it, equal pages counted once, have a text there
that another page has as well.

Null pages are empty; pages without text give the empty text; urls without a host vote together; an
empty table gives no rows. Of equal scores the first container in the page wins, of equal votes the
one with more text, then the larger path hash. Repeated rows are extracted each on its own. Parsing
takes linear time, so very long and very deep pages are read whole. Other columns of pages play no part."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import mapped, staged
from .url_rules import parts

BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: What text stands in inside a container, and is none itself.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 hgroup ul ol dl li dt dd pre blockquote table thead tbody tfoot tr td th figure figcaption details summary legend address center".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
FURNITURE_TAGS = frozenset("nav header footer aside form script style noscript template iframe object button select option textarea input svg math head title menu dialog".split())
#: Words of furniture; beside any other word; only alone or beside words of layout.
SURE_WORDS = frozenset("advert advertisement adverts breadcrumb breadcrumbs comment comments cookie cookies disqus footer menu nav navbar navigation newsletter pagination sidebar sponsored toolbar".split())
OPEN_WORDS = frozenset("ad ads adv banner consent header notice notices pager popup promo promotion related share sharing social sponsor subscribe widget".split())
LAYOUT_WORDS = frozenset("a area bar block bottom box button buttons center col column container content fixed float global group head holder icon icons inline inner item items left link links list main media mobile module news outer page panel placeholder post posts right row section side site slot small sticky text title top unit wide wrap wrapper".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_DIGITS = re.compile(r"\d+")
_SPLIT = re.compile(r"[\W_]+|(?<=[a-z])(?=[A-Z])")
_RAW_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
#: Start tags that end an open paragraph or sibling.
_ENDS = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}


NONE, DOUBT, FURNITURE = 0, 1, 2
_SCOPES = ("table", "ul", "ol", "dl", "article", "section", "div", "body")
_SENTENCE = re.compile(r"[.!?\u2026\u3002][\"'\u201d\u2019)]*$")
#: Least share of a host's votes that makes a path a winner beside the leader, as one in how many.
SHARE = 4


class Page(NamedTuple):
    #: Each element's parent, tag and path, the last as a signed hash of tags and classes from the root.
    parents: list[int]
    tags: list[str]
    paths: list[int]
    #: Whether it is furniture, or in doubt.
    kinds: list[int]
    #: Each block's element, text and characters of links; blocks in furniture are left out.
    blocks: list[tuple[int, str, int]]


def _kind(tag: str, attributes: dict[str, str]) -> int:
    if tag in FURNITURE_TAGS or attributes.get("role", "").lower() in FURNITURE_ROLES:
        return FURNITURE
    if tag in ("html", "body", "article", "main"):
        return NONE
    kind = NONE
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = {w.lower() for w in _SPLIT.split(name) if w and not w.isdigit()}
        if words & SURE_WORDS or words & OPEN_WORDS and words <= OPEN_WORDS | LAYOUT_WORDS:
            return FURNITURE
        if words & OPEN_WORDS:
            kind = DOUBT
    return kind


def parse(html: str | None) -> Page:
    html = html or ""
    parents, tags, paths, kinds = [-1], [""], [0], [NONE]
    blocks: list[tuple[int, str, int]] = []
    #: Open elements: tag, number, the nearest that makes blocks, and whether furniture or a link is around.
    stack: list[tuple[str, int, int, bool, bool]] = [("", 0, 0, False, False)]
    opened: dict[str, list[int]] = {}  # depths in stack by tag
    pieces: list[str] = []
    links = at = owner = 0

    def end_block() -> None:
        nonlocal links
        text = " ".join(unescape("".join(pieces)).split())
        if text:
            blocks.append((owner, text, links))
        pieces.clear()
        links = 0

    def text_piece(text: str) -> None:
        nonlocal owner, links
        _, _, nearest, hidden, linked = stack[-1]
        if text and not hidden:
            if not pieces:
                owner = nearest
            pieces.append(text)
            if linked:
                links += len(text)

    def push(tag: str, number: int) -> None:
        _, _, nearest, hidden, linked = stack[-1]
        opened.setdefault(tag, []).append(len(stack))
        stack.append((tag, number, number if tag in BLOCKS else nearest, hidden or kinds[number] == FURNITURE, linked or tag == "a"))

    def pop_to(depth: int) -> None:
        if any(e[0] in BLOCKS for e in stack[depth:]):
            end_block()
        for e in reversed(stack[depth:]):
            opened[e[0]].pop()
        del stack[depth:]

    while True:
        m = _TAG.search(html, at)
        text_piece(html[at : m.start()] if m else html[at:])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if opened.get(tag):
                pop_to(opened[tag][-1])
            elif tag in BLOCKS:
                end_block()
            continue
        if tag in ("br", "wbr"):
            text_piece(" " if tag == "br" else "")
            continue
        if tag in BLOCKS:
            scope = max((opened[t][-1] for t in _SCOPES if opened.get(t)), default=0)
            inside = [own[k] for t in _ENDS.get(tag, "p").split() if (own := opened.get(t)) and (k := bisect_right(own, scope)) < len(own)]
            if inside:
                pop_to(min(inside))
            end_block()
        attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(m[3])}
        parent, number = stack[-1][1], len(parents)
        name = f"{tag}.{_DIGITS.sub('0', (attributes.get('class', '').split() or [''])[0])}"
        parents.append(parent)
        tags.append(tag)
        paths.append((xxh3_64_intdigest(name, paths[parent] & (1 << 64) - 1) ^ 1 << 63) - (1 << 63))
        kinds.append(_kind(tag, attributes))
        if tag in RAW:
            end = _RAW_ENDS[tag].search(html, at)
            raw, at = html[at : end.start() if end else len(html)], end.end() if end else len(html)
            push(tag, number)
            text_piece(raw)
            opened[tag].pop()
            stack.pop()
        elif tag not in VOID and not m[3].endswith("/"):
            push(tag, number)
    end_block()
    return Page(parents, tags, paths, kinds, blocks)


def _sums(page: Page) -> tuple[list[int], list[int], list[bool]]:
    """Of each element: characters less those of links in it, in blocks whose container it is, and whether it holds a sentence."""
    whole, own, told = [0] * len(page.parents), [0] * len(page.parents), [False] * len(page.parents)
    for element, text, links in page.blocks:
        gain = max(0, len(text) - 3 * links)
        whole[element] += gain
        own[_container(page, element)] += gain
        told[element] |= gain >= 25 and bool(_SENTENCE.search(text))
    for e in range(len(page.parents) - 1, 0, -1):  # parents come first
        whole[page.parents[e]] += whole[e]
        told[page.parents[e]] |= told[e]
    return whole, own, told


def _container(page: Page, element: int) -> int:
    while page.parents[element] > 0 and page.tags[element] in LEAVES:
        element = page.parents[element]
    return element


def best(page: Page) -> int:
    """The element that a page takes for its article; 0 if it has no text."""
    whole, own, told = _sums(page)
    scores: dict[int, float] = {}
    for e, gain in enumerate(own):
        if gain and e:
            scores[e] = scores.get(e, 0.0) + gain
            if page.parents[e] > 0:
                scores[page.parents[e]] = scores.get(page.parents[e], 0.0) + gain / 2
    if not scores:
        return 0
    at = min(scores, key=lambda e: (-scores[e], e))
    e, article = at, 0
    while e > 0:
        if page.tags[e] == "article":
            article = e
        e = page.parents[e]
    if article:
        return article
    children: dict[int, list[int]] = {}
    for e, parent in enumerate(page.parents):
        if whole[e]:
            children.setdefault(parent, []).append(e)
    while (up := page.parents[at]) > 0 and page.tags[up] not in ("body", "html") and page.tags[at] != "main":
        beside = [e for e in children.get(up, ()) if e != at and page.tags[e] not in LEAVES]
        if whole[up] > whole[at] and not own[up] and not any(told[e] for e in beside):
            break
        if whole[up] == whole[at] and not _more(page, up, whole[at], whole):
            break
        at = up
    return at


def _more(page: Page, element: int, held: int, whole: list[int]) -> bool:
    """Whether an element around, below the body, holds more text than that."""
    while element > 0 and page.tags[element] not in ("body", "html"):
        if whole[element] > held:
            return True
        element = page.parents[element]
    return False


def doubts(page: Page) -> list[tuple[int, int]]:
    """(path, hash of its text) of the outermost elements in doubt that have text."""
    inside, texts = [-1] * len(page.parents), {}
    for e, parent in enumerate(page.parents):
        inside[e] = inside[parent] if parent >= 0 and inside[parent] >= 0 else e if page.kinds[e] == DOUBT else -1
    for element, text, _ in page.blocks:
        if inside[element] >= 0:
            texts.setdefault(inside[element], []).append(text)
    return [(page.paths[e], xxh3_64_intdigest("\n".join(t)) >> 1) for e, t in texts.items()]


def without(page: Page, furniture: set[int]) -> Page:
    """The page with the elements in doubt on those paths as furniture."""
    hidden = [False] * len(page.parents)
    for e, parent in enumerate(page.parents):
        hidden[e] = parent >= 0 and hidden[parent] or page.kinds[e] == DOUBT and page.paths[e] in furniture
    return page._replace(blocks=[b for b in page.blocks if not hidden[b[0]]])


def extract(page: Page, leaders: list[int] | None = None) -> str:
    """The text inside the elements on the leading path with the most text here, else inside the page's own container."""
    inside: dict[int, list[bool]] = {}
    for path in dict.fromkeys(leaders or ()):
        own = inside[path] = [False] * len(page.parents)
        for e, parent in enumerate(page.parents):
            own[e] = page.paths[e] == path or (parent >= 0 and own[parent])
    size = {path: sum(max(0, len(t) - 3 * k) for e, t, k in page.blocks if own[e]) for path, own in inside.items()}
    if size and max(size.values()) > 0:
        own = inside[max(size, key=size.get)]
    else:
        chosen = best(page)
        own = [False] * len(page.parents)
        for e, parent in enumerate(page.parents):
            own[e] = bool(chosen) and e == chosen or (parent >= 0 and own[parent])
        if not chosen:  # text that no element holds
            own[0] = True
    return "\n\n".join(text for element, text, _ in page.blocks if own[element])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) for each row of pages."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("host", parts(F.col("url"))[0])

    def vote(batches: Iterator[dict]) -> Iterator[dict]:
        """A row for the page's container, text 0, and one for each element in doubt; score: characters in it."""
        for batch in batches:
            out: dict = {"host": [], "path": [], "doubt": [], "text": [], "page": [], "score": []}
            for host, html in zip(batch["host"], batch["html"], strict=True):
                page = parse(html)
                chosen = best(page)
                own = xxh3_64_intdigest("\n".join(t for _, t, _ in page.blocks)) >> 1
                made = [(page.paths[chosen], False, 0, 0, _sums(page)[0][chosen])] if chosen else []
                for path, doubt, text, number, score in [*made, *((p, True, t, own, 0) for p, t in doubts(page))]:
                    for c, v in zip(out, (host, path, doubt, text, number, score), strict=True):
                        out[c].append(v)
            yield out

    votes = mapped(rows.select("host", "html"), vote, "host string, path long, doubt boolean, text long, page long, score long")
    # Combined before the shuffle, whatever share of pages one host has; equal pages are one in matters of doubt.
    votes = staged(votes.groupBy("host", "path", "doubt", "text", "page").agg(F.count("*").alias("votes"), F.sum("score").alias("score")), "votes")
    counted = votes.where("not doubt").select("host", "path", "votes", "score")
    hosts = counted.groupBy("host").agg(F.sum("votes").alias("all"), F.max(F.struct("votes", "score", "path")).alias("best"))
    winners = counted.join(hosts, "host").where(f"votes * {SHARE} >= all or path = best.path")
    winners = winners.groupBy("host").agg(F.array_sort(F.collect_list("path")).alias("leaders"))  # at most SHARE + 1
    doubted = votes.where("doubt").groupBy("host", "path", "text").agg(F.count("*").alias("pages")).groupBy("host", "path")
    doubted = doubted.agg(F.sum("pages").alias("pages"), F.sum(F.when(F.col("pages") > 1, F.col("pages")).otherwise(0)).alias("alike"))
    dropped = doubted.where("2 * alike > pages").groupBy("host").agg(F.array_sort(F.collect_list("path")).alias("furniture"))
    told = staged(winners.join(dropped, "host", "full"), "leaders")

    def read(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            texts = [extract(without(parse(h), set(f or ())), lead) for h, lead, f in zip(batch["html"], batch["leaders"], batch["furniture"], strict=True)]
            yield {"id": batch["id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    joined = rows.join(told, "host", "left").select("id", "url", "html", "leaders", "furniture")
    return mapped(joined, read, f"id {dict(rows.dtypes)['id']}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
