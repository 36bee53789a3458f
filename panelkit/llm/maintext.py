"""Main text of web pages by consensus of their host.

First pass: every page's containers (``div``, ``article``, ``td`` ...) are scored by the running text they hold; the page
votes for the generalised tag-class path of its best ones, a vote of 1 shared in proportion to the scores. Spark sums the
votes of each host (partial sums before the shuffle, so a host of any size is one small group). Second pass: a page's text
is taken from all containers that stand at its host's first winning path; a page that has none of the host's paths,
or has no host, uses its own best container. Each is widened: to the article (or main) it lies in, else to every next
ancestor that adds running text or headings, not mostly links, and no more than what is held.

Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles are left out by tag and by the
words of class, id and role of any block tag. The words are weighed when the whole page is read: an element that holds a
large article (or main), or most of the page's running text, is kept whatever it is called.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import arrow_rows, col, written

#: Part of its children's score that a container adds to its own.
INHERIT = 0.7
#: Containers with less than this part of the page's best score get no vote.
VOTES_FROM = 0.5
#: An ancestor is taken if at least this part of what it adds is running text or headings.
RUNNING = 0.5
#: An element with this part of the page's running text (comments aside) is kept whatever its hints say.
MOST = 0.75
#: Paths with less than this part of a host's votes are no winners; so a host has at most 20.
LEAST_SHARE = 0.05
#: Characters of all hosts and winning paths that may be broadcast.
BROADCAST_CHARS = 32_000_000
#: Tags whose quotes don't close that are scanned for their quotes; later ones of a page end at the next ``>``.
ODD_TAGS = 16

# What HTML names things.
CONTAINERS = frozenset("html body main article section div aside nav header footer form table tbody thead tfoot tr td th center details dialog fieldset figure menu search".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote address hr figcaption caption summary hgroup legend option head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW = frozenset("script style title textarea noscript iframe template svg select button object audio video canvas noframes xmp".split())
LEFT_OUT = frozenset("nav footer menu search".split())
#: Left out too, unless they hold a large article or main, or (the first two) most of the page's running text.
WEIGHED = frozenset("form fieldset aside dialog".split())
MAY_HOLD_ALL = frozenset("form fieldset".split())
#: Without an end tag they take the rest of the page, as in browsers; the other raw ones are passed over.
TO_THE_END = frozenset("script style textarea title xmp".split())
#: A second start tag ends the first.
NOT_NESTED = frozenset("button select".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside footer masthead topbar toolbar header comment comments disqus respond replies reply "
    "related recommended recommendations share sharing social newsletter subscribe subscription signup login search widget widgets skip outbrain taboola".split()
)
NEVER_HINTED = frozenset(("html", "body", "main", "article"))
#: Words after one of these in the same name tell what an element has or lacks, not what it is (``has-sidebar``).
MODIFIERS = frozenset("has have with without no not non hide hidden".split())
#: In a name with ``header``: the head of the text, not of the site (``post-header``).
OF_TEXT = frozenset("post entry article story content page title".split())
#: Readers' texts may well be longer than what they comment on.
COMMENTS = frozenset("comment comments disqus respond replies reply".split())
#: Their end tags may be left out; the next one of the group ends them.
GROUPS = {**dict.fromkeys(("li",), ("li",)), **dict.fromkeys(("dt", "dd"), ("dt", "dd")), **dict.fromkeys(sorted(HEADINGS), tuple(sorted(HEADINGS)))}

_PLAIN_TAG = re.compile(r"<!--|<!\[CDATA\[|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>")
_TAG = re.compile(r"<!--|<!\[CDATA\[|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>")
#: A tag that the page's end cuts off.
_CUT_OFF = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
_RAW_END = {t: re.compile(rf"</{t}\s*[^>]*>" + (rf"|<{t}(?=[\s/>])" if t in NOT_NESTED else ""), re.IGNORECASE) for t in sorted(RAW)}
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")


@dataclass
class Page:
    """Containers in page order (a container's descendants follow it up to ``end``) and the blocks of text."""

    parent: list[int] = field(default_factory=lambda: [-1])
    end: list[int] = field(default_factory=lambda: [1])
    path: list[int] = field(default_factory=lambda: [0])  # containers with the same labels up to the root share one
    steps: list[tuple[int, str]] = field(default_factory=lambda: [(-1, "")])  # of each path: the path above and the label
    dropped: list[bool] = field(default_factory=lambda: [False])
    tag: list[str] = field(default_factory=lambda: ["#"])
    hints: dict[int, set[str]] = field(default_factory=dict)
    blocks: list[tuple[int, str, int, bool]] = field(default_factory=list)  # container, text, characters in links, heading
    score: list[float] = field(default_factory=list)
    length: list[int] = field(default_factory=list)  # characters of a container that are not dropped
    running: list[float] = field(default_factory=list)  # those of headings, and of other blocks less what links take


def _hints(value: str, in_text: bool) -> set[str]:
    """Hint words of an attribute's value; a header inside an article is none."""
    found = set()
    for name in value.split():
        words = _WORDS.findall(name)
        stop = next((i for i, w in enumerate(words) if w in MODIFIERS), len(words))
        said = HINTS.intersection(words[:stop])
        if "header" in said and (in_text or OF_TEXT.intersection(words)):
            said -= {"header"}
        found |= said
    return found


def _label(tag: str, attrs: str, hints: bool, in_text: bool) -> tuple[str, set[str]]:
    """Generalised ``tag.class`` (numbers as 0) and the words of class, id and role that say it is no main text."""
    if "=" not in attrs:
        return tag, set()
    classes, words = [], set()
    for name, a, b, c in _ATTR.findall(attrs):
        value = (a or b or c).lower()
        if hints:
            words |= _hints(value, in_text)
        if name.lower() == "class":
            classes += _DIGITS.sub("0", value.replace("/", " ")).split()
    return ".".join([tag, *sorted(set(classes))]), words


def parse(source: str, hints: bool = True) -> Page:
    """One scan over the page; unclosed and stray tags are tolerated as browsers do, roughly."""
    page = Page()
    stack, names, inner = [0], ["#"], 0  # inner: open elements that are containers only for a hint around or on them
    paths: dict[tuple[int, str], int] = {}
    opened: Counter = Counter()  # open elements by tag
    lost: set[str] = set()  # raw tags that have no end tag any more
    pieces: list[str] = []
    links, in_link, heading, pos, size = 0, False, False, 0, len(source)
    reach, pattern, odd = source.rfind(">") + 1, _TAG, 0  # no tag ends beyond

    def close() -> None:
        nonlocal links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                page.blocks.append((stack[-1], text, min(links, len(text)), heading))
            pieces.clear()
        links = 0

    def text_to(end: int) -> None:
        nonlocal links
        if end > pos:
            raw = source[pos:end]
            text = html_lib.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if in_link:
                links += len(text.strip())

    def leave() -> str:
        """Close the innermost element."""
        nonlocal inner
        page.end[stack.pop()] = len(page.parent)
        name = names.pop()
        opened[name] -= 1
        inner -= name not in CONTAINERS
        return name

    while True:
        found = pattern.search(source, pos, reach)
        if not found:
            tail = _CUT_OFF.search(source, pos)
            text_to(tail.start() if tail else size)
            break
        text_to(found.start())
        pos = found.end()
        if found.group().startswith("<!--"):
            at = source.find("-->", pos - 2 if source.startswith("<!-->", found.start()) else pos)
            pos = size if at < 0 else at + 3
            continue
        if pattern is _TAG and found.group(5):
            odd += 1
            closing, tag, attrs = found.group(4, 5, 6)
            pattern = _PLAIN_TAG if odd >= ODD_TAGS else _TAG
        else:
            closing, tag, attrs = found.group(1, 2, 3)
        if not tag:
            continue
        tag, attrs = tag.lower(), attrs or ""
        if tag == "br":
            pieces.append(" ")
        elif tag == "a":
            in_link = not closing
        elif tag in RAW and not closing:
            if not attrs.endswith("/") or tag != "svg":
                last = None if tag in lost else _RAW_END[tag].search(source, pos, reach)
                if last and last.group()[1] == "/":
                    pos = last.end()
                elif not last and tag in TO_THE_END:
                    pos = size
                elif not last:
                    lost.add(tag)
            pieces.append(" ")
        elif tag in BLOCKS:
            close()
            heading = tag in HEADINGS and not closing
            in_link = False if tag in CONTAINERS else in_link
            known = None
            if tag not in CONTAINERS and not inner:
                if closing or tag in ("hr", "head") or "=" not in attrs or not hints:
                    continue
                known = _label(tag, attrs, hints, opened["article"] > 0)
                if not known[1]:
                    continue
            if closing:
                if opened[tag]:
                    while leave() != tag:
                        pass
            elif tag not in ("hr", "head"):
                while inner and (names[-1] == "p" or names[-1] in GROUPS.get(tag, ())):
                    leave()
                if tag in ("td", "th", "tr") and opened[tag]:  # their end tags may be left out
                    while names[-1] not in (tag, "table"):
                        leave()
                    if names[-1] == tag:
                        leave()
                up = stack[-1]
                if tag in ("html", "body") and opened[tag]:
                    continue
                label, said = known or _label(tag, attrs, hints, opened["article"] > 0)
                if tag in WEIGHED:
                    said = said | {tag}
                if said:
                    page.hints[len(page.parent)] = said
                inner += tag not in CONTAINERS
                opened[tag] += 1
                key = (page.path[up], label)
                if key not in paths:
                    paths[key] = len(page.steps)
                    page.steps.append(key)
                page.path.append(paths[key])
                page.parent.append(up)
                page.tag.append(tag)
                page.end.append(0)
                out = tag in LEFT_OUT or (tag == "header" and not opened["article"])
                page.dropped.append(page.dropped[up] or out)
                stack.append(len(page.parent) - 1)
                names.append(tag)
    close()
    for c in stack:
        page.end[c] = len(page.parent)
    if page.hints:
        _weigh_hints(page)
    page.score, page.length, page.running = ([0.0] * len(page.parent) for _ in range(3))
    for c, text, linked, title in page.blocks:
        if not page.dropped[c]:
            free = 1 - linked / len(text)
            page.score[c] += len(text) * free * free
            page.length[c] += len(text)
            page.running[c] += len(text) if title else len(text) * free * free
    for c in range(len(page.parent) - 1, 0, -1):
        up = page.parent[c]
        page.score[up] += INHERIT * page.score[c]
        page.length[up] += page.length[c]
        page.running[up] += page.running[c]
    if hints and page.blocks and not any(page.score):
        return parse(source, hints=False)  # everything seemed to be an extra: trust the tags alone
    return page


def _weigh_hints(page: Page) -> None:
    """Drops what hints name, unless it holds one of the page's large articles or mains or most of its running text."""
    count = len(page.parent)
    running, aside = [0.0] * count, bytearray(count)
    for c, said in page.hints.items():
        if said & COMMENTS and page.tag[c] not in NEVER_HINTED and not aside[c]:
            aside[c : page.end[c]] = b"\1" * (page.end[c] - c)
    total = 0.0
    for c, text, linked, _ in page.blocks:
        if not page.dropped[c]:
            free = 1 - linked / len(text)
            running[c] += len(text) * free * free
            total += 0 if aside[c] else len(text) * free * free
    for c in range(count - 1, 0, -1):
        running[page.parent[c]] += running[c]
    keeps = bytearray(count)
    for tag in ("article", "main"):
        found = [c for c in range(count) if page.tag[c] == tag and not page.dropped[c] and c not in page.hints]
        least = VOTES_FROM * max((running[c] for c in found), default=0)
        for c in found:
            if running[c] >= least > 0:
                while c >= 0 and not keeps[c]:
                    keeps[c] = 1
                    c = page.parent[c]
    for c, said in page.hints.items():
        if page.tag[c] in NEVER_HINTED or keeps[c]:
            continue
        never = said & COMMENTS or page.tag[c] in WEIGHED - MAY_HOLD_ALL
        if never or running[c] < MOST * total or not total:
            page.dropped[c] = True
    for c in range(1, count):
        page.dropped[c] = page.dropped[c] or page.dropped[page.parent[c]]


def path_text(page: Page, path: int) -> str:
    labels = []
    while path:
        path, label = page.steps[path]
        labels.append(label)
    return "/".join(reversed(labels))


def page_votes(source: str | None) -> list[tuple[str, float]]:
    """Paths of the page's best containers with shares that add up to 1; nothing if the page has no text."""
    if not source:
        return []
    page = parse(source)
    best = max(page.score)
    if best <= 0:
        return []
    by_path: dict[int, float] = {}
    for path, score in zip(page.path, page.score, strict=True):
        if path and score >= VOTES_FROM * best:
            by_path[path] = max(by_path.get(path, 0.0), score)
    power = {p: (s / best) ** 4 for p, s in by_path.items()}
    total = sum(power.values())
    return [(path_text(page, p), v / total) for p, v in power.items()] if total else []


def widened(page: Page, at: int) -> int:
    """The outermost article (or else the nearest main) around a container; without one, the last ancestor on the way up
    that adds text of which links don't take the most, and no more than it already held."""
    article = main = None
    up = at
    while up >= 0:
        if page.tag[up] == "article":
            article = up
        elif page.tag[up] == "main" and main is None:
            main = up
        up = page.parent[up]
    if article is not None or main is not None:
        return main if article is None else article
    while page.parent[at] >= 0:
        up = page.parent[at]
        more = page.length[up] - page.length[at]
        if more and (page.running[up] - page.running[at] < RUNNING * more or more > page.length[at]):
            break
        at = up
    return at


def main_text(source: str | None, winners: list[str] | None) -> str:
    """Blocks of all containers at the first winning path that the page has, else of its own best container, widened."""
    if not source:
        return ""
    page = parse(source)
    chosen = []
    if winners:
        below = {step: p for p, step in enumerate(page.steps)}
        held: dict[int, list[int]] = {}
        for i, p in enumerate(page.path):
            if page.score[i] > 0:
                held.setdefault(p, []).append(i)
        for w in winners:
            at: int | None = 0
            for label in w.split("/"):
                at = below.get((at, label))
                if at is None:
                    break
            if at and at in held:
                chosen = held[at]
                break
    if not chosen:
        chosen = [max(range(len(page.score)), key=lambda i: (page.score[i], -i))]
    taken = bytearray(len(page.parent))
    for at in sorted({widened(page, c) for c in chosen}):
        if not taken[at]:
            taken[at : page.end[at]] = b"\1" * (page.end[at] - at)
    return "\n\n".join(text for c, text, _, _ in page.blocks if taken[c] and not page.dropped[c])


def host_of(url):
    """Lower-case host of a URL column; null if it has none."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, paths``: winning paths of every host, most votes first (ties by path), from ``pages`` (host, html)."""

    def votes(sources: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("path", pa.string()), ("votes", pa.float64())]))
        return pa.array([[{"path": p, "votes": v} for p, v in page_votes(s)] for s in sources.to_pylist()], kind)

    votes.__annotations__ = {"sources": pa.Array, "return": pa.Array}
    cast = pages.where("host is not null").select("host", F.explode(F.arrow_udf(votes, "array<struct<path:string,votes:double>>")("html")).alias("v"))
    # whole thousandths add up alike in any order
    summed = cast.groupBy("host", "v.path").agg(F.sum(F.round(F.col("v.votes") * 1000).cast("long")).alias("votes"))
    totals = summed.groupBy("host").agg(F.sum("votes").alias("all"))
    lasting = summed.join(totals, "host").where(F.col("votes") >= LEAST_SHARE * F.col("all"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("votes"), "path")))
    return lasting.groupBy("host").agg(ranked.alias("ranked")).select("host", F.col("ranked.path").alias("paths"))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row.

    Null and empty pages give the empty text. Pages without a host (null or odd URLs) use their own containers. Repeated
    rows are pages of their own and vote as often. An empty table gives no rows. Other columns are ignored. The hosts'
    winning paths are measured: up to ``BROADCAST_CHARS`` characters they are broadcast and no page is shuffled, beyond it
    pages meet them in a shuffle join that splits hot hosts. Pages of any length are scanned once, in time that grows with
    their length; a path's text grows with the depth of its container.
    """
    arrow_rows(pages.sparkSession, 500)
    slim = pages.select(col(id_col).alias("page_id"), col(url_col).cast("string").alias("url"), col(html_col).cast("string").alias("html"))
    slim = slim.withColumn("host", host_of(F.col("url")))

    def texts(sources: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([main_text(s, p) for s, p in zip(sources.to_pylist(), paths.to_pylist(), strict=True)], pa.string())

    texts.__annotations__ = {"sources": pa.Array, "paths": pa.Array, "return": pa.Array}
    winners = written(host_paths(slim), "host-paths")
    chars = F.length("host") + F.aggregate("paths", F.lit(0), lambda n, p: n + F.length(p))
    few = (winners.agg(F.sum(chars).alias("n")).first()["n"] or 0) <= BROADCAST_CHARS
    joined = slim.join(F.broadcast(winners) if few else winners, "host", "left")
    out = joined.select("page_id", "url", F.arrow_udf(texts, "string")("html", "paths").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
