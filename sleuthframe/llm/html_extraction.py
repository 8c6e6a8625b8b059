"""Main text of web pages through wrappers, union-free regular expressions inferred from all pages of a host.

A page becomes a tree of blocks. Its token stream is folded where siblings repeat, then aligned with those of other pages of its
host, one after another: what only one side has becomes optional, what repeats becomes a group, texts that differ become a slot.
Every task infers wrappers of its own pages; wrappers of a host are then aligned with each other, ``FAN_IN`` at a time, until one is
left, so no task sees all pages of a host. A wrapper says once for a host which slots are main text; each page is matched with
the wrapper of its host and gives the texts of these slots.
"""

from __future__ import annotations

import functools
import html as character_references
import json
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import discard, materialize

#: Wrappers that one task aligns in a round.
FAN_IN = 32
#: Hosts with more than this share of the pages (so at most 1,000 of them) get their wrappers by broadcast.
HEAVY = 1_000
#: Hosts whose wrappers a task holds before it hands them on.
HOSTS = 2_000
#: Longest repeated group looked for, siblings of a wrapper's node (beyond, one repeated group of optional items), levels of a tree.
PERIOD, WIDTH, DEPTH = 4, 48, 64
#: Pages in which a text has to be the same to count as part of the template.
TEMPLATE_PAGES = 10

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]{0,4000}+\"|'[^']{0,4000}+'|[\"'])*+)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "math", "select", "object", "audio", "video", "canvas"}
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What a start tag closes, up to the nearest of the tags after it.
ITEM = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
NOT_MAIN_TAGS = {"head", "nav", "header", "footer", "aside", "form", "dialog", "menu", "search", "fieldset"}
NOT_MAIN = set("ad ads adbox adslot adsense adunit banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup sidebar sidenav nav navbar navigation menu menubar breadcrumb breadcrumbs toolbar topbar masthead footer header comment comments commentlist disqus reply replies respond related recommended share sharing social widget widgets popup modal overlay login search pagination pager copyright complementary contentinfo".split())
NOT_MAIN_STARTS = ("advert", "sponsor", "promo")
MAIN = set("article articlebody content post entry story main maincontent".split())

# A node of a page is [label, children, text, link characters]; a text has the label "#" and no children. An item of a wrapper is
# [label, optional, repeated, pages, characters, link characters, hash of the text or None where it differs, items].
LABEL, OPTIONAL, REPEATED, PAGES, CHARS, LINKED, TEXT, ITEMS = range(8)
GROUP = "()"


def words_of(attributes: str) -> str:
    """The words of class, id, role and itemprop, numbers left out."""
    found = " ".join(next(filter(None, m[1:]), "") for m in ATTRIBUTE.findall(attributes))
    return " ".join(sorted(set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", found).lower()))))


def page_tree(html: str) -> list:
    """The blocks of a page as nodes; tags inside lines only join their texts, a line break is white space."""
    root: list = ["html", [], "", 0]
    stack, parts, linked, in_link, at = [root], [], 0, 0, 0

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join(character_references.unescape("".join(parts)).split())
        if text:
            stack[-1][1].append(["#", [], text, min(linked, len(text))])
        parts, linked = [], 0

    def close(tags: set[str], until: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            tag = stack[i][0].split(" ", 1)[0]
            if tag in tags:
                del stack[i:]
                return
            if tag in until:
                return

    while True:
        m = TOKEN.search(html, at)
        between = html[at : m.start() if m else len(html)]
        if between:
            parts.append(between)
            linked += len(between) if in_link else 0
        if not m:
            flush()
            return root[1]
        at, tag = m.end(), (m[2] or "").lower()
        if tag in RAW:
            if not m[1] and not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = not m[1]
        if tag not in BLOCKS:
            continue
        flush()
        in_link = 0
        if m[1]:
            close({tag}, set())
        elif tag not in ("html", "body"):
            close({"p"}, BLOCKS - {"p"})
            if tag in ITEM:
                close(*ITEM[tag])
            if tag != "hr":
                node = [f"{tag} {words_of(m[3])}".rstrip(), [], "", 0]
                stack[-1][1].append(node)
                if len(stack) < DEPTH:
                    stack.append(node)


def labels(items: list) -> list[str]:
    return [x[LABEL] for x in items]


def joined(a: list, b: list, pages: bool) -> list:
    """One item for two of one label; pages add up unless both are of one page."""
    count = a[PAGES] + b[PAGES] if pages else max(a[PAGES], b[PAGES])
    text = a[TEXT] if a[TEXT] == b[TEXT] else None
    return [a[LABEL], a[OPTIONAL] | b[OPTIONAL], a[REPEATED] | b[REPEATED], count, a[CHARS] + b[CHARS], a[LINKED] + b[LINKED], text, aligned(a[ITEMS], b[ITEMS], pages)]


def group(items: list) -> list:
    return [GROUP, 0, 1, max(x[PAGES] for x in items), 0, 0, None, items]


def folded(items: list) -> list:
    """``items`` with neighbours that repeat joined: single ones first, then groups of up to ``PERIOD``."""
    for period in range(1, PERIOD + 1):
        out, i = [], 0
        while i < len(items):
            names = labels(items[i : i + period])
            if GROUP not in names[1:] and len(names) == period and names == labels(items[i + period : i + 2 * period]) and (period > 1 or names != [GROUP]):
                unit = items[i : i + period]
                while names == labels(items[i + period : i + 2 * period]):
                    i += period
                    unit = [joined(a, b, False) for a, b in zip(unit, items[i : i + period])]
                if period == 1:
                    unit[0][REPEATED] = 1
                    out.append(unit[0])
                else:
                    out.append(group(unit))
                i += period
            else:
                out.append(items[i])
                i += 1
        items = out
    return items if len(items) <= WIDTH else loose(items)


def loose(items: list) -> list:
    """One repeated group of optional items, one for each label: every sequence of these labels matches it."""
    found: dict[str, list] = {}
    for x in items:
        for y in x[ITEMS] if x[LABEL] == GROUP else [x]:
            found[y[LABEL]] = joined(found[y[LABEL]], y, False) if y[LABEL] in found else y
    return [group([[x[LABEL], 1, *x[REPEATED:]] for x in found.values()])]


def grouped_like(items: list, other: list) -> list:
    """``items`` with single runs of what the other side has as a repeated group made such groups."""
    for names in {tuple(labels(x[ITEMS])) for x in other if x[LABEL] == GROUP}:
        out, i = [], 0
        while i < len(items):
            if tuple(labels(items[i : i + len(names)])) == names:
                out.append(group(items[i : i + len(names)]))
                i += len(names)
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def aligned(a: list, b: list, pages: bool = True) -> list:
    """The items that match both sequences: a longest common subsequence of labels is joined, the rest becomes optional."""
    if labels(a) == labels(b):
        return [joined(x, y, pages) for x, y in zip(a, b)]
    a, b = grouped_like(a, b), grouped_like(b, a)
    if any(len(x) == 1 and x[0][LABEL] == GROUP and all(y[OPTIONAL] for y in x[0][ITEMS]) for x in (a, b)):
        return loose(a + b)
    n, m = len(a), len(b)
    longest = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            longest[i][j] = longest[i + 1][j + 1] + 1 if a[i][LABEL] == b[j][LABEL] else max(longest[i + 1][j], longest[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][LABEL] == b[j][LABEL]:
            out.append(joined(a[i], b[j], pages))
            i, j = i + 1, j + 1
        elif j == m or (i < n and longest[i + 1][j] >= longest[i][j + 1]):
            out.append([a[i][LABEL], 1, *a[i][REPEATED:]])
            i += 1
        else:
            out.append([b[j][LABEL], 1, *b[j][REPEATED:]])
            j += 1
    return folded(out)


def wrapper_of(nodes: list) -> list:
    """The wrapper of one page."""
    items = [[n[0], 0, 0, 1, len(n[2]), n[3], zlib.crc32(n[2].encode("utf-8", "replace")) if n[0] == "#" else None, wrapper_of(n[1])] for n in nodes]
    return folded(items)


def is_not_main(label: str, inside: bool) -> bool:
    """Whether a block is a menu, a header and so on by its tag and words; ``inside``: within the main text."""
    tag, *words = label.split(" ")
    if tag in NOT_MAIN_TAGS and not (inside and tag == "header"):
        return True
    if MAIN.intersection(words) and "comment" not in words and "comments" not in words:
        words = [w for w in words if w not in ("header", "footer", "notice", "share")]
    return tag != "#" and any(w in NOT_MAIN or w.startswith(NOT_MAIN_STARTS) for w in words)


def own_chars(item: list) -> int:
    """Characters of texts outside links below an item that no tag or word excludes."""
    if is_not_main(item[LABEL], False):
        return 0
    return max(item[CHARS] - 2 * item[LINKED], 0) + sum(map(own_chars, item[ITEMS]))


def regions(items: list, found: Callable[[str, str], object]) -> list:
    """The topmost items for which ``found`` holds, but for what tags or words exclude."""
    out = []
    for x in items:
        if not is_not_main(x[LABEL], False):
            out += [x] if found(*x[LABEL].partition(" ")[::2]) else regions(x[ITEMS], found)
    return out


#: What marks main text, the surest first.
MARKS = (
    lambda tag, words: tag == "article" or "articlebody" in words.split() or {"article", "body"} <= set(words.split()),
    lambda tag, words: tag == "main" or "main" in words.split(),
    lambda tag, words: MAIN & set(words.split()),
)


def main_region(items: list) -> list:
    """The items that hold the main text: articles, else what is marked as main or content, else where most characters are."""
    for found in MARKS:
        chosen = [x for x in regions(items, found) if own_chars(x)]
        if chosen:
            return chosen
    while True:
        sizes = [own_chars(x) for x in items]
        most = max(sizes, default=0)
        if not most or most < 0.6 * sum(sizes) or not items[sizes.index(most)][ITEMS]:
            return [x for x, size in zip(items, sizes) if size]
        items = items[sizes.index(most)][ITEMS]


def texts(item: list) -> Iterator[list]:
    if item[LABEL] == "#":
        yield item
    for x in item[ITEMS]:
        yield from texts(x)


def marked(items: list) -> list:
    """The wrapper for matching: [label, repeated, whether its text is main, items]."""
    chosen = main_region(items)
    of_region = {id(x) for x in chosen}
    varies = any(t[TEXT] is None for x in chosen for t in texts(x))

    def mark(x: list, inside: bool, parent: str) -> list:
        inside = inside or id(x) in of_region
        if id(x) not in of_region and is_not_main(x[LABEL], inside):
            return [x[LABEL], x[REPEATED], 0, []]
        of_template = varies and x[TEXT] is not None and x[PAGES] >= TEMPLATE_PAGES and parent.split(" ")[0] not in HEADINGS
        main = inside and x[LABEL] == "#" and not of_template and (2 * x[LINKED] <= x[CHARS] or parent.split(" ")[0] in {"p", *HEADINGS})
        return [x[LABEL], x[REPEATED], int(main), [mark(y, inside, parent if x[LABEL] == GROUP else x[LABEL]) for y in x[ITEMS]]]

    return [mark(x, False, "") for x in items]


def flat(items: list, start: int = 0) -> list[tuple[list, int]]:
    """The items with groups opened; each with the place to which a repetition of its group goes back (or -1)."""
    out: list[tuple[list, int]] = []
    for x in items:
        if x[0] == GROUP:
            first = start + len(out)
            out += [(y, first if back < 0 else back) for y, back in flat(x[3], first)]
        else:
            out.append((x, -1))
    return out


def main_texts(nodes: list, items: list) -> Iterator[str]:
    """The texts of the slots of main text, in page order. A node is the next item of its label, or an earlier one of its group."""
    places, at = flat(items), 0
    for n in nodes:
        here = [i for i, (x, _) in enumerate(places) if x[0] == n[0]]
        back = places[at][1] if at < len(places) else -1
        i = next((i for i in here if i >= at), None)
        if back >= 0 and (i is None or places[i][1] != back):
            i = next((k for k in here if k >= back and places[k][1] == back), i)
        if i is None:
            i = here[-1] if here else None
        if i is None:
            continue
        at = i
        item = places[i][0]
        if n[0] == "#":
            if item[2]:
                yield n[2]
        else:
            yield from main_texts(n[1], item[3])
        if not item[1] and places[i][1] < 0:
            at = i + 1


def text_of_page(html: str, wrapper: list) -> str:
    """The texts of the wrapper's slots. A page of another kind than the host's others, which reaches none of them and has no block
    marked as main, is judged by its own blocks."""
    nodes = page_tree(html)
    found = list(main_texts(nodes, wrapper))
    if not found:
        own = wrapper_of(nodes)
        if not any(regions(own, MARKS[0])):
            found = list(main_texts(nodes, marked(own)))
    return "\n\n".join(found)


def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) to the wrappers that this task's pages give."""
    found: dict[str, list] = {}
    for batch in batches:
        for host, html in zip(batch["host"].to_pylist(), batch["html"].to_pylist()):
            own = [1, wrapper_of(page_tree(html))]
            found[host] = [found[host][0] + 1, aligned(found[host][1], own[1])] if host in found else own
        if len(found) > HOSTS:
            yield handed(found)
            found = {}
    yield handed(found)


def handed(found: dict[str, list]) -> pa.RecordBatch:
    rows = [(h, n, json.dumps(w, separators=(",", ":"))) for h, (n, w) in sorted(found.items())]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (pa.string(), pa.int64(), pa.string()))], ["host", "pages", "wrapper"])


def unite(table: pa.Table) -> pa.Table:
    """Wrappers of one host, in a fixed order, to one."""
    rows = sorted(zip(table["pages"].to_pylist(), table["wrapper"].to_pylist()), key=lambda r: (-r[0], r[1]))
    wrapper = functools.reduce(aligned, (json.loads(w) for _, w in rows))
    return pa.Table.from_batches([handed({table["host"][0].as_py(): [sum(n for n, _ in rows), wrapper]})])


def mark_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["host"], batch["pages"], pa.array([json.dumps(marked(json.loads(w)), separators=(",", ":")) for w in batch["wrapper"].to_pylist()], pa.string())], ["host", "pages", "wrapper"])


SCHEMA = "host string, pages long, wrapper string"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, pages, wrapper): one wrapper for each host of ``pages`` (host, html)."""
    found = materialize(pages.mapInArrow(infer, SCHEMA), "wrappers")
    while True:
        most = found.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return found
        place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("pages"), F.xxhash64("wrapper")))
        once = materialize(found.withColumn("part", F.floor((place - 1) / FAN_IN)).groupBy("host", "part").applyInArrow(unite, SCHEMA), "wrappers")
        discard(found)
        found = once


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = functools.lru_cache(256)(json.loads)
    for batch in batches:
        found = [text_of_page(html, known(wrapper)) for html, wrapper in zip(batch["html"].to_pylist(), batch["wrapper"].to_pylist())]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages`` (page_id, url, html).

    Blocks are joined by two line feeds; white space (Unicode's, no-break spaces too) inside a block becomes one space, and so does
    a line break; headings of the article belong to it. A null html is empty, and a page without main text gives an empty text.
    Pages with a null url, or without a host in it, share a wrapper. Repeated rows each give a row; an empty table gives no rows;
    other columns are not read. Unclosed tags, comments and scripts end with the page.
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    found = wrappers(rows.select("host", "html"))
    total = found.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    ready = materialize(found.mapInArrow(mark_all, SCHEMA), "wrappers")
    discard(found)
    heavy = F.col("pages") * HEAVY > total
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    columns = ["page_id", "url", "html", "wrapper"]
    first = rows.join(F.broadcast(ready.where(heavy).select("host", "wrapper")), "host").select(*columns).mapInArrow(extract, schema)
    light = ready.where(~heavy).select("host", "wrapper")
    if light.isEmpty():
        return first
    return first.unionByName(rows.join(light, "host").select(*columns).mapInArrow(extract, schema))


#: What the pages of the given tables hold: articles marked as such, whose only blocks are headings and paragraphs.
ORACLE = r"""
WITH found AS (
  SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(?:p|h1)>') AS parts FROM pages
), clean AS (
  SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?b>', '', 'g'))) AS parts FROM found
), plain AS (
  SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(
    replace(replace(replace(replace(regexp_replace(x, '&amp$', '&amp;'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[\s\x{00a0}]+', ' ', 'g'))) AS parts FROM clean
), texts AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM plain)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts
"""
