"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: opening tags, named by their path and their class, id and role, and
blocks of text. For every host, over its distinct pages:

1. Each token's occurrence vector (how often each page has it) is summed up in one 64-bit
   fingerprint, a commutative sum of hashes of (page, count), so that a host of any size is counted
   with partial sums and never gathered.
2. Tokens of equal vectors form an equivalence class. A class is a candidate if it has two tokens
   or more and its pages are at least ``min_pages`` and ``min_share`` of the host's. The share is low,
   so that each layout of a host has its classes; it bounds a host's classes whatever its size.
3. A class is valid if its tokens come in one order on all pages, and if its span on each page
   crosses that of no ordered class of more pages: it is apart, or nests in one slot (the gap between
   two consecutive tokens).
4. The valid classes, nested, are the host's template. Its text tokens are boilerplate; everything
   between template tokens is slots, each named by the innermost class around and the number of that class's
   tokens before it. A page keeps the blocks of its slots, unless a slot lies
   inside a container that can't hold main text (a menu, footer, form, advert, reader comments).
   Where a page has an article or main element, only slots inside it are main text.

Hosts of too few pages have no template; for them the containers alone decide.

Defined cases: null and empty html give an empty text; a null url is a page of no host; repeated
pages are each extracted but count once in step 1; unclosed and stray tags are tolerated; pages are
taken whole; an empty table gives an empty result. Columns other than id, url and html are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialize


@dataclass(frozen=True)
class TemplateRules:
    """Support that a class needs: pages of the host, and their share."""

    min_pages: int = 5
    min_share: float = 0.05


# Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
DROPPED = frozenset("aside button datalist dialog footer form head iframe math menu nav noscript object select svg template textarea".split())
MAIN = frozenset(["article", "main"])
#: Words of a class, id or role that mark a container without main text.
DROPPED_WORDS = frozenset(
    "ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
LEAF = frozenset(["p", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "li", "option", "td", "th", "tr", "pre"])

HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: So many links in a row, with nothing else between them, are a list of links.
LINK_LIST = 3
#: Templates that a task keeps.
HELD = 64

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*+>.*?(?:</\1[^>]*+>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+>""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[a-z]+")


#: After so many tags whose quotes never end, > ends a tag even inside quotes: work stays linear on any input.
OPEN_QUOTES = 16
_PLAIN_TAG = re.compile(_TOKEN.pattern.rsplit("|<(/?)", 1)[0] + r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S | re.I)


def _tags(html: str) -> Iterator[tuple[int, int, re.Match | None]]:
    """(start, end, match) of all markup, in order; without a match for what is unclosed at the end."""
    end = html.rfind(">") + 1  # no tag ends beyond
    at = odd = 0
    pattern = _TOKEN
    while m := pattern.search(html, at, end):
        at = m.end()
        if at == end < len(html) and m[3] is None and (m[0].startswith("<!--") and not m[0].endswith("-->") or m[1] and not _ENDS.search(m[0])):
            yield m.start(), len(html), None  # a comment or script that goes on
            return
        if m[3] is None and not m[1] and m[0][1] not in "!?":
            odd += 1
            if odd == OPEN_QUOTES:
                pattern = _PLAIN_TAG
        yield m.start(), at, m
    if (opened := html.find("<!--", max(at, end))) >= 0:
        yield opened, len(html), None


_ENDS = re.compile(r"</(?:script|style)[^>]*+>\Z", re.I)


class Block:
    """Text between block boundaries: number of its path, name of its element, whether a container drops it, whether it's in an article."""

    __slots__ = ("path", "name", "text", "dropped", "inside", "linked", "links")

    def __init__(self, path: int, name: str, text: str, dropped: bool, inside: bool, linked: bool, links: int) -> None:
        self.path, self.name, self.text, self.dropped, self.inside, self.linked, self.links = path, name, text, dropped, inside, linked, links


class Element:
    """An open element. path numbers it by its names and marks from the top, block is the index of the nearest block on the stack, marked that of the nearest element marked by words."""

    __slots__ = ("name", "path", "dropped", "inside", "link", "hard", "marked", "block")

    def __init__(self, name: str, path: int, dropped: bool, inside: bool, link: bool, hard: bool, marked: int, block: int) -> None:
        self.name, self.path, self.dropped, self.inside, self.link, self.hard, self.marked, self.block = name, path, dropped, inside, link, hard, marked, block


def _code(key: str) -> int:
    return xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass")) - (1 << 63)


def parse(html: str) -> tuple[list[int | Block], bool]:
    """(tag tokens as numbers and blocks, in page order; whether there is an article or main element).

    A word of a class, id or role drops no element that holds all articles and main elements of the
    page or, where there are none, most of its text. Time and memory grow with the page, however it nests.
    """
    out, has_main, kept = _parse(html, frozenset())
    return _parse(html, kept)[:2] if kept else (out, has_main)


def _parse(html: str, kept: frozenset[int]) -> tuple[list[int | Block], bool, frozenset[int]]:
    """As parse, but words don't drop the elements numbered in kept; also the elements that they mustn't drop."""
    out: list[int | Block] = []
    stack = [Element("", 0, False, False, False, False, -1, 0)]
    opened: Counter = Counter()  # open elements by name
    parents = {-1: -1}  # marked elements, by the one around
    chars: Counter = Counter()  # text by innermost marked element
    mains: Counter = Counter()
    links = 0
    text: list[str] = []
    plain = False  # text outside of links
    has_main = False

    def flush() -> None:
        nonlocal plain, links
        if text:
            joined = " ".join(unescape("".join(text)).split())
            if joined:
                own = stack[stack[-1].block]
                out.append(Block(own.path, own.name, joined, own.dropped, own.inside, not plain, links))
                if not own.hard:
                    chars[own.marked] += len(joined)
            text.clear()
        plain, links = False, 0

    def add(piece: str) -> None:
        nonlocal plain
        top = stack[-1]
        if piece and not (top.dropped and top.name not in BLOCKS):
            text.append(piece)
            if not plain and not top.link and not piece.isspace():
                plain = True

    def cut(size: int) -> None:
        for gone in stack[size:]:
            opened[gone.name] -= 1
        del stack[size:]

    at = 0
    for start, end, m in _tags(html):
        add(html[at:start])
        at = end
        name = m and m[3]
        if name is None:
            continue
        name = name.lower()
        if m[2]:
            if opened[name]:
                i = len(stack) - 1
                while stack[i].name != name:
                    i -= 1
                if stack[-1].block >= i:
                    flush()
                cut(i)
            elif name == "p":
                flush()
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCKS:
            flush()
            if name in LEAF or opened["p"]:
                cut(_close(stack, name))
        top = stack[-1]
        words, mark = _marks(m[4])
        in_main = top.inside or name in MAIN and not top.dropped or "main" in words and not top.dropped and "role" in mark
        hard = top.hard or name in DROPPED or name == "header" and not top.inside or (m[4] != "" and bool(_HIDDEN.search(m[4])))
        by_word = name not in ("html", "body") and (bool(words & DROPPED_WORDS) or "header" in words and not top.inside)
        marked = top.marked
        if by_word:
            parents[len(out)] = marked
            marked = len(out)
        if not hard and (name in MAIN or "main" in words and "role" in mark):
            mains[marked] += 1
        gone = top.dropped or hard or by_word and len(out) not in kept
        links += name == "a"
        has_main = has_main or in_main and not gone
        here = _code(f"{top.path}/{name}{mark}")
        out.append(here)
        if name not in VOID and not m[4].endswith("/"):
            stack.append(Element(name, here, gone, in_main, top.link or name == "a", hard, marked, len(stack) if name in BLOCKS else top.block))
            opened[name] += 1
    add(html[at:])
    flush()
    held = mains if mains else chars
    for k in sorted(parents, reverse=True):  # what is in an element is in those around it
        if k >= 0:
            held[parents[k]] += held[k]
    return out, has_main, frozenset(k for k in parents if k >= 0 and (held[k] == held[-1] if mains else 2 * held[k] > held[-1]))


def _close(stack: list[Element], name: str) -> int:
    """What an opening block leaves open: an open paragraph ends; for items, cells and rows an open one of the same kind."""
    i = stack[-1].block
    while i > 0:
        open_name = stack[i].name
        if open_name == "p" or open_name == name and name in LEAF:
            return i
        if open_name not in LEAF:
            break
        i = stack[i - 1].block
    return len(stack)


def _marks(attributes: str) -> tuple[set[str], str]:
    if not attributes or "=" not in attributes:
        return set(), ""
    found = [(k.lower(), a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)]
    words = {w for _, v in found for n in v.lower().split() for w in _said(n)}
    return words, "".join(f"[{k}={v}]" for k, v in found)


def _said(name: str) -> list[str]:
    """The words of one class or id, without what it says is only had beside or not there (no-sidebar, has-comments, alert-none)."""
    words = _WORD.findall(name)
    for i, word in enumerate(words):
        if word in ("no", "not", "has", "have", "with", "without"):
            return words[:i]
        if word in ("none", "off", "disabled"):
            return []
    return words


def _number(token: int | Block) -> int:
    return token if isinstance(token, int) else _code(f"{token.path}\0{token.text}")


def slots(html: str, template: dict[int, int] | None = None) -> list[tuple[int, int, str]]:
    """The page's main text by slot: (class, how many of its tokens come before, text of a block); class 0 is outside of all.

    template: the host's template tokens, by number, and the class of each. Classes nest; a block is in the innermost one's slot.
    """
    tokens, has_main = parse(html)
    template = template or {}
    owners = [template.get(_number(t)) for t in tokens] if template else [None] * len(tokens)
    last = {c: i for i, c in enumerate(owners) if c is not None}
    nested: list[int] = []  # classes whose span holds the place, outer ones first
    before: Counter = Counter()
    kept: list[tuple[int, int, str]] = []
    run: list[tuple[int, int, str]] = []  # blocks that are each a link, in a row

    def end_run() -> None:
        if len(run) < LINK_LIST:
            kept.extend(run)
        run.clear()

    for i, (token, owner) in enumerate(zip(tokens, owners)):
        if owner is not None:
            while nested and last[nested[-1]] < i:
                nested.pop()
            if not before[owner]:
                nested.append(owner)
            before[owner] += 1
            continue
        if isinstance(token, int) or token.dropped or has_main and not token.inside:
            continue
        while nested and last[nested[-1]] < i:
            nested.pop()
        held = (nested[-1], before[nested[-1]], token.text) if nested else (0, 0, token.text)
        if not has_main and token.linked and token.name not in HEADINGS:
            if token.links < LINK_LIST:
                run.append(held)
            continue
        end_run()
        kept.append(held)
    end_run()
    return kept


def main_text(html: str, template: dict[int, int] | None = None) -> str:
    """The page's main text: the texts of its slots, in order."""
    return "\n".join(text for _, _, text in slots(html, template))


def _vectors(pages: DataFrame) -> DataFrame:
    """(host, page, token, is_text, n): the tokens of pages (host, page, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = []
                for host, page, html in zip(*[c.to_pylist() for c in batch.slice(at, 200).columns]):
                    if host:
                        texts: dict[int, bool] = {}
                        counted: Counter = Counter()
                        for token in parse(html or "")[0]:
                            number = _number(token)
                            counted[number] += 1
                            texts[number] = not isinstance(token, int)
                        rows += [(host, page, t, texts[t], n) for t, n in counted.items()]
                columns = list(zip(*rows)) or [()] * 5
                types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["host", "page", "token", "is_text", "n"])

    return pages.select("host", "page", "html").mapInArrow(run, "host string, page long, token long, is_text boolean, n int")


def _faults(pages: DataFrame) -> DataFrame:
    """(host, class, low, high, crossed) from pages (host, html, classes): hashes of a class's token order, and the classes before it that it crosses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, int], list] = {}
            for host, html, classes in zip(*[c.to_pylist() for c in batch.columns]):
                of = {c["token"]: c["class"] for c in classes}
                rank = {c["class"]: (c["support"], c["class"]) for c in classes}
                orders: dict[int, list[int]] = {}
                spans: dict[int, list[int]] = {}
                for i, token in enumerate(parse(html or "")[0]):
                    number = _number(token)
                    if number in of:
                        orders.setdefault(of[number], []).append(number)
                        spans.setdefault(of[number], []).append(i)
                for kind, order in orders.items():
                    code = xxhash.xxh3_64_intdigest(repr(order).encode()) - (1 << 63)
                    entry = seen.setdefault((host, kind), [code, code, set()])
                    entry[2].update(k for k, other in spans.items() if k not in entry[2] and rank[k] > rank[kind] and _crosses(spans[kind], other))
                    entry[:2] = min(entry[0], code), max(entry[1], code)
            columns = list(zip(*[(h, k, a, b, sorted(c)) for (h, k), (a, b, c) in seen.items()])) or [()] * 5
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["host", "class", "low", "high", "crossed"])

    return pages.mapInArrow(run, "host string, class long, low long, high long, crossed array<long>")


def _crosses(a: list[int], b: list[int]) -> bool:
    """Whether spans overlap and neither lies in one slot of the other."""
    if a[-1] < b[0] or b[-1] < a[0]:
        return False
    in_slot = lambda x, y: not any(x[0] < i < x[-1] for i in y)
    return not (in_slot(a, b) or in_slot(b, a))


def templates(pages: DataFrame, rules: TemplateRules = TemplateRules()) -> DataFrame:
    """(host, tokens array<long>, classes array<long>): each host's template, its tokens and the class of each, from pages (host, page, html)."""
    spark = pages.sparkSession
    vectors, path = materialize(_vectors(pages).distinct(), "vectors")
    sizes = vectors.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= rules.min_pages).withColumnRenamed("host", "h")
    sizes, sizes_path = materialize(sizes, "hosts")
    marks = vectors.groupBy("host", "token", "is_text").agg(F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).alias("vector"), F.count(F.lit(1)).alias("support"))
    marks = marks.join(sizes, F.col("host") == F.col("h")).where((F.col("support") >= rules.min_pages) & (F.col("support") >= F.col("pages") * rules.min_share)).drop("h", "pages")
    marks = marks.withColumn("class", F.xxhash64("vector", "support"))
    # both sides and the result are written: Spark splits a hot host's rows only in a join of plain exchanges
    marks, marks_path = materialize(marks, "marks")
    discard(spark, path, sizes_path)
    sized = marks.groupBy(F.col("host").alias("h"), F.col("class").alias("c")).agg(F.count(F.lit(1)).alias("tokens"), F.max("is_text").alias("any_text")).where("tokens >= 2")
    sized, sized_path = materialize(sized, "sized")
    found, found_path = materialize(marks.join(sized, (F.col("host") == F.col("h")) & (F.col("class") == F.col("c"))).select("host", "token", "is_text", "class", "support", "any_text"), "classes")
    discard(spark, marks_path, sized_path)
    by_host = found.groupBy("host").agg(F.collect_list(F.struct("token", "class", "support")).alias("classes"), F.max("any_text").alias("any_text")).where("any_text").select(F.col("host").alias("h"), "classes")
    held = pages.join(by_host, F.col("host") == F.col("h")).select("host", "html", "classes")
    faults, faults_path = materialize(_faults(held), "faults")
    unordered = faults.groupBy("host", "class").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("host", "class")
    crossed = faults.select("host", F.col("class").alias("by"), F.explode("crossed").alias("class")).distinct().join(unordered, ["host", "class"], "left_anti").select("host", F.col("by").alias("class"))
    bad = unordered.unionByName(crossed).distinct()
    good = found.join(bad.select("host", "class"), ["host", "class"], "left_anti")
    listed = good.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("token", "class"))).alias("t"), F.max("is_text").alias("any_text")).where("any_text")
    out, _ = materialize(listed.select("host", F.col("t.token").alias("tokens"), F.col("t.class").alias("classes")), "templates")
    discard(spark, found_path, faults_path)
    return out


def extract(pages: DataFrame, rules: TemplateRules = TemplateRules(), id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row a page: id_col, url, text (blocks joined by a line feed, empty if none), n_chars."""
    name = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url}`").alias("url"), name.alias("host"), F.xxhash64(F.coalesce(F.col(f"`{html}`"), F.lit(""))).alias("page"), F.col(f"`{html}`").alias("html"))
    known = templates(rows, rules).select(F.col("host").alias("h"), "tokens", "classes")
    rows = rows.join(known, F.col("host") == F.col("h"), "left").select("id", "url", "html", "h", "tokens", "classes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, dict[int, int]] = {None: {}}
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = []
                for i, (html, host) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                    if host not in held:
                        if len(held) >= HELD:
                            held = {None: {}}
                        held[host] = dict(zip(part.column(4)[i].as_py(), part.column(5)[i].as_py()))
                    texts.append(main_text(html or "", held[host]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
