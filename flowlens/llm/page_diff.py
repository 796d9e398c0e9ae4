"""Main text of web pages by nearest-URL page differencing.

Pages of a host are ordered by URL path, equal pages as one; each is compared with its nearest pages of other lines, one
on each side where there are. Lines that stand in both pages, aligned by a longest common subsequence, belong to the site
and go. The page's own markup bounds this. What stands in menus, headers, footers, sidebars, notices, adverts, forms and
comments is compared, but never text in the end; scripts and styles are no lines. If a page marks its article, text
outside of it is none either, and of the article only shared lines go that are no headings and read like controls
(CONTROL_WORDS words at most and no sentence end): articles do share sentences, at their ends too. Without such a mark
every line that all neighbours have goes, unless little would be left: then they are near copies, not siblings.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.merkle import ranked
from flowlens.llm.tables import by_bytes, keep
from flowlens.llm.url_words import host_and_path

CONTROL_WORDS = 8
NEAR_COPY = 0.2  # of a page's characters must be left by its neighbours, or they are near copies of it
SLICE = 8 << 20  # bytes of html parsed at once, more only for one longer page
INSIDE, HEADING, HIDDEN = 1, 2, 4  # what a line is, as bits
# Element names, and words that names of classes and ids are made of: fixed values.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "object", "canvas", "math")
BOILER = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "head"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
          "form", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
          *HEADINGS}
INLINE_AUTO = {"p": BLOCKS, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
HINTS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus",
         "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promotion", "related", "replies", "share",
         "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
PLAIN = {"area", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "form", "global", "group", "header", "icons", "inner", "item", "items", "left", "links", "list",
         "main", "page", "panel", "post", "posts", "primary", "right", "row", "secondary", "section", "site", "slot", "stories", "top", "unit", "user", "wrap", "wrapper"}
ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"}
ATTR = re.compile(r"(class|id|role|itemprop|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
NAME = re.compile(r"[a-zA-Z][^\s/<>]*")
SIMPLE = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)([^<>=]*)>")  # a tag without attribute values
CLOSE = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}
START = re.compile(r"<(?=/?[a-zA-Z]|!|\?)")
NEXT = re.compile(r"[>=]")
SPACES = re.compile(r"\s*")


def hinted(names: str) -> bool:
    """Whether one of some class names or ids means a part of the site: all its words are known, and one of HINTS is among them."""
    for name in names.lower().split():
        words = {w for w in re.split(r"[-_]+", name) if w}
        if words & HINTS and words <= HINTS | PLAIN:
            return True
    return False


def boilerplate(name: str, attrs: str) -> bool:
    if name in BOILER:
        return True
    if name in ("body", "html", "article", "main") or not attrs:
        return name == "article" and bool(attrs) and bool(re.search(r"comment", attrs, re.I))
    for key, a, b, c in ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if key == "role" and value.lower() in ROLE or key in ("class", "id") and hinted(value):
            return True
    return False


class Scanner:
    """Reads a page forward only: every search that finds nothing up to the end is remembered, so none is done twice."""

    def __init__(self, page: str):
        self.page = page
        self.none: set[str] = set()

    def find(self, what: str, at: int) -> int:
        if what in self.none:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.none.add(what)
        return found

    def raw_end(self, name: str, at: int) -> int:
        """Place of the closing tag of a raw element, or -1."""
        if name in self.none:
            return -1
        m = CLOSE[name].search(self.page, at)
        if m is None:
            self.none.add(name)
        return m.start() if m else -1

    def tag_end(self, at: int) -> int:
        """Place of the `>` that ends a tag whose name ends at `at`, or -1. Quotes open a value only right after `=`."""
        begin = at
        while "tags" not in self.none:
            m = NEXT.search(self.page, at)
            if m is None:
                break
            if m.group() == ">":
                return m.start()
            at = SPACES.match(self.page, m.end()).end()
            if self.page[at:at + 1] in ("\"", "'"):
                close = self.find(self.page[at], at + 1)
                at = close + 1 if close >= 0 else at + 1
        # a tag that never ends that way: from here on quotes mean nothing
        self.none.add("tags")
        return self.find(">", begin)

    def tokens(self) -> Iterator[tuple[int, int, bool, str | None, str]]:
        """(begin, end, whether a closing tag, name or null for what is no text, attributes) of tags, comments and raw elements."""
        at, page = 0, self.page
        while (start := START.search(page, at)) is not None:
            at = start.start()
            if (m := SIMPLE.match(page, at)) is not None and (name := m.group(2).lower()) not in RAW:
                yield at, m.end(), bool(m.group(1)), name, m.group(3)
                at = m.end()
                continue
            if page.startswith("<!--", at):
                end = self.find("-->", at + 4)
                end = len(page) if end < 0 else end + 3
                yield at, end, False, None, ""
                at = end
                continue
            closing = page.startswith("/", at + 1)
            m = NAME.match(page, at + 2 if closing else at + 1)
            if m is None:
                if page[at + 1:at + 2] in ("!", "?"):
                    end = self.find(">", at)
                    if end >= 0:
                        yield at, end + 1, False, None, ""
                        at = end
                at += 1
                continue
            end = self.tag_end(m.end())
            if end < 0:
                at += 1
                continue
            name, attrs = m.group().lower(), page[m.end():end]
            if name in RAW and not closing:
                close = -1 if attrs.endswith("/") and name in ("svg", "math") else self.raw_end(name, end)
                after = len(page) if close < 0 else self.find(">", close)
                after = len(page) if after < 0 else after + (close >= 0)
                if attrs.endswith("/") and name in ("svg", "math"):
                    after = end + 1
                yield at, after, False, None, ""
                at = after
                continue
            yield at, end + 1, closing, name, attrs
            at = end + 1


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(line, bits of INSIDE the marked article, HEADING, HIDDEN by markup) of each block of a page."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, whether it hides its content, whether it is the article
    buffer: list[str] = []
    open_names: Counter[str] = Counter()
    block_at: list[int] = []  # places in the stack of open blocks, and of elements that hide their content
    hides_at: list[int] = []
    hidden = inside = 0
    heading = False

    def flush():
        nonlocal heading
        text = "".join(buffer)
        text = " ".join((entities.unescape(text) if "&" in text else text).split())
        if text:
            out.append((text, (INSIDE if inside > 0 else 0) | (HEADING if heading else 0) | (HIDDEN if hidden else 0)))
        buffer.clear()
        heading = False

    def close(n: int):
        nonlocal hidden, inside
        while len(stack) > n:
            name, hides, main = stack.pop()
            open_names[name] -= 1
            hidden -= hides
            inside -= main
        for places in (block_at, hides_at):
            while places and places[-1] >= n:
                places.pop()

    page = page or ""
    at = 0
    for begin, end, closing, name, attrs in Scanner(page).tokens():
        if begin > at:
            buffer.append(page[at:begin])
        at = end
        if name is None:
            continue
        if name in BLOCKS:
            flush()
        if closing:
            if open_names[name]:
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                if name in HEADINGS:
                    heading = False
                if stack[i][1]:
                    flush()
                close(i)
            continue
        if name in VOID or attrs.endswith("/"):
            if name == "br":
                buffer.append(" ")
            continue
        if block_at and name in INLINE_AUTO.get(stack[block_at[-1]][0], ()):
            close(block_at[-1])
        main = name in MAIN or "articleBody" in attrs
        hides = boilerplate(name, attrs) or name == "header" and not inside
        if hides:
            flush()
        if main and not hides and hides_at and stack[hides_at[0]][0] == "div":
            close(hides_at[0])  # an advert that was never closed ends where the article begins
        if name in BLOCKS:
            block_at.append(len(stack))
        if hides:
            hides_at.append(len(stack))
        open_names[name] += 1
        stack.append((name, hides, main and not hides))
        hidden += hides
        inside += main and not hides
        if name in HEADINGS:
            heading = True
    buffer.append(page[at:])
    flush()
    return out


def common(a: list, b: list) -> list[int]:
    """Indexes of a that a longest common subsequence with b takes, ascending.

    Bit-parallel: a row of the table is one integer, a bit of it says where the length does not grow. Only every so
    many rows are kept, those between are made again on the way back, so memory is about len(b) * sqrt(len(a)) bits.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head:len(a) - tail], b[head:len(b) - tail]
    full = (1 << len(y)) - 1
    places: dict = {}
    for j, item in enumerate(y):
        places.setdefault(item, []).append(j)
    match = {item: sum(1 << j for j in own) if len(own) < 64 else int("".join("1" if z == item else "0" for z in reversed(y)), 2) for item, own in places.items() if item in set(x)}

    def grown(row: int, item) -> int:
        same = row & match.get(item, 0)
        return ((row + same) | (row - same)) & full

    step = max(1, int(len(x) ** 0.5))
    kept, row = [full], full
    for i, item in enumerate(x):
        row = grown(row, item)
        if (i + 1) % step == 0:
            kept.append(row)
    taken, i, j, rows, base = [], len(x), len(y), [], -1
    while i and j:
        if (i - 1) // step != base:
            base = (i - 1) // step
            rows = [kept[base]]
            for item in x[base * step:i]:
                rows.append(grown(rows[-1], item))
        if rows[i - base * step] >> (j - 1) & 1:
            j -= 1
        elif x[i - 1] == y[j - 1]:
            taken.append(head + i - 1)
            i, j = i - 1, j - 1
        else:
            i -= 1
    return [*range(head), *reversed(taken), *range(len(a) - tail, len(a))]


def shared_lines(keys: list, bits: list[int], sizes: list[int], control: list[bool], others: list[list]) -> list[int]:
    """Indexes of a page's lines that go as its neighbours' (lists of keys, one or two) own: see the module's text."""
    if not others:
        return []
    found = [set(common(keys, o)) for o in others]
    both = set.intersection(*found)
    marked = any(b & INSIDE for b in bits)
    if not marked:
        seen = [i for i, b in enumerate(bits) if not b & HIDDEN]
        left = sum(sizes[i] for i in seen if i not in both)
        if left < NEAR_COPY * sum(sizes[i] for i in seen):
            both = {i for i in both if bits[i] & HIDDEN}
        return sorted(both)
    return sorted(i for i in both if not bits[i] & INSIDE or bits[i] & HIDDEN or control[i] and not bits[i] & HEADING)


def text_of(lines: list[str], bits: list[int], gone: list[int] | None) -> str:
    """What is left: no lines that go, none that markup hides, and only the marked article's where there is one."""
    out = set(gone or ())
    inside = any(b & INSIDE and not b & HIDDEN for b in bits)
    return "\n\n".join(line for i, (line, b) in enumerate(zip(lines, bits, strict=True)) if i not in out and not b & HIDDEN and (b & INSIDE or not inside))


def neighbours(classes: DataFrame) -> DataFrame:
    """(uid, other) of pages (uid, host, path), of each line list of a host one: the nearest on each side in the order of

    (path, uid), for the first and last page of a host the two nearest ones; fewer where there are fewer.
    """
    ordered = keep(ranked(classes.select(F.col("host").alias("group"), "path", "uid"), ["path", "uid"]), "page-order", 10000)
    r, last = F.col("rank"), F.col("n") - 1
    near = F.when(r == 0, F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).when(r == last, F.array(r - 1, r - 2)).otherwise(F.array(r - 1, r + 1))
    asked = ordered.select("group", "uid", F.explode(near).alias("rank"))
    return asked.join(ordered.select("group", "rank", F.col("uid").alias("other")), ["group", "rank"]).where("uid <> other").select("uid", "other")


PARSED = "uid long, page_id long, url string, host string, path string, lines array<string>, bits array<int>"


def parsed_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    def parse(batches):
        for batch in batches:
            for part in by_bytes(batch, "html", SLICE):
                found = [blocks(h) for h in part.column(5).to_pylist()]
                lists = [pa.array([[b[i] for b in f] for f in found], kind) for i, kind in enumerate((pa.list_(pa.string()), pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays([*part.columns[:5], *lists], ["uid", "page_id", "url", "host", "path", "lines", "bits"])

    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.xxhash64(id_col, url_col, html_col).alias("uid"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"),
                        F.col(html_col).alias("html"))
    return rows.mapInArrow(parse, PARSED)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_lines, n_gone) of each row; n_lines: lines of the page, n_gone: those that differencing deletes.

    Null html is empty; a page without host, or alone on it with its lines, is taken as its markup says. Rows that repeat
    have the same text each; equal paths are ordered by content; other columns are left out. The html is read twice: lines
    are compared as 64-bit hashes, and only these are written; the texts meet what is to go in one join.
    """
    what = F.xxhash64(F.transform("lines", lambda x: F.xxhash64(x)), "bits").alias("content")
    control = F.transform("lines", lambda x: (F.size(F.split(F.trim(x), " ")) <= CONTROL_WORDS) & ~x.rlike("[.!?…:;,)\\]\"'»”]$"))
    narrow = parsed_pages(pages, id_col, url_col, html_col).where("host <> ''").select(
        "uid", "host", "path", what, F.transform("lines", lambda x: F.xxhash64(x)).alias("keys"), "bits", F.transform("lines", F.length).alias("sizes"), control.alias("control"))
    narrow = keep(narrow, "page-keys")
    first = narrow.groupBy("host", "content").agg(F.min(F.struct("path", "uid")).alias("at")).select("host", "content", "at.path", "at.uid")
    first = keep(first, "page-classes", 10000)
    own = narrow.dropDuplicates(["uid"]).join(first.select("uid"), "uid", "left_semi")
    pairs = neighbours(first.select("uid", "host", "path")).join(own.select(F.col("uid").alias("other"), F.col("keys").alias("theirs")), "other")
    pairs = pairs.groupBy("uid").agg(F.collect_list("theirs").alias("others"))  # two at most
    asked = own.join(pairs, "uid").select("host", "content", "keys", "bits", "sizes", "control", "others")

    def compare(batches):
        for batch in batches:
            rows = zip(*[batch.column(i).to_pylist() for i in range(2, 7)], strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([shared_lines(*r) for r in rows], pa.list_(pa.int32()))], ["host", "content", "gone"])

    gone = keep(asked.mapInArrow(compare, "host string, content long, gone array<int>").where("size(gone) > 0"), "page-gone")
    both = parsed_pages(pages, id_col, url_col, html_col).select("page_id", "url", "host", "lines", "bits", what).join(gone, ["host", "content"], "left").select("page_id", "url", "lines", "bits", "gone")

    def finish(batches):
        for batch in batches:
            rows = list(zip(*[batch.column(i).to_pylist() for i in range(2, 5)], strict=True))
            texts = [text_of(*r) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(r[0]) for r in rows], pa.int64()),
                                              pa.array([len(r[2] or ()) for r in rows], pa.int64())], ["page_id", "url", "text", "n_chars", "n_lines", "n_gone"])

    return both.mapInArrow(finish, "page_id long, url string, text string, n_chars long, n_lines long, n_gone long")
