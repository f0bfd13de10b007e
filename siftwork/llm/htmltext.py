"""Main text of web pages by nearest-URL page differencing.

Pages of one host are sorted by URL path, and each is compared with its neighbours, the one whose path shares the longest
prefix first. The text lines of the two are aligned by a longest common subsequence, and lines that both have are deleted:
they are the site's and not the page's. Lines in elements that never hold main text (menus, footers, asides, forms,
scripts, adverts, comments) go whether shared or not. Differencing decides on every page:

* Where a page marks its main region (article, main), what lies outside goes, and inside go the shared lines that aren't
  prose (p, li, blockquote, cells and the like) and begin or end the region, or that both neighbours have: share bars,
  bylines, sign-up boxes. Shared prose there is a quotation, or a passage that several articles hold, and stays, as
  headings do.
* Elsewhere all lines that the nearest page has go.

A neighbour that shares the article itself tells nothing about the site: one that would leave less than a tenth of the
page's characters (half of a marked region's) is passed over for the other, as one without text is, and with none left nothing is deleted.

A null or empty page has an empty text; a null URL is a host of its own without a neighbour. Rows repeat as they come: rows
of one id at one URL are one page's, each is compared with the pages around them and never with one another, so equal rows
have equal texts. Neighbours with several rows show the least of their HTML. Other columns are ignored; an empty table
gives an empty result. Parsing is linear in a page; an alignment takes memory in proportion to the lines.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm._shared import sliced, sorted_slices

#: Elements that begin and end a block. Fixed values.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td template tfoot th thead title tr ul".split())
#: Elements whose content is no text of the page, and those that never hold main text. Fixed values.
RAW = frozenset("script style noscript template textarea iframe svg math xmp noembed noframes".split())
ASIDE = frozenset("nav footer aside form header head menu button select dialog title".split())
MAIN = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p li blockquote pre td th dd dt figcaption caption".split())
#: Elements that a new one of the same kind closes, and those beyond which it doesn't look. Fixed values.
CLOSING = HEADINGS | {"p", "li"}
HOLDERS = ("article", "main", "div", "section", "td", "ul", "ol", "body")
#: Words of class, id and role that mark what isn't main text. Fixed values.
NAMED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|menu|nav\w*|navigation|breadcrumbs?|sidebar|side|widget|cookies?|consent|notice|popup|modal|newsletter|subscribe|signup|login|share|social|related|recommend\w*|comments?|reply|replies|respond|disqus|footer|masthead|pagination|pager|complementary|contentinfo|search|toolbar|skip|hidden)(?:$|[\s_-])", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A quote opens a value only right after an equals sign; elsewhere it is a letter like others.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s=/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'][^\s]*+)))?+""")
_SPACE = re.compile(r"\s+")
#: A neighbour that leaves less than this share of the characters has the same article: on a page, in a marked region.
COPY, COPY_MARKED = 0.1, 0.5
#: Cells of an alignment that are held at once, as bits.
CELLS = 1 << 24


def _said(attrs: str) -> dict[str, str]:
    """Attributes by lower-case name; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _boilerplate(name: str, attrs: dict[str, str]) -> bool:
    if name in ASIDE or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    return name not in ("html", "body", "article", "main") and any(NAMED.search(attrs[k]) for k in ("class", "id", "role") if k in attrs)


class Line:
    """A text line: its text, and whether it is in an element that never holds main text, in a marked region, a heading,
    in an element that holds prose."""

    __slots__ = ("boilerplate", "hash", "heading", "main", "prose", "text")

    def __init__(self, text: str, boilerplate: bool, main: bool, heading: bool, prose: bool):
        self.text, self.boilerplate, self.main, self.heading, self.prose = text, boilerplate, main, heading, prose
        self.hash = xxhash.xxh64_intdigest(text)


class _Open:
    """The open elements, with the places of each name and of blocks, so that no tag walks through all of them."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool]] = []  # name, boilerplate from here on, main from here on
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def top(self) -> tuple[bool, bool]:
        return self.stack[-1][1:] if self.stack else (False, False)

    def last(self, name: str) -> int:
        at = self.places.get(name)
        return at[-1] if at else -1

    def push(self, name: str, boilerplate: bool, main: bool) -> None:
        k = len(self.stack)
        self.stack.append((name, boilerplate, main))
        self.places.setdefault(name, []).append(k)
        if name in BLOCKS:
            self.blocks.append(k)

    def cut(self, k: int) -> None:
        """Closes the element at place k and all inside it."""
        while len(self.stack) > k:
            self.places[self.stack.pop()[0]].pop()
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()

    def close(self, name: str) -> None:
        """An end tag: nothing if no such element is open, or if an inline one would close a block inside it."""
        k = self.last(name)
        if k >= 0 and (name in BLOCKS or not self.blocks or self.blocks[-1] < k):
            self.cut(k)

    def follow(self, name: str) -> None:
        """A start tag of an element that closes the one before of its kind."""
        k = self.last(name)
        if k >= 0 and all(self.last(h) < k for h in HOLDERS if h != name):
            self.cut(k)


_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}


def lines_of(page: str) -> list[Line]:
    """A page's text lines in order. Of a line whose parts differ, what is in boilerplate goes."""
    out: list[Line] = []
    opened = _Open()
    parts: list[tuple[str, bool, bool]] = []

    def add(text: str) -> None:
        if text:
            parts.append((text, *opened.top()))

    def flush() -> None:
        if not parts:
            return
        joined = lambda ps: _SPACE.sub(" ", html.unescape("".join(ps))).strip()
        heading, prose = (any(opened.last(h) >= 0 for h in names) for names in (HEADINGS, PROSE))
        text = joined(t for t, b, _ in parts if not b)
        if text:
            out.append(Line(text, False, any(m for t, b, m in parts if not b and t.strip()), heading, prose))
        elif text := joined(t for t, _, _ in parts):
            out.append(Line(text, True, any(m for _, _, m in parts), heading, prose))
        parts.clear()

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCKS:
                flush()
            opened.close(name)
            continue
        empty = m[3].rstrip().endswith("/")
        if name in RAW:
            if not empty:
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else n
            continue
        if name == "br":
            add(" ")
            continue
        if name in BLOCKS:
            flush()
            if name in CLOSING:
                opened.follow(name)
        if name in VOID or empty:
            continue
        attrs = _said(m[3]) if m[3].strip() else {}
        boilerplate, main = opened.top()
        opened.push(name, boilerplate or _boilerplate(name, attrs), main or name in MAIN or attrs.get("role", "").lower() == "main")
    flush()
    return out


def _row(a: list[int], b: list[int], keep: bool = False) -> list[int]:
    """Of a table of common subsequences, a row as one integer: a zero at bit j where b[j] lengthens what a shares with b.
    The last row alone, or all."""
    place: dict[int, int] = {}
    for k, x in enumerate(b):
        place[x] = place.get(x, 0) | 1 << k
    full = (1 << len(b)) - 1
    v, rows = full, []
    for x in a:
        u = v & place.get(x, 0)
        v = ((v + u) | (v - u)) & full
        if keep:
            rows.append(v)
    return rows if keep else [v]


def _lengths(v: int, n: int) -> list[int]:
    """Lengths for all prefixes of b, from a row."""
    out, k = [0], 0
    for c in reversed(bin(v | 1 << n)[3:]):
        k += c == "0"
        out.append(k)
    return out


def _aligned(a: list[int], b: list[int]) -> Iterator[int]:
    """Positions in a of a longest common subsequence: whole tables where they are small, else halves of a, each against
    the part of b that serves both best, so memory is that of one row."""
    if not a or not b:
        return
    if len(a) == 1:
        if a[0] in b:
            yield 0
        return
    if len(a) * len(b) <= CELLS:
        rows, i, j = _row(a, b, True), len(a), len(b)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
                i -= 1
            else:
                yield i - 1
                i, j = i - 1, j - 1
        return
    half = len(a) // 2
    before = _lengths(_row(a[:half], b)[0], len(b))
    after = _lengths(_row(a[half:][::-1], b[::-1])[0], len(b))[::-1]
    cut = max(range(len(b) + 1), key=lambda j: before[j] + after[j])
    yield from _aligned(a[:half], b[:cut])
    yield from (half + k for k in _aligned(a[half:], b[cut:]))


def shared(a: list[int], b: list[int]) -> set[int]:
    """Positions in a of a longest common subsequence of a and b. Items that only one of the two has take no part."""
    both = set(a) & set(b)
    at = [k for k, x in enumerate(a) if x in both]
    return {at[k] for k in _aligned([a[k] for k in at], [x for x in b if x in both])}


def _alike(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def _ends(lines: list[Line], region: list[int], gone: set[int]) -> set[int]:
    """Of the shared lines of a region, those in its first and last runs, in which headings count for nothing."""
    out: set[int] = set()
    for way in (region, region[::-1]):
        for k in way:
            if k in gone:
                out.add(k)
            elif not lines[k].heading:
                break
    return out


def own_lines(lines: list[Line]) -> tuple[bool, list[int]]:
    """Whether a page marks a main region, and which lines can be its text."""
    marked = any(x.main and not x.boilerplate for x in lines)
    return marked, [k for k, x in enumerate(lines) if not x.boilerplate and (x.main or not marked)]


def main_text(lines: list[Line], neighbours: list[list[int]]) -> str:
    """The lines that are left, joined; neighbours: the hashes of the lines of the pages around, the nearest first."""
    marked, own = own_lines(lines)
    size = sum(len(lines[k].text) for k in own)
    told: list[set[int]] = []
    hashes = [x.hash for x in lines]
    for other in neighbours:
        gone = shared(hashes, other).intersection(own)
        left = size - sum(len(lines[k].text) for k in gone)
        if other and left and left >= (COPY_MARKED if marked else COPY) * size:
            told.append(gone)
            if not marked:
                break
    drop: set[int] = set()
    if told and not marked:
        drop = told[0]
    elif told:
        both = told[0] & told[1] if len(told) > 1 else set()
        drop = {k for k in _ends(lines, own, told[0]) | both if not (lines[k].heading or lines[k].prose)}
    return "\n".join(lines[k].text for k in own if k not in drop)


class _Page:
    """Rows of one key: the same id at the same URL."""

    __slots__ = ("host", "key", "path", "rows", "shown")

    def __init__(self, key: str, host: str | None, path: str):
        self.key, self.host, self.path = key, host, path
        self.rows: list[tuple] = []
        self.shown: list[int] = []

    def add(self, i, url: str | None, page: str, own: bool) -> None:
        lines = self.rows[-1][3] if self.rows and self.rows[-1][2] == page else lines_of(page)
        if not self.rows:
            self.shown = [x.hash for x in lines]
        self.rows.append((i, url, page, lines, own))

    def texts(self, before: _Page | None, after: _Page | None) -> Iterator[tuple]:
        around = {p.key: (-_alike(self.path, p.path), -k, p) for k, p in enumerate((before, after)) if p is not None and p.host is not None and p.host == self.host and p.key != self.key}
        others = [p.shown for _, _, p in sorted(around.values(), key=lambda x: x[:2])]
        last: tuple = (None, None)
        for i, url, page, lines, own in self.rows:
            if own:
                if page != last[0]:
                    last = page, main_text(lines, others)
                yield i, url, last[1]


def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, url, text) of every row of the slices of sorted_slices(); a page waits for the one after it."""
    before = now = None
    inside = None
    for b in sliced(batches):
        for s, edge, key, host, path, i, url, page in zip(*[b.column(k).to_pylist() for k in range(8)], strict=True):
            if s != inside:
                if now is not None:
                    yield from now.texts(before, None)
                before = now = None
                inside = s
            if now is None or now.key != key:
                nxt = _Page(key, host, path)
                nxt.add(i, url, page, edge == 0)
                if now is not None:
                    yield from now.texts(before, nxt)
                before, now = now, nxt
            else:
                now.add(i, url, page, edge == 0)
    if now is not None:
        yield from now.texts(before, None)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every row."""
    url = F.col(url_col)
    bare = F.regexp_replace(url, "[?#].*$", "")
    host = F.lower(F.regexp_extract(bare, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/]*)", 1))
    path = F.regexp_replace(bare, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/]*", "")
    rows = df.select(F.concat_ws("\x00", F.coalesce(host, F.lit("")), F.coalesce(path, F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"), host.alias("host"), F.coalesce(path, F.lit("")).alias("path"), F.col(id_col).alias("id"), url.alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    source = sorted_slices(rows, "html").select("slice", "edge", "key", "host", "path", "id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for i, u, t in extracted(batches):
            out.append((i, u, t, len(t)))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(source.schema["id"].dataType), pa.string(), pa.string(), pa.int64()]
    names = ["id", "url", "text", "n_chars"]
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
