"""Main text of web pages by differencing pages that lie near each other.

A page becomes lines (blocks of text) that know which containers they stand in.  Pages are paired
by URL path within their host: each page meets up to four pages (``BESIDE``), as a rule two before
and two after it in path order, of its own directory if there are any.  Its lines are aligned with each of theirs by longest common subsequence, and a line goes
when one or two neighbours share it all, or when all but one of three or four do; inside an only
article, when ``WITNESSES`` neighbours or more share it all.  Copies and near copies that follow each other (``NEAR`` of the characters outside boxes
are common lines) are one run and aren't held against each other, so that a copy next door takes
no text away; their neighbours are the pages before and after the run.

The difference can't do it alone: menus and adverts that change from page to page survive it (the
README has figures).  So the markup goes over what it leaves: lines in menus, headers, footers,
sidebars, notices, adverts, forms and comments go, and on a page with exactly one article outside
such boxes the lines outside it.  Articles in boxes are no articles, and several (teaser cards)
decide nothing.

Pages in the order of their addresses are cut into chunks of about ``CHUNK``, at pages that a hash
of the address picks.  So neighbours are the nearest pages of a chunk, chunks don't depend on how the
input is partitioned, and neither a large host nor many addresses with one path are one task's.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter, deque
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.scratch import slices

#: Pages of a chunk on average, how many cuts are broadcast at most, and how many candidates there are for a cut.
CHUNK, CUTS, PICKED = 256, 20_000, 8
#: Part of the characters outside boxes that near copies have in common lines.
NEAR = 0.8
#: Neighbours of a page at most.
BESIDE = 4
#: Neighbours that a line of an article must be shared with.
WITNESSES = 3
#: Cells of a table of two pages' lines; larger ones are halved.
CELLS = 1 << 20

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "canvas", "select", "button", "math"}
_RAW_END = {t: re.compile(rf"</{t}\s*[^>]*>", re.I) for t in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_BOX = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head"}
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_BOX_NAME = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|share|social|sidebar|side|menu|nav\w*|breadcrumbs?|header|footer|comments?|related|navigation|complementary|contentinfo|search)(?=[\s_-]|$)", re.I)
_CONTAINERS = {"div", "section", "ul", "ol", "p", "table", "span", "li", "dl", "figure", "main", "article"}


def blocks(page: str | None) -> list[tuple[str, int, bool]]:
    """``(text, number of the outermost article or 0, in a box that isn't main text)`` of each block, in page order.

    Character references are decoded, white space runs are one space, empty blocks are left out.
    A header inside an article is the article's own.  Unclosed tags end with their container.
    """
    out: list[tuple[str, int, bool]] = []
    if not page:
        return out
    stack: list[tuple[str, int, bool]] = []  # tag, article, box
    articles, article, box = 0, 0, False
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, article, box))

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag not in _INLINE and (tag not in _RAW or tag == "title"):
            flush()
        if m[1]:
            if any(t == tag for t, *_ in stack):
                while stack:
                    t, article, box = stack.pop()
                    if t == tag:
                        break
            continue
        if tag in _RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag in _VOID or tag in _INLINE and tag != "span" or m[3].endswith("/") and tag not in _CONTAINERS:
            continue
        if tag == "p":  # a paragraph ends the one before
            while stack and stack[-1][0] == "p":
                _, article, box = stack.pop()
        names = " ".join(a or b or c for _, a, b, c in _ATTRIBUTE.findall(m[3])) if m[3] and tag in _CONTAINERS else ""
        boxed = tag in _BOX and not (tag == "header" and article) or bool(names) and _BOX_NAME.search(names) is not None
        if boxed and tag == "span":
            flush()
        stack.append((tag, article, box))
        if tag == "article" and not article:
            articles += 1
            article = articles
        box = box or boxed
    flush()
    return out


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with the first j of ``b``, for every j."""
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    whole = (1 << len(b)) - 1
    row = whole
    for x in a:
        both = row & at.get(x, 0)
        row = ((row + both) | (row - both)) & whole
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), count=len(b), bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _table(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``, by a table of all lengths."""
    rows = [[0] * (len(b) + 1)]
    for x in reversed(a):
        below, row = rows[-1], [0] * (len(b) + 1)
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x == b[j] else max(below[j], row[j + 1])
        rows.append(row)
    rows.reverse()
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(i)
            i, j = i + 1, j + 1
        elif rows[i + 1][j] >= rows[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _common(a: list[int], b: list[int], first: int = 0) -> list[int]:
    """As ``_table`` with memory in proportion to the lines; positions count from ``first``."""
    if not a or not b:
        return []
    if len(a) == 1:
        return [first] if a[0] in b else []
    if len(a) * len(b) <= CELLS:
        return [first + i for i in _table(a, b)]
    mid = len(a) // 2
    cut = int(np.argmax(_lengths(a[:mid], b) + _lengths(a[mid:][::-1], b[::-1])[::-1]))
    return _common(a[:mid], b[:cut], first) + _common(a[mid:], b[cut:], first + mid)


def shared_lines(mine: list[str], other: list[str]) -> set[int]:
    """Positions in ``mine`` of a longest common subsequence with ``other``."""
    head = 0
    while head < min(len(mine), len(other)) and mine[head] == other[head]:
        head += 1
    tail = 0
    while tail < min(len(mine), len(other)) - head and mine[-1 - tail] == other[-1 - tail]:
        tail += 1
    number: dict[str, int] = {}
    a, b = ([number.setdefault(x, len(number)) for x in lines[head : len(lines) - tail]] for lines in (mine, other))
    both = set(a) & set(b)
    at = [i for i, x in enumerate(a) if x in both]
    found = {*range(head), *range(len(mine) - tail, len(mine))}
    return found | {head + at[i] for i in _common([a[i] for i in at], [x for x in b if x in both])}


def frame_lines(mine: list[str], near: list[list[str]], article: set[int]) -> set[int]:
    """Positions in ``mine`` of lines that the neighbours share: all of one or two, all but one of
    more; at the positions ``article``, all of ``WITNESSES`` or more."""
    n = Counter(i for x in near for i in shared_lines(mine, x))
    need = len(near) - (len(near) > 2)
    return {i for i, k in n.items() if (k == len(near) >= WITNESSES if i in article else k >= need)}


def near_copies(a: dict[str, int], b: dict[str, int]) -> bool:
    """Whether pages, given as the characters that each line outside boxes has in all, are near copies."""
    most = max(sum(a.values()), sum(b.values()))
    return sum(min(n, b[x]) for x, n in a.items() if x in b) >= NEAR * most


def _address(url: str):
    """Host, path without query and fragment, and the path's directory, of a URL column."""
    u = F.coalesce(F.col(url), F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return host, path, F.regexp_extract(path, r"^(.*/)[^/]+/?$", 1)


def _finish(pages):
    """``(p_id, p_url, text)`` of the pages of one chunk, from ``(p_id, p_url, folder, lines, articles, boxed)`` in order."""
    before: deque[tuple] = deque(maxlen=BESIDE)  # last pages of the runs before
    runs: deque[list[tuple]] = deque()  # the run in work and those after it

    def neighbours(folder: str) -> list[list[str]]:
        """Lines of the two nearest pages on either side, of more on one if the other has fewer; of
        pages of the same directory if there are any."""
        after = [r[0] for r in list(runs)[1:]]
        left, right = ([p for p in side if p[2] == folder] for side in (before, after))
        if not left and not right:
            left, right = list(before), after
        n = min(len(right), max(BESIDE // 2, BESIDE - len(left)))
        return [p[3] for p in [*left[len(left) - min(len(left), BESIDE - n) :], *right[:n]]]

    def done(run):
        near, seen = {}, {}
        for p_id, p_url, folder, lines, articles, boxed in run:
            if folder not in near:
                near = {folder: neighbours(folder)}
            key = folder, tuple(lines), tuple(articles), tuple(boxed)
            if (text := seen.get(key)) is None:
                found = {a for a, x in zip(articles, boxed, strict=True) if a and not x}
                only = found.pop() if len(found) == 1 else 0
                gone = frame_lines(lines, near[folder], {i for i, a in enumerate(articles) if only and a == only})
                text = "\n".join(t for i, (t, a, x) in enumerate(zip(lines, articles, boxed, strict=True)) if i not in gone and not x and (not only or a == only))
                seen = {key: text}
            yield p_id, p_url, text
        before.append(run[-1])

    last = None
    for page in pages:
        if not page[3]:
            yield page[0], page[1], ""
            continue
        size: dict[str, int] = {}
        for t, x in zip(page[3], page[5], strict=True):
            if not x:
                size[t] = size.get(t, 0) + len(t)
        if last is not None and near_copies(last, size):
            runs[-1].append(page)
        else:
            runs.append([page])
            if len(runs) > BESIDE + 1:
                yield from done(runs[0])
                runs.popleft()
        last = size
    while runs:
        yield from done(runs[0])
        runs.popleft()


def _chunks(batches):
    """``(chunk, page rows)`` of sorted batches; a chunk's rows must be used before the next chunk."""
    rows = ((r[:2], r[2:]) for b in batches for part in slices([b], 64) for r in zip(*(c.to_pylist() for c in part.columns), strict=True))
    for key, group in groupby(rows, lambda r: r[0]):
        yield key, (r[1] for r in group)


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per page: id, url, ``text``, ``n_chars``.

    A null or empty page has empty text.  Null URLs are one host with one path.  Copies keep their
    text under any address, a row that is repeated with its id and URL too.  A page without
    neighbours loses nothing to the difference.  Pages of any length are aligned whole, in memory in
    proportion to their lines.  Extra columns are ignored, whatever their names; no rows give none.
    """
    host, path, folder = _address(url)
    rows = pages.select(F.col(id_col).alias("p_id"), F.col(url).alias("p_url"), host.alias("host"), path.alias("path"), folder.alias("folder"), F.col(page).alias("html"))
    address = F.struct("host", "path", F.coalesce("p_url", F.lit("")), F.coalesce(F.col("p_id").cast("string"), F.lit("")))
    count = pages.count()
    every = max(CHUNK, -(-count // CUTS)) // PICKED
    # PICKED * CUTS addresses at most
    picked = [] if count <= CHUNK else rows.where(F.pmod(F.xxhash64(address), F.lit(every)) == 0).select(address).distinct().collect()
    cuts = sorted(tuple(r[0]) for r in picked)[PICKED - 1 :: PICKED]
    spread = pages.sparkSession.sparkContext.broadcast(cuts)

    def parse(batches):
        cuts = spread.value
        for b in slices(batches):
            found = [blocks(x) for x in b.column(5).to_pylist()]
            ids, urls, hosts, paths = (b.column(i).to_pylist() for i in range(4))
            keys = [(h, p, u or "", "" if i is None else str(i)) for i, u, h, p in zip(ids, urls, hosts, paths, strict=True)]
            chunks = pa.array([bisect.bisect_right(cuts, k) for k in keys], pa.int64())
            columns = [pa.array([[x[i] for x in f] for f in found], pa.list_(t)) for i, t in enumerate((pa.string(), pa.int32(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], chunks, *columns], ["p_id", "p_url", "host", "path", "folder", "chunk", "lines", "articles", "boxed"])

    kind = rows.schema[0].dataType.simpleString()
    parsed = rows.mapInArrow(parse, f"p_id {kind}, p_url string, host string, path string, folder string, chunk long, lines array<string>, articles array<int>, boxed array<boolean>")
    together = parsed.repartition("host", "chunk").sortWithinPartitions("host", "chunk", "path", "p_url", "p_id", F.xxhash64("lines"))

    def finish(batches):
        out = []
        for _, some in _chunks(batches):
            for row in _finish(some):
                out.append(row)
                if len(out) == 256:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    def batch(out):
        texts = [t for *_, t in out]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], id_type), pa.array([r[1] for r in out], pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, url, "text", "n_chars"])

    id_type = to_arrow_type(rows.schema[0].dataType)
    chosen = together.select("host", "chunk", "p_id", "p_url", "folder", "lines", "articles", "boxed")
    return chosen.mapInArrow(finish, f"`{id_col}` {kind}, `{url}` string, text string, n_chars long")
