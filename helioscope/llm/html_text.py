"""Main text of web pages: blocks by structure, and page differencing against the nearest URL of the host.

Blocks of menus, headers, footers, sidebars, notices, adverts, forms and comments go by their tags and names. The
lines that remain of every page are compared with those of the page whose URL path comes next to it within its host:
the two are aligned by longest common subsequence, and shared lines go. One thing is held against that: lines inside a
marked article stay when they are shared, as mirrored articles and quoted passages are shared, too, yet belong to the text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, small_batches

TOKEN = re.compile(r"<!--|<(/?)([A-Za-z][^\s/>]*)([^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>|<[!?][^>]*+>")
#: Elements by what they do.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
DROPPED = frozenset("head nav header footer aside form button select option menu dialog svg canvas video audio object iframe fieldset label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSED_BY = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"])}
JUNK_NAMES = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|cookie\w*|consent|notice|popup|modal|newsletter|subscribe|sidebar|side|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|foot|comments?|comment-\w+|respond|replies|disqus\w*|related|recommend\w*|share|sharing|social|widget|toolbar|login|signup|search|skip|pagination|pager)(?:$|[\s_-])", re.I)
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
BLANK = re.compile(r"\s+")


def is_junk(tag: str, attributes: str) -> bool:
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if name in ("class", "id") and JUNK_NAMES.search(value) or name == "role" and value.lower() in JUNK_ROLES or name == "aria-hidden" and value == "true":
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$)", attributes))


def blocks(page: str) -> list[tuple[bool, str]]:
    """(in an article, text) of each block that isn't junk, in page order; white space inside is one space."""
    out: list[tuple[bool, str]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, junk at or above, main at or above

    def flush() -> None:
        if held:
            text = BLANK.sub(" ", html.unescape("".join(held))).strip()
            if text:
                out.append((bool(stack) and stack[-1][2], text))
            held.clear()

    def close(depth: int) -> None:
        while len(stack) > depth:
            if stack[-1][0] in BLOCK:
                flush()
            stack.pop()

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not (stack and stack[-1][1]):
            held.append(page[at:lt])
        if lt == n:
            break
        m = TOKEN.match(page, lt)
        if m is None:  # a lone sign is text
            if not (stack and stack[-1][1]):
                held.append("&lt;")
            at = lt + 1
            continue
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    if tag in BLOCK or stack[depth][1]:
                        flush()
                    close(depth)
                    break
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = n if end is None else end.end()
            continue
        for inner, by in CLOSED_BY.items():
            if tag in by:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == inner or stack[i][0] in ("ul", "ol", "table", "dl", "article", "main", "section", "div") and inner != stack[i][0]), -1)
                if depth >= 0 and stack[depth][0] == inner:
                    close(depth)
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        junk, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if not junk and is_junk(tag, m[3]):
            flush()
            junk = True
        if not m[3].endswith("/") or tag in BLOCK:
            stack.append((tag, junk, main or tag in ("article", "main")))
    flush()
    return out


def lengths(a: list[str], b: list[str]) -> np.ndarray:
    """The lengths of the longest common subsequences of a with b[:0], b[:1], ... b, a bit a line of b."""
    places: dict[str, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        if u := v & places.get(x, 0):
            v = (v + u | v - u) & full
    bits = np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    return np.concatenate([[0], np.cumsum(1 - np.unpackbits(bits, bitorder="little")[: len(b)].astype(np.int64))])


def halved(a: list[str], b: list[str], mark: list[bool], at: int) -> None:
    """Marks a longest common subsequence by halving a and cutting b where both halves fit best: memory in proportion to the lines."""
    if not a or not b:
        return
    if len(a) == 1:
        mark[at] = a[0] in b
        return
    mid = len(a) // 2
    cut = int((lengths(a[:mid], b) + lengths(a[mid:][::-1], b[::-1])[::-1]).argmax())
    halved(a[:mid], b[:cut], mark, at)
    halved(a[mid:], b[cut:], mark, at + mid)


def common(a: list[str], b: list[str], most_pairs: int = 200_000) -> list[bool]:
    """Which lines of a lie on a longest common subsequence with b.

    Common ends first; then by equal pairs (Hunt and Szymanski) where these are few, and by bits (`halved`) where lines
    that repeat many times make more than most_pairs of them.
    """
    mark = [False] * len(a)
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        mark[low] = True
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        mark[-1 - high] = True
        high += 1
    places: dict[str, list[int]] = {}
    for j in range(len(b) - high - 1, low - 1, -1):
        places.setdefault(b[j], []).append(j)
    if sum(len(places.get(x, ())) for x in a[low : len(a) - high]) > most_pairs:
        halved(a[low : len(a) - high], b[low : len(b) - high], mark, low)
        return mark
    tails: list[int] = []
    nodes: list[tuple] = []
    for i in range(low, len(a) - high):
        for j in places.get(a[i], ()):
            k = bisect_left(tails, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                nodes.append(node)
            else:
                tails[k], nodes[k] = j, node
    node = nodes[-1] if nodes else None
    while node:
        mark[node[0]], node = True, node[1]
    return mark


def main_text(lines: list[str], article: list[bool], near: list[str] | None) -> tuple[str, int]:
    """(text, how many lines the page shares with its neighbour). With a marked article only its lines are text, and all of them."""
    shared = common(lines, near) if near else [False] * len(lines)
    if any(article):
        kept = [t for t, m in zip(lines, article, strict=True) if m]
    else:
        kept = [t for t, s in zip(lines, shared, strict=True) if not s]
    return "\n".join(kept if kept else lines), sum(shared)  # a full copy of its neighbour is no boilerplate


#: kind 0: a finished page; 1: the first page of a part, whose neighbour may lie in another part; 2 and 3: the last and the first lines of a part.
PLACED = "part int, kind int, host string, page_id long, url string, text string, n_shared long, article array<boolean>, near string"


CODEC = "zstd"


def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's html compressed by itself, with its length: what is shuffled is a third of what goes in."""
    codec = pa.Codec(CODEC)
    for batch in batches:
        data = [(x.as_py() or "").encode() for x in batch.column("html")]
        packed = pa.array([codec.compress(x, asbytes=True) for x in data], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("page_id", "url", "host", "path", "tie")), pa.array(map(len, data), pa.int64()), packed], ["page_id", "url", "host", "path", "tie", "size", "packed"])


def placed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Differences the pages of one part as they come, sorted by host and path; each holds only its neighbour."""
    part, codec = TaskContext.get().partitionId(), pa.Codec(CODEC)
    names = [x.split()[0] for x in PLACED.split(", ")]
    types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.bool_()), pa.string()]
    schema = pa.schema(list(zip(names, types, strict=True)))
    out: list[tuple] = []
    first = waiting = last = None  # (host, page_id, url, lines, article)

    def done(page: tuple, near: list[str] | None) -> None:
        text, n = main_text(page[3], page[4], near)
        out.append((part, 0, None, page[1], page[2], text, n, None, None))

    for batch in batches:
        for page_id, url, host, size, packed in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "host", "size", "packed")), strict=True):
            own = blocks(codec.decompress(packed, size, asbytes=True).decode())
            page = (host, page_id, url, [t for _, t in own], [m for m, _ in own])
            if waiting is not None:
                same = waiting[0] == host and host != ""
                if waiting is first:
                    out.append((part, 1, host if same else None, *first[1:3], "\n".join(first[3]), None, first[4], "\n".join(page[3]) if same else None))
                else:
                    done(waiting, page[3] if same else None)
                waiting = None
            if last is None:
                first = waiting = page
            elif last[0] == host and host != "":
                done(page, last[3])
            else:
                waiting = page
            last = page
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(types), types, strict=True)], schema=schema)
        out = []
    if last is None:
        return
    if waiting is not None:
        if waiting is first:
            out.append((part, 1, None, *first[1:3], "\n".join(first[3]), None, first[4], None))
        else:
            done(waiting, None)
    out += [(part, 3, first[0], None, None, "\n".join(first[3]), None, None, None), (part, 2, last[0], None, None, "\n".join(last[3]), None, None, None)]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], schema=schema)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared) for every row; n_shared: lines shared with the nearest URL's page.

    Null and empty html give the empty text; html of any length is read whole. Pages are ordered by host, path, query and
    page_id in ranges, so a host of any size is spread over tasks; a page's neighbour is the one before it of its
    host, for the first one the one after. A part's first page waits as a boundary record for the last page of the part
    before; there are two such records a part, and they are joined by part, so nothing depends on how files are read.
    Repeated rows are neighbours of each other and keep their text; a page alone on its host, or with a null url,
    has no neighbour. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    spark = pages.sparkSession
    small_batches(spark)
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    order = ["host", "path", "page_id", "tie"]
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"), F.xxhash64("html").alias("tie"), "html")
    rows = rows.mapInArrow(squeezed, "page_id long, url string, host string, path string, tie long, size long, packed binary")
    rows = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(placed_rows, PLACED), "pages")
    parts = [r["part"] for r in rows.filter("kind = 2").select("part").sort("part").collect()]  # a number a part
    beside = spark.createDataFrame(list(zip(parts, [None, *parts], [*parts[1:], None], strict=False)), "part int, before int, after int")
    last = rows.filter("kind = 2").select(F.col("part").alias("before"), F.col("host").alias("last_host"), F.col("text").alias("last_text"))
    ends = rows.filter("kind = 3").select("part", F.col("host").alias("own_host"), "text")
    after = ends.select(F.col("part").alias("after"), F.col("own_host").alias("next_host"), F.col("text").alias("next_text"))
    open_ = rows.filter("kind = 1").select("part", "page_id", "url", "text", "article", "near").join(ends.drop("text"), "part").join(beside, "part").join(last, "before", "left").join(after, "after", "left")
    near = F.when((F.col("own_host") != "") & (F.col("own_host") == F.col("last_host")), F.col("last_text")).when(F.col("near").isNotNull(), F.col("near")).when((F.col("own_host") != "") & (F.col("own_host") == F.col("next_host")), F.col("next_text"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = lambda x: x.split("\n") if x else []
        for batch in batches:
            done = [main_text(cut(t), a or [], cut(n)) for t, a, n in zip(*(batch.column(k).to_pylist() for k in ("text", "article", "near")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["page_id", "url", "text", "n_shared"])

    firsts = open_.select("page_id", "url", "text", "article", near.alias("near")).mapInArrow(finish, "page_id long, url string, text string, n_shared long")
    out = rows.filter("kind = 0").select("page_id", "url", "text", "n_shared").unionByName(firsts)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")
