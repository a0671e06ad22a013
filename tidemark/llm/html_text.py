"""Main text of web pages by nearest-URL page differencing.

Every page is cut into text lines (blocks). What the markup itself names as menu, header,
footer, sidebar, notice, advert, form, script or comment is no content, and where the page
has an article or main element only its lines are. The lines of all other pages are
compared with the page nearest by URL path on the same host: both line lists are aligned
by longest common subsequence, and shared lines, the host's template, are deleted. A
neighbour that is a copy of the page shows nothing about the template; then the other
neighbour is used, or none.

Articles share passages with one another, so there one neighbour proves nothing: a line of
an article or main element is template, and deleted, where it is aligned with each of the
``RUN`` nearest pages of the host that are no copies. Fewer such pages decide nothing.

Neighbours come from one sort by host and path, cut into ranges of bounded size, so a hot
host spans many tasks; the ends of neighbouring ranges are exchanged through a small table.
"""

from __future__ import annotations

import html
import os.path
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.groups import match
from tidemark.llm.columns import own_names, text_of, without
from tidemark.llm.url_filters import host_of, path_of
from tidemark.session import BROADCAST_ROWS, save_stage, setting

RANGE_PAGES = 2000  # pages in a range of the sort
MOST_RANGES = 10_000
COPY_SHARE = 0.9  # a neighbour sharing this much of the text is a copy
RUN = 12  # pages that must share a line of an article
LCS_BITS = 500_000_000  # alignment table that is kept whole; larger ones are split

TAG = re.compile(r"<(/?)([A-Za-z][^\s/><]*)")
QUOTE_OR_END = re.compile(r"[\"'>]")
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
    "nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea noscript template iframe object svg math canvas noembed".split())
DROPPED = frozenset(
    "head title nav footer aside form menu dialog search button select label fieldset datalist".split()
) | RAW
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of class, id or role that say what an element is.
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice popup modal overlay newsletter subscribe subscription paywall nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar aside footer comments comment respond disqus reply "
    "replies related share sharing social widget toolbar login signup search pagination pager "
    "contentinfo complementary dialog alert masthead skip".split()
)
# Words that may stand beside them in a name; with any other word the name says something else
# ("comments-open", "has-sidebar", "related-work").
BESIDE = frozenset(
    "area article bar block body bottom box btn button buttons container content desktop entry fixed float "
    "global group icons inner item items left links list main mobile outer page panel post primary reader "
    "right secondary section site sticky top user wrap wrapper".split()
)
SELF_CLOSING = frozenset("p li dt dd option tr td th".split())


@dataclass
class Element:
    tag: str
    dropped: bool
    main: bool
    named: bool = False  # dropped by its class, id or role alone


@dataclass
class Page:
    lines: list[str] = field(default_factory=list)  # every visible line
    kept: list[bool] = field(default_factory=list)  # not in a dropped element
    main: list[bool] = field(default_factory=list)  # in an article or main element


def _is_dropped(tag: str, in_main: bool) -> bool:
    return tag in DROPPED or tag == "header" and not in_main


def _is_named(tag: str, rest: str, in_main: bool) -> bool:
    """Whether class, id or role say that the element is no content."""
    if "=" not in rest or tag in ("html", "body", "article", "main") and "comment" not in rest:
        return False
    dropped = DROPPED_NAMES if in_main else DROPPED_NAMES | {"header"}
    for _, name in _names(rest):
        words = [w for w in re.split(r"[_-]+", name) if not w.isdigit()]
        if not dropped.isdisjoint(words) and all(w in dropped or w in BESIDE for w in words):
            return True
    return False


def _names(rest: str) -> Iterator[tuple[str, str]]:
    """Each name in class, id and role, in lower case."""
    for m in NAMES.finditer(rest):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            yield m[1].lower(), name


@dataclass
class _Tag:
    start: int
    end: int
    closing: bool
    name: str  # empty for comments and declarations
    rest: str


class _Scanner:
    """Tags of a page in order. What is not found once is not looked for again, so broken
    markup takes time in proportion to its length."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.last_end = source.rfind(">")
        self.lost: set[str] = set()  # raw tags that are never closed, quotes that never end
        self.dead: set[int] = set()  # places after a quote from where no tag ends

    def tag(self, at: int) -> _Tag | None:
        source = self.source
        while (start := source.find("<", at)) >= 0:
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                return _Tag(start, len(source) if end < 0 else end + 3, False, "", "")
            if start > self.last_end:
                # Only an unclosed comment can follow.
                start = source.find("<!--", start)
                return _Tag(start, len(source), False, "", "") if start >= 0 else None
            if source.startswith(("<!", "<?"), start):
                return _Tag(start, source.index(">", start) + 1, False, "", "")
            if named := TAG.match(source, start):
                end = self._end(named.end())
                return _Tag(start, end + 1, bool(named[1]), named[2].lower(), source[named.end():end])
            at = start + 1
        return None

    def _end(self, at: int) -> int:
        """The ``>`` outside quotes, or the first one where a quote does not end."""
        first, source, met = at, self.source, []
        while at not in self.dead and (found := QUOTE_OR_END.search(source, at)):
            if found[0] == ">":
                return found.start()
            close = -1 if found[0] in self.lost else source.find(found[0], found.end())
            if close < 0:
                self.lost.add(found[0])
                break
            at = close + 1
            met.append(at)
        self.dead.update(met)
        return source.index(">", first)

    def raw_end(self, name: str, at: int) -> int:
        """End of the raw element, or -1."""
        if name in self.lost:
            return -1
        closed = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(self.source, at)
        if closed:
            return closed.end()
        self.lost.add(name)
        return -1


def parse(source: str, spared: frozenset[int] = frozenset()) -> Page:
    """Lines of a page. Elements that start at ``spared`` are not dropped by name.

    Where all articles are inside elements dropped by name, those are wrappers of the page
    and the page is read again with them spared.
    """
    page, stack, text = Page(), [], []
    dropped = main = 0
    named, wrappers = [], set()  # starts: of open elements dropped by name, of those around articles

    def flush() -> None:
        line = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if line:
            page.lines.append(line)
            page.kept.append(dropped == 0)
            page.main.append(main > 0)

    def pop() -> None:
        nonlocal dropped, main
        top = stack.pop()
        dropped -= top.dropped
        if top.named:
            named.pop()
        main -= top.main

    at, size, open_tags, scanner = 0, len(source), {}, _Scanner(source)
    while at < size:
        m = scanner.tag(at)
        if m is None:
            text.append(source[at:])
            break
        text.append(source[at:m.start])
        at, tag, rest, closing = m.end, m.name, m.rest, m.closing
        if not tag:
            continue
        if tag in BLOCKS or tag in RAW:
            flush()
        elif tag == "br":
            text.append(" ")
        if closing:
            if open_tags.get(tag):
                flush()
                while True:
                    top = stack[-1].tag
                    pop()
                    open_tags[top] -= 1
                    if top == tag:
                        break
            continue
        if tag in RAW:
            end = scanner.raw_end(tag, at)
            at = end if end >= 0 else size if tag in ("script", "style") else at
            continue
        if tag in BLOCKS and stack and stack[-1].tag in SELF_CLOSING and tag not in ("ul", "ol", "dl"):
            open_tags[stack[-1].tag] -= 1
            pop()
        if tag in VOID or rest.endswith("/"):
            continue
        hard = _is_dropped(tag, main > 0)
        by_name = not hard and m.start not in spared and _is_named(tag, rest, main > 0)
        drop = hard or by_name
        is_main = not drop and (tag in ("article", "main") or "role" in rest and ("role", "main") in _names(rest))
        if drop or tag in BLOCKS and tag not in SELF_CLOSING:
            flush()
            if is_main and dropped and dropped == len(named) and named[-1] not in wrappers:
                wrappers.update(named)
            if by_name:
                named.append(m.start)
            stack.append(Element(tag, drop, is_main, by_name))
            open_tags[tag] = open_tags.get(tag, 0) + 1
            dropped += drop
            main += is_main
    flush()
    if wrappers and not spared and not any(k and x for k, x in zip(page.kept, page.main)):
        return parse(source, frozenset(wrappers))
    return page


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``.

    Rows of the alignment table are bit vectors; a table above ``LCS_BITS`` is split in two
    at the best point (divide and conquer), so memory stays bounded.
    """
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    inside = _aligned(a[head:len(a) - tail], b[head:len(b) - tail])
    return [*range(head), *(head + i for i in inside), *range(len(a) - tail, len(a))]


def _rows(a: list[int], b: list[int], every: bool) -> list[int]:
    """Row vectors: a zero at bit i where the common length grows with a[i]."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, rows = full, [full]
    for y in b:
        if hit := row & at.get(y, 0):
            row = (row + hit | row - hit) & full
        if every:
            rows.append(row)
    return rows if every else [row]


def _aligned(a: list[int], b: list[int]) -> list[int]:
    if not a or not b or set(a).isdisjoint(b):
        return []
    if len(a) * len(b) > LCS_BITS and len(b) > 1:
        half = len(b) // 2
        left = _lengths(a, b[:half])
        right = _lengths(a[::-1], b[half:][::-1])[::-1]
        cut = int(np.argmax(left + right))
        return _aligned(a[:cut], b[:half]) + [cut + i for i in _aligned(a[cut:], b[half:])]
    rows, found = _rows(a, b, True), []
    i, j = len(a), len(b)
    while i and j:
        if rows[j] >> i - 1 & 1:
            i -= 1
        elif rows[j - 1] >> i - 1 & 1:
            i, j = i - 1, j - 1
            found.append(i)
        else:
            j -= 1
    return found[::-1]


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Common length of each prefix of ``a`` with ``b``."""
    row = _rows(a, b, False)[0]
    bits = np.unpackbits(
        np.frombuffer(row.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little"
    )[:len(a)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _hashes(lines: list[str]) -> list[int]:
    return [xxhash.xxh64_intdigest(x) - (1 << 63) for x in lines]


PARSED = [
    T.StructField("__text", T.StringType()),  # final where the markup settles it, else NULL
    T.StructField("__lines", T.ArrayType(T.StringType(), False)),  # kept lines of an open page
    T.StructField("__hashes", T.ArrayType(T.LongType(), False)),  # all lines
    T.StructField("__at", T.ArrayType(T.IntegerType(), False)),  # final lines among all lines
    T.StructField("__sizes", T.ArrayType(T.IntegerType(), False)),  # their lengths
]


def _parsed(rows: DataFrame, html_col: str) -> DataFrame:
    kept = [c for c in rows.columns if c != html_col]
    schema = T.StructType([*[rows.schema[c] for c in kept], *PARSED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, hashes, places, sizes = [], [], [], [], []
            for value in batch.column(html_col):
                page = parse(value.as_py())
                at = [i for i, (k, m) in enumerate(zip(page.kept, page.main)) if k and m]
                body = [page.lines[i] for i in at]
                open_page = not body and any(page.kept)
                texts.append(None if open_page else "\n".join(body))
                lines.append([x for x, k in zip(page.lines, page.kept) if k] if open_page else None)
                hashes.append(_hashes(page.lines))
                places.append(at)
                sizes.append([len(x) for x in body])
            yield pa.RecordBatch.from_arrays(
                [*batch.select(kept).columns, pa.array(texts, pa.string()),
                 pa.array(lines, pa.list_(pa.field("element", pa.string(), False))),
                 pa.array(hashes, pa.list_(pa.field("element", pa.int64(), False))),
                 *[pa.array(x, pa.list_(pa.field("element", pa.int32(), False))) for x in (places, sizes)]],
                names=[*kept, *[f.name for f in PARSED]],
            )

    return rows.mapInArrow(run, schema)


def _sorted(rows: DataFrame, n: int) -> DataFrame:
    """The rows by host and path with their range, saved so that every page stays in it."""
    ranges = min(n // RANGE_PAGES + 1, MOST_RANGES)
    return save_stage(
        rows.repartitionByRange(ranges, "__host", "__path", "__row")
        .withColumn("__part", F.spark_partition_id())
    )


def _neighbours(parsed: DataFrame) -> DataFrame:
    """``__row``, ``__before`` and ``__after``: the pages next to each by host and path."""
    keys = parsed.select("__host", "__path", "__row")
    sorted_keys = _sorted(keys, parsed.count())
    key = F.struct("__host", "__path", "__row")
    ends = sorted_keys.groupBy("__part").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    by_part = Window.orderBy("__part")  # one row per range, MOST_RANGES at most
    ends = ends.select(
        "__part", F.lag("high").over(by_part).alias("__left"), F.lead("low").over(by_part).alias("__right")
    )
    line = Window.partitionBy("__part").orderBy("__host", "__path", "__row")
    around = sorted_keys.join(F.broadcast(ends), "__part").select(
        "__row", "__host",
        F.coalesce(F.lag(key).over(line), "__left").alias("__left"),
        F.coalesce(F.lead(key).over(line), "__right").alias("__right"),
    )
    same = lambda side: F.when(F.col(f"{side}.__host") == F.col("__host"), F.col(f"{side}.__row"))
    return around.select("__row", same("__left").alias("__before"), same("__right").alias("__after"))


def _runs(parsed: DataFrame) -> DataFrame:
    """Pages with final lines, each with the pages of its host up to ``RUN`` places away.

    Only pages that share a final line with at least ``RUN`` of those are returned.
    """
    rows = parsed.select("__host", "__path", "__row", "__hashes", "__at", "__sizes")
    rows = _sorted(rows, parsed.count())
    by_part = Window.orderBy("__part")  # one row per range, MOST_RANGES at most
    starts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).select(
        "__part", (F.sum("n").over(by_part) - F.col("n")).alias("__start")
    )
    line = Window.partitionBy("__part").orderBy("__host", "__path", "__row")
    place = F.col("__place")
    block = lambda at: F.floor(at / RANGE_PAGES)
    # A block also gets the pages around its ends.
    spread = (
        rows.join(F.broadcast(starts), "__part")
        .withColumn("__place", F.col("__start") + F.row_number().over(line) - 1)
        .withColumn("__block", F.explode(F.sequence(block(place - RUN), block(place + RUN))))
    )
    around = Window.partitionBy("__block").orderBy("__place").rowsBetween(-RUN, RUN)
    near = F.collect_list(F.struct("__host", "__path", "__place", "__hashes")).over(around)
    mine = F.transform("__at", lambda i: F.get("__hashes", i))
    found = spread.withColumns({"__near": near, "__mine": mine}).where(
        (F.col("__block") == block(place)) & (F.size("__at") > 0)
    )
    found = found.withColumn("__near", F.filter(
        "__near", lambda x: (x["__host"] == F.col("__host")) & (x["__place"] != place)
    ))
    sharing = F.filter("__near", lambda x: F.arrays_overlap(x["__hashes"], F.col("__mine")))
    return found.where(F.size(sharing) >= RUN).select(
        "__row", "__path", "__place", "__mine", "__sizes", "__near"
    )


def recurring(mine: list[int], sizes: list[int], neighbours: list[list[int]]) -> list[int]:
    """Positions of lines aligned with each of the first ``RUN`` neighbours that are no copies."""
    found, pages = set(range(len(mine))), 0
    for theirs in neighbours:
        shared = set(common_lines(mine, theirs))
        if sum(sizes[i] for i in shared) >= COPY_SHARE * sum(sizes):
            continue
        found, pages = found & shared, pages + 1
        if pages == RUN or not found:
            break
    return sorted(found) if pages == RUN else []


def _template_lines(runs: DataFrame) -> DataFrame:
    """``__row`` and ``__gone``, the positions of template lines among the final lines."""
    positions = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([runs.schema["__row"], T.StructField("__gone", positions, False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, gone = [], []
            for page in batch.to_pylist():
                near = sorted(page["__near"], key=lambda x: (
                    -len(os.path.commonprefix([page["__path"], x["__path"]])),
                    abs(x["__place"] - page["__place"]), x["__place"],
                ))
                lines = recurring(page["__mine"], page["__sizes"], [x["__hashes"] for x in near])
                if lines:
                    rows.append(page["__row"])
                    gone.append(lines)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()),
                 pa.array(gone, pa.list_(pa.field("element", pa.int32(), False)))], ["__row", "__gone"],
            )

    return runs.mapInArrow(run, schema)


def _without_template(settled: DataFrame, parsed: DataFrame) -> DataFrame:
    """Settled pages less the lines that recur along their host's run of paths."""
    gone = save_stage(_template_lines(_runs(parsed)))
    n = gone.count()
    if n == 0:
        return settled
    few = n <= setting(parsed.sparkSession, BROADCAST_ROWS)
    rest = F.filter(F.split("__text", "\n"), lambda x, i: ~F.array_contains("__gone", i))
    return match(settled, F.broadcast(gone) if few else gone, ["__row"], "left").withColumn(
        "__text", F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(F.array_join(rest, "\n"))
    )


def _differenced(pages: DataFrame) -> DataFrame:
    """Final text of open pages, from their lines and the lines of both neighbours."""
    schema = T.StructType([pages.schema["__row"], T.StructField("__final", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            for page in batch.to_pylist():
                sides = [(len(os.path.commonprefix([page["__path"], page[f"{s}path"]])), page[f"{s}hashes"])
                         for s in ("__b", "__a") if page[f"{s}hashes"] is not None]
                lines = page["__lines"]
                rows.append(page["__row"])
                texts.append("\n".join(delete_shared(
                    lines, [h for _, h in sorted(sides, key=lambda x: -x[0])]
                )))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(texts, pa.string())], ["__row", "__final"]
            )

    return pages.mapInArrow(run, schema)


def delete_shared(lines: list[str], neighbours: list[list[int]]) -> list[str]:
    """Lines not shared with the nearest neighbour that is no copy."""
    mine, total = _hashes(lines), sum(map(len, lines))
    for theirs in neighbours:
        shared = set(common_lines(mine, theirs))
        if sum(len(lines[i]) for i in shared) < COPY_SHARE * total:
            return [x for i, x in enumerate(lines) if i not in shared]
    return lines


@own_names
def extract_text(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text"
) -> DataFrame:
    """Pages without the html, with ``text`` and ``n_chars`` (code points).

    A NULL html is empty and gives an empty text; a NULL url has an empty host, whose pages
    are neighbours of each other. Repeated rows are copies, which are not deleted. Columns
    named like the new ones are replaced.
    """
    rows = without(pages, [text_col, "n_chars"]) if html_col != text_col else pages
    url = F.col(url_col).cast("string")
    rows = rows.withColumns({
        html_col: text_of(html_col), "__host": host_of(url), "__path": path_of(url),
        "__row": F.monotonically_increasing_id(),
    })
    parsed = save_stage(_parsed(rows, html_col))
    open_pages = parsed.where(F.col("__text").isNull())
    given = [c for c in pages.columns if c in parsed.columns and c not in (text_col, "n_chars")]
    settled = _without_template(parsed.where(F.col("__text").isNotNull()), parsed).select(
        *[F.col(f"`{c}`") for c in given], F.col("__text").alias(text_col)
    )
    if not open_pages.isEmpty():
        nearby = _neighbours(parsed)
        lines = open_pages.select("__row", "__path", "__lines").join(nearby, "__row")
        for side, name in (("__b", "__before"), ("__a", "__after")):
            other = parsed.select(
                F.col("__row").alias(name), F.col("__path").alias(f"{side}path"),
                F.col("__hashes").alias(f"{side}hashes"),
            )
            lines = lines.join(other, name, "left")
        final = _differenced(lines.drop("__before", "__after"))
        more = open_pages.join(final, "__row").select(
            *[F.col(f"`{c}`") for c in given], F.col("__final").alias(text_col)
        )
        settled = settled.unionByName(more)
    return settled.withColumn("n_chars", F.length(text_col).cast("long"))
