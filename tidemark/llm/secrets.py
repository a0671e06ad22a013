"""Secret scans through nested encodings.

Each text is scanned as it stands (the base spans). Then a worklist unwraps its encoded
parts - percent escapes, Unicode escapes, base64, and gzip, zlib or raw deflate data in
base64 - and scans what comes out, until nothing new does. A layer already seen in the
chain is not unwrapped again, which ends cycles. Compressed data is inflated to its end, all
members of it, and scanned in overlapping chunks, so that a decompression bomb cannot take the memory. A finding in a layer gets the span of the text that its letters
came from; within base64 that is the whole encoded part. Stray bytes of a decoded layer are
replaced, and the rest of it is scanned.

Base64 may be broken into lines of equal width. Compressed data that is cut off or damaged is
scanned up to there. Decoded data may be UTF-8 or UTF-16. Nested percent signs and backslashes
(``%252541``) are undone in one step, without a layer for each depth.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.columns import text_of, without

CHUNK = 16_000_000  # letters of a compressed layer that are scanned at a time
LONGEST = 4 * CHUNK  # a longer run without white space is cut, after whole groups of base64
OVERLAP = 4096
BLOCK = 65_536  # bytes given to the decompressor at a time

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of fewer is dropped, and runs cannot overlap
KINDS = ("assign", "access", "hex")

# An escaped percent sign or backslash in front of an escape nests it; all depths of one escape
# are undone in one step, so deep nesting takes no layer per depth.
CODES = r"u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|U([0-9A-Fa-f]{8})|u\{([0-9A-Fa-f]{1,6})\}"
NESTED = r"\\(?:u005[Cc]|x5[Cc]|U0000005[Cc]|u\{0{0,4}5[Cc]\})*"
ONE_ESCAPE = re.compile(f"{NESTED}(?:{CODES})")
ESCAPES = re.compile(f"(?:{NESTED}(?:{CODES.replace('(', '(?:')}))+")
ONE_PERCENT = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
PERCENTS = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
LINE_END = re.compile(r"\r?\n")
LINE = re.compile(r"[A-Za-z0-9+/][A-Za-z0-9+/_-]*={0,2}(?=[\x20\t]*(?:\r?\n|\Z))")
BASE64_PART = re.compile(r"[A-Za-z0-9]{16,}={0,2}")
PLAIN_RUN = re.compile(r"[0-9a-f]+|[A-Z]+|[A-Z]?[a-z]+|[0-9]+")  # a word or a number


class Span(NamedTuple):
    start: int
    kind: int  # position in KINDS
    end: int

    def text(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


def scan(text: str) -> list[Span]:
    """Spans of the three kinds, each leftmost and not overlapping within its kind."""
    found = [Span(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= 20]
    found += [Span(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _printable(data: bytes) -> str | None:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = "\0"
    odd = sum(1 for c in text if c < " " and c not in "\t\n\r")
    return text if text and odd == 0 else _wide(data)


def _wide(data: bytes) -> str | None:
    """Text of two-byte letters: marked as such, or with a zero in nearly every pair."""
    if len(data) < 8:
        return None
    marked = {b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}.get(data[:2])
    half = len(data) // 2
    zeros = data[0:2 * half:2].count(0), data[1:2 * half:2].count(0)
    share = 0.3 if marked else 0.8
    code = "utf-16-be" if zeros[0] > share * half else "utf-16-le" if zeros[1] > share * half else None
    if code is None or marked not in (None, code):
        return None
    text = data[2 if marked else 0:2 * half].decode(code, "replace")
    return None if any(c < " " and c not in "\t\n\r" for c in text) else text or None


def _inflate(data: bytes) -> Iterator[bytes]:
    """Content of gzip, zlib or raw deflate data, of all members, in pieces of bounded size.

    Data that breaks off or is damaged gives what comes before; raw deflate data has no mark, so
    there such a rest counts only if it is text.
    """
    for mode in (31, 15, -15):
        magic = {31: b"\x1f\x8b", 15: b"\x78", -15: b""}[mode]
        if not data.startswith(magic):
            continue
        first, member = True, _Member(data, mode)
        while True:
            for piece in member.pieces():
                if first and not (magic or member.ended or len(piece) == CHUNK or _printable(piece)):
                    break
                first = False
                yield piece
            if not (magic and member.ended and member.rest.startswith(magic)):
                break
            member = _Member(member.rest, mode)
        if not first:
            return


class _Member:
    """One compressed member: its pieces, whether it ended, and what follows it."""

    def __init__(self, data: bytes, mode: int) -> None:
        self.data, self.unpack = data, zlib.decompressobj(mode)
        self.ended, self.rest = False, b""

    def pieces(self) -> Iterator[bytes]:
        """Up to the member's end, the end of the data or the first damaged byte."""
        unpack, at = self.unpack, 0
        while at < len(self.data) and not unpack.eof:
            block, saved, given = self.data[at:at + BLOCK], unpack.copy(), 0
            left = block
            try:
                while left and not unpack.eof:
                    out = unpack.decompress(left, CHUNK)
                    left, given = unpack.unconsumed_tail, given + len(out)
                    self.ended = unpack.eof
                    if out:
                        yield out
            except zlib.error:  # its output is lost: read the block again, byte by byte
                yield from _before_damage(saved, block, given)
                return
            at += len(block)
        if self.ended:
            self.rest = unpack.unused_data + self.data[at:]


def _before_damage(unpack, block: bytes, given: int) -> Iterator[bytes]:
    """What the block gives beyond ``given`` bytes before its damaged byte."""
    out = bytearray()
    try:
        for i in range(len(block)):
            out += unpack.decompress(block[i:i + 1])
            if len(out) > given + CHUNK:
                yield bytes(out[given:])
                out, given = bytearray(), 0
    except zlib.error:
        pass
    if len(out) > given:
        yield bytes(out[given:])


def _chunks(pieces: Iterator[bytes]) -> Iterator[str]:
    """Text of the pieces in chunks that share ``OVERLAP`` letters and whole runs at their ends."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    text, fresh = "", False
    for piece in pieces:
        text, fresh = text + decoder.decode(piece), True
        if len(text) < CHUNK:
            continue
        end = len(text) - OVERLAP
        start = max(text.rfind(c, 0, end) for c in " \t\r\n") + 1
        if start < len(text) // 2:
            if len(text) < LONGEST:
                continue
            start += (end - start) // 4 * 4
        yield text
        text, fresh = text[start:], False
    last = decoder.decode(b"", True)
    if fresh or last:
        yield text + last


def _from_base64(part: str) -> Iterator[tuple[str, bool]]:
    """Decoded texts, and whether the part is certainly encoded text or data."""
    body = part.rstrip("=").translate({45: "+", 95: "/"})
    lossy = None
    # A run may have a letter too many when the text runs on; try its whole groups.
    for size in (len(body), len(body) - len(body) % 4):
        if size % 4 == 1:
            continue
        try:
            data = base64.b64decode(body[:size] + "=" * (-size % 4), validate=True)
        except binascii.Error:
            continue
        if (text := _printable(data)) is not None:
            yield text, True
            return
        headed, found = data[:2] == b"\x1f\x8b", False
        for text in _chunks(_inflate(data)):
            found = found or headed or _printable(text.encode()) is not None
            yield text, found
        if found:
            return
        lossy = lossy or data.decode("utf-8", "replace")
    if lossy:
        yield lossy, False


def _unescape(run: str) -> list[tuple[str, int]]:
    """Decoded text and source length of each piece of a run of Unicode escapes."""
    found = list(ONE_ESCAPE.finditer(run))
    pieces, i = [], 0
    while i < len(found):
        code, size = int(next(filter(None, found[i].groups())), 16), len(found[i][0])
        if 0xD800 <= code < 0xDC00 and i + 1 < len(found):
            low = int(found[i + 1][1] or "0", 16)
            if 0xDC00 <= low < 0xE000:
                code = 0x10000 + ((code - 0xD800) << 10) + low - 0xDC00
                i, size = i + 1, size + len(found[i + 1][0])
        letter = 0xD800 <= code < 0xE000 or code > 0x10FFFF
        pieces.append(("�" if letter else chr(code), size))
        i += 1
    return pieces


def _unquote(run: str) -> list[tuple[str, int]]:
    """As above for percent escapes; bytes of a letter beyond ASCII go with their whole run."""
    found = list(ONE_PERCENT.finditer(run))
    data = bytes(int(m[1], 16) for m in found)
    if data.isascii():
        return [(chr(b), len(m[0])) for b, m in zip(data, found)]
    return [(data.decode("utf-8", "replace"), len(run))]


class Layer:
    """A decoded text that knows which part of the text below each of its parts covers."""

    def __init__(self, text: str, below: Layer | None = None) -> None:
        self.text, self.below = text, below
        self.at: list[int] = []  # starts of the pieces in this text
        self.spans: list[tuple[int, int]] = []  # their spans below
        self.literal: list[bool] = []  # a piece copied from below, letter by letter

    def add(self, at: int, start: int, end: int, literal: bool) -> None:
        self.at.append(at)
        self.spans.append((start, end))
        self.literal.append(literal)

    def root_span(self, start: int, end: int) -> tuple[int, int]:
        layer = self
        while layer.below is not None:
            first, last = bisect_right(layer.at, start) - 1, bisect_right(layer.at, end - 1) - 1
            a, b = layer.spans[first][0], layer.spans[last][1]
            if layer.literal[first]:
                a += start - layer.at[first]
            if layer.literal[last]:
                b = layer.spans[last][0] + end - layer.at[last]
            start, end, layer = a, b, layer.below
        return start, end

    def ancestors(self) -> Iterator[str]:
        layer = self.below
        while layer is not None:
            yield layer.text
            layer = layer.below


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every run of escapes decoded, or None if it has none."""
    out, at, done = Layer("", layer), 0, 0
    parts: list[str] = []
    for m in pattern.finditer(layer.text):
        if m.start() > done:
            out.add(at, done, m.start(), True)
            parts.append(layer.text[done:m.start()])
            at += m.start() - done
        done = m.start()
        for piece, size in decode(m[0]):
            out.add(at, done, done + size, False)
            parts.append(piece)
            at, done = at + len(piece), done + size
    if not parts:
        return None
    if done < len(layer.text):
        out.add(at, done, len(layer.text), True)
        parts.append(layer.text[done:])
    out.text = "".join(parts)
    return out


def _wrapped(text: str, first: re.Match) -> list[int]:
    """Ends of the base64 lines of equal width that begin with this run.

    A shorter line may be the last of them or text of its own: then there are two ends.
    """
    width, ends = first.end() - first.start(), []
    end = first.end()
    while not text[end - 1] == "=" and (gap := LINE_END.match(text, end)) and (line := LINE.match(text, gap.end())):
        size = line.end() - line.start()
        if size > width:
            break
        end = line.end()
        ends = [end] if size == width else [end, *ends]
        if size < width:
            break
    return ends


def _blobs(layer: Layer) -> Iterator[Layer]:
    done = tried = 0
    for m in BASE64.finditer(layer.text):
        if m.start() < done:  # a line of a block that is decoded
            continue
        ends = _wrapped(layer.text, m) if m.start() >= tried else []
        tried = max([tried, *ends])  # a block that is none is tried from its first line only
        for end in ends:
            certain = False
            for text, sure in _from_base64(LINE_END.sub("", layer.text[m.start():end])):
                if certain := certain or sure:
                    yield _inside(layer, m.start(), end, text)
            if certain:
                done = end
                break
        if m.start() < done:
            continue
        if PLAIN_RUN.fullmatch(m[0]):
            continue
        certain = False
        for text, sure in _from_base64(m[0]):
            certain = certain or sure
            yield _inside(layer, m.start(), m.end(), text)
        if not certain:  # the signs + / _ - may separate: try the parts between them
            for p in BASE64_PART.finditer(layer.text, m.start(), m.end()):
                if len(p[0]) < len(m[0]) and not PLAIN_RUN.fullmatch(p[0]):
                    for text, _ in _from_base64(p[0]):
                        yield _inside(layer, p.start(), p.end(), text)


def _inside(layer: Layer, start: int, end: int, text: str) -> Layer:
    inner = Layer(text, layer)
    inner.add(0, start, end, False)
    return inner


def unwrap(layer: Layer) -> Iterator[Layer]:
    """The layers directly inside: URL and Unicode escapes, base64 and compressed data."""
    if "%" in layer.text and (inner := _replaced(layer, PERCENTS, _unquote)):
        yield inner
    if "\\" in layer.text and (inner := _replaced(layer, ESCAPES, _unescape)):
        yield inner
    yield from _blobs(layer)


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with those of the decoded layers mapped to the text."""
    base = scan(text)
    found = set(base)
    # Depth first, so that one chunk of each layer is held at a time.
    work, seen = [unwrap(Layer(text))], set()
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.text:
            continue
        place = layer.root_span(0, len(layer.text)), hashlib.sha256(layer.text.encode()).digest()
        if place in seen or layer.text in layer.ancestors():
            continue
        seen.add(place)
        for s in scan(layer.text):
            start, end = layer.root_span(s.start, s.end)
            found.add(Span(start, s.kind, end))
        work.append(unwrap(layer))
    return base, sorted(found)


SPAN = T.StructType([
    T.StructField("kind", T.StringType(), False),
    T.StructField("start", T.IntegerType(), False),
    T.StructField("end", T.IntegerType(), False),
])


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``base_spans`` and ``spans``, arrays of (kind, start, end) in code points.

    The text column is dropped. NULL and empty texts have no spans. Columns named like the
    new ones are replaced; repeated rows are scanned one by one.
    """
    rows = without(docs, ["base_spans", "spans"]).withColumn(text_col, text_of(text_col))
    kept = [c for c in rows.columns if c != text_col]
    schema = T.StructType([rows.schema[c] for c in kept] + [
        T.StructField(n, T.ArrayType(SPAN, False), False) for n in ("base_spans", "spans")
    ])
    span_type = pa.list_(pa.struct([
        pa.field("kind", pa.string(), False), pa.field("start", pa.int32(), False),
        pa.field("end", pa.int32(), False),
    ]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every = [], []
            for text in batch.column(text_col):
                for out, spans in zip((base, every), find(text.as_py())):
                    out.append([(KINDS[s.kind], s.start, s.end) for s in spans])
            columns = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in row] for row in out],
                                span_type) for out in (base, every)]
            yield pa.RecordBatch.from_arrays(
                [*batch.select(kept).columns, *columns], [*kept, "base_spans", "spans"]
            )

    return rows.mapInArrow(run, schema)
