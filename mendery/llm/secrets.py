"""Secret scans: base patterns on every whole text, then a worklist that unwraps encoded layers.

A layer is a text with, for each of its characters, the part of the document it came from. Layer 0 is the
document. Each layer is scanned for secrets and for encoded regions: runs with percent escapes, runs with
Unicode escapes, and base64 runs, on one line or wrapped over lines, whose bytes may be gzip or zlib streams
of any number of members. Bytes that are not UTF-8 throughout are not given up: every run of text in them is a
region, in UTF-8 or with two bytes a character, whatever binary data stands around it. Every region becomes a new layer, until no layer yields another (a fixpoint). What a
large stream holds is unpacked and scanned piece by piece. Layers already seen in the document are not taken again, which
ends cycles such as a text that decodes to itself. A secret found below layer 0 is reported at the part of
the document that it came from: exact characters through escapes, the covering characters through base64,
the whole run through a compressed stream.
"""

from __future__ import annotations

import base64
import binascii
import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendery.llm.common import map_rows, sha256, spans_text, table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run of hexadecimal digits is taken whole, so asking for 24 drops the same runs as a later test would.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
MIN_VALUE, MIN_ACCESS = 6, 20
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
LEAST = 16  # characters of a run
# The end of a line and whole lines after it, of one alphabet, so that "-----END" is no part of them.
WRAPPED = [
    re.compile(
        rf"(?<![{x}])[{x}]++(?:[ \t]*+(?:\r\n|\n|\r)[ \t]*+(?!-----)[{x}]++(?=[=\"',;<>)\]}}]|[ \t]*+(?:[\r\n]|\Z)))++"
        r"(?:(?:[ \t]*+(?:\r\n|\n|\r)[ \t]*+)?={1,2})?"
    )
    for x in ("A-Za-z0-9+/", "A-Za-z0-9_-")
]
_LINE = re.compile(r"[^\s]+")
ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})+")
_CODE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")

# The shortest secret is "token=" and six characters, so a shorter run of text in binary data holds none.
# No kind of secret holds a control character or one that is not ASCII.
RUN = re.compile(rb"[\t\n\r\x20-\x7e\x80-\xff]{12,}")
RUN_WIDE = re.compile(rb"(?:\x00[\t\n\r\x20-\x7e]){12,}|(?:[\t\n\r\x20-\x7e]\x00){12,}")
_VALID = re.compile("[^\ud800-\udfff]{12,}")

# A stream that unpacks to more than this becomes several layers, so that a small text cannot fill a worker's
# memory. Neighbouring pieces share OVERLAP characters: what is shorter stands whole in one of them.
MAX_UNPACKED = 16 << 20
PIECE, OVERLAP = 8 << 20, 1 << 20
CHUNK = 1 << 20
# Large streams inside one another, each counting as one level: a deeper one is refused and counted in
# n_refused. Only a stream made to unpack without end comes there.
MAX_LEVELS = 64

Span = tuple[int, int, str]


def scan(text: str) -> list[Span]:
    """Secrets of one layer: leftmost non-overlapping matches per kind, failing ones dropped."""
    low, found = text.lower(), []
    if any(h in low for h in _HINTS):
        found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


class Layer:
    """Decoded text. ``at[i]`` and ``to[i]`` bound the part of the document that character i came from; a
    layer out of a compressed stream comes from one part as a ``whole``."""

    __slots__ = ("text", "at", "to", "whole", "piece")

    def __init__(self, text: str, at=None, to=None, whole: tuple[int, int] | None = None, piece: bool = False):
        self.text, self.at, self.to, self.whole, self.piece = text, at, to, whole, piece

    def part(self, start: int, end: int) -> tuple[int, int]:
        return self.whole or (min(self.at[start:end]), max(self.to[start:end]))

    def cut(self, start: int, end: int) -> Layer:
        if self.whole:
            return Layer(self.text[start:end], whole=self.whole)
        return Layer(self.text[start:end], self.at[start:end], self.to[start:end])

    def join(self, parts: list[tuple[int, int]]) -> Layer:
        """Parts of the layer without what stands between them."""
        text = "".join(self.text[a:b] for a, b in parts)
        if self.whole:
            return Layer(text, whole=self.whole)
        return Layer(text, [x for a, b in parts for x in self.at[a:b]], [x for a, b in parts for x in self.to[a:b]])


def _readable(text: str) -> bool:
    odd = sum(not (c.isprintable() or c in "\n\r\t") for c in text)
    return bool(text) and odd * 20 <= len(text)


def _whole_text(raw: bytes) -> str | None:
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return text if _readable(text) else None


def _runs(raw: bytes) -> Iterator[tuple[str, int, int]]:
    """Runs of text in binary data, each with its first byte and the bytes of a character (0: as in UTF-8).

    Of text with two bytes a character, in either order, its ASCII characters are taken.
    """
    for m in RUN_WIDE.finditer(raw):
        yield m[0].replace(b"\0", b"").decode("ascii"), m.start(), 2
    for m in RUN.finditer(raw):
        text, done, at = m[0].decode("utf-8", "surrogateescape"), 0, m.start()
        for part in _VALID.finditer(text):
            at += len(text[done : part.start()].encode("utf-8", "surrogateescape"))
            yield part[0], at, 0
            done, at = part.end(), at + len(part[0].encode())


def _unescape(layer: Layer) -> Layer:
    """Replace percent and Unicode escapes; characters keep where they came from."""
    run, text, at, to = layer.text, [], [], []

    def put(c: str, start: int, end: int) -> None:
        text.append(c)
        if not layer.whole:
            part = layer.part(start, end)
            at.append(part[0])
            to.append(part[1])

    done = 0
    for m in ESCAPE.finditer(run):
        for i in range(done, m.start()):
            put(run[i], i, i + 1)
        if m[0][0] == "%":
            raw, k = bytes.fromhex(m[0].replace("%", "")), 0
            while k < len(raw):
                width = next((w for w in (1, 2, 3, 4) if _utf8(raw[k : k + w])), 0)
                c = raw[k : k + width].decode() if width else chr(raw[k])
                put(c, m.start() + 3 * k, m.start() + 3 * (k + max(width, 1)))
                k += max(width, 1)
        else:
            codes, k = [(int(x[1] or x[2], 16), x.start(), x.end()) for x in _CODE.finditer(m[0])], 0
            while k < len(codes):
                c, start, end = codes[k]
                if 0xD800 <= c < 0xDC00 and k + 1 < len(codes) and 0xDC00 <= codes[k + 1][0] < 0xE000:
                    c, end, k = 0x10000 + ((c - 0xD800) << 10) + codes[k + 1][0] - 0xDC00, codes[k + 1][2], k + 1
                put(chr(c) if not 0xD800 <= c < 0xE000 else "\ufffd", m.start() + start, m.start() + end)
                k += 1
        done = m.end()
    for i in range(done, len(run)):
        put(run[i], i, i + 1)
    return Layer("".join(text), at, to, layer.whole)


def _utf8(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


def _is_stream(raw: bytes) -> bool:
    return raw[:2] == b"\x1f\x8b" or (raw[:1] == b"\x78" and len(raw) > 1 and int.from_bytes(raw[:2], "big") % 31 == 0)


def _unpack(source: Iterator[bytes]) -> Iterator[bytes]:
    """Content of the gzip and zlib streams that stand one after the other, in chunks; nothing if there is
    none. Zeros between them are padding; the content ends where no stream follows."""
    data = next(source, b"")
    first = True
    while True:
        while len(data) < 2:
            more = next(source, b"")
            if not more:
                return
            data += more
            if not first:
                data = data.lstrip(b"\0")
        if not _is_stream(data):
            return
        engine = zlib.decompressobj(wbits=47)
        while not engine.eof:
            try:
                out = engine.decompress(data, CHUNK)
            except zlib.error:
                return
            if out:
                yield out
            data = engine.unconsumed_tail
            if not (data or out or engine.eof):
                data = next(source, b"")
                if not data:
                    return
        data, first = engine.unused_data.lstrip(b"\0"), False


def _large(source: Iterator[bytes], whole: tuple[int, int], refused: list) -> Iterator[Layer]:
    """Layers of a stream of any size, from the chunks of its content."""
    for _ in range(MAX_LEVELS):
        head = next(source, b"")
        source = chain([head], source)
        if not _is_stream(head) or next(_unpack(iter([head])), None) is None:
            break
        source = _unpack(source)
    else:
        refused.append(whole)
        return
    held, fresh = b"", 0
    for data in chain(source, [b""]):
        held, fresh = held + data, fresh + len(data)
        if fresh and (len(held) >= PIECE or not data):
            text = _whole_text(held)  # a character cut at an end is one byte or more that is no text
            for x in [text] if text else (x for x, _, _ in _runs(held)):
                yield Layer(x, whole=whole, piece=True)
            held, fresh = held[-OVERLAP:], 0


def _base64(run: str) -> bytes | None:
    body = run.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(
            body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True
        )
    except (binascii.Error, ValueError):
        return None


def unwrap(layer: Layer, refused: list, whole_only: bool = False) -> Iterator[Layer]:
    """The text inside a base64 run, if it has one: a layer, or several of a large stream or of binary data
    (but for ``whole_only``)."""
    raw = _base64(layer.text)
    if raw is None:
        return
    packed: set[bytes] = set()  # a stream that unpacks to itself ends here
    while raw not in packed and _is_stream(raw):
        chunks, inner = _unpack(iter([raw])), bytearray()
        for data in chunks:
            inner += data
            if len(inner) > MAX_UNPACKED:
                yield from _large(chain([bytes(inner)], chunks), layer.part(0, len(layer.text)), refused)
                return
        if not inner:
            break
        packed.add(raw)
        raw = bytes(inner)
    text = _whole_text(raw)
    whole = layer.part(0, len(layer.text)) if packed or layer.whole else None
    for text, first, unit in [(text, 0, 0)] if text else () if whole_only else _runs(raw):
        if whole:
            yield Layer(text, whole=whole)
            continue
        at, to, b, n = [], [], first, len(layer.text)
        for c in text:
            width = unit or len(c.encode())
            part = layer.part(b * 8 // 6, min(((b + width) * 8 - 1) // 6 + 1, n))
            at.append(part[0])
            to.append(part[1])
            b += width
        yield Layer(text, at, to)


def _blobs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Lines of base64 that may belong together: of one width, but for the first, which may follow other
    text, and the last, which may be shorter."""
    runs = {m.span(): m for x in WRAPPED for m in x.finditer(text)}
    for _, m in sorted(runs.items()):
        lines = [(m.start() + x.start(), m.start() + x.end()) for x in _LINE.finditer(m[0])]
        k = 0
        while k < len(lines) - 1:
            last, width = k + 1, lines[k + 1][1] - lines[k + 1][0]
            if width >= lines[k][1] - lines[k][0] or (lines[k][0] > 0 and text[lines[k][0] - 1] not in " \t\r\n"):
                while last + 1 < len(lines) and lines[last][1] - lines[last][0] == width >= lines[last + 1][1] - lines[last + 1][0]:
                    last += 1
            yield lines[k : last + 1]
            k = last


def _encoded(layer: Layer, refused: list) -> Iterator[Layer]:
    """One step of decoding: the layers inside a layer, one after the other."""
    text = layer.text
    if "%" in text or "\\" in text:
        done = 0
        for m in ESCAPE.finditer(text):
            if m.start() >= done:  # the line with escapes, as a whole
                start, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
                done = end if end >= 0 else len(text)
                yield _unescape(layer.cut(start, done))
    taken: list[tuple[int, int]] = []  # streams that are unpacked whole, so not line by line
    for lines in _blobs(text):
        # A word may stand on the line before or after, so the lines that make one whole text are looked for
        # first; where none do, text is taken out of the binary data that any of them make.
        parts = [p for p in (lines, lines[:-1], lines[1:], lines[1:-1]) if len(p) > 1 and sum(b - a for a, b in p) >= LEAST]
        found = False
        for whole_only in (True, False):
            for part in parts:
                for inner in unwrap(layer.join(part), refused, whole_only):
                    if (part[0][0], part[-1][1]) not in taken and (inner.piece or (inner.whole and not layer.whole)):
                        taken.append((part[0][0], part[-1][1]))
                    found = True
                    yield inner
                if found and whole_only:
                    break
            if found:
                break
    k = 0
    taken.sort()
    for m in BASE64.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k == len(taken) or m.start() < taken[k][0]:
            yield from unwrap(layer.cut(m.start(), m.end()), refused)


def find_secrets(text: str) -> tuple[list[Span], list[Span], int, int]:
    """Base spans, all spans, number of decoded layers, number of refused streams."""
    base = scan(text)
    found, refused = set(base), []
    seen = {_key(text, 0)}

    def settle(first: Layer) -> None:
        work = deque([first])
        while work:
            for new in _encoded(work.popleft(), refused):
                key = _key(new.text, new.part(0, 1)[0] if new.text else 0)
                if new.text and key not in seen:
                    seen.add(key)
                    found.update((*new.part(start, end), kind) for start, end, kind in scan(new.text))
                    if new.piece:  # at once, so that one piece of a large stream is held at a time
                        settle(new)
                    else:
                        work.append(new)

    settle(Layer(text, range(len(text)), range(1, len(text) + 1)))
    return base, sorted(found, key=_order), len(seen) - 1, len(refused)


def _key(text: str, start: int) -> tuple[str, int]:
    """A layer already seen; of a long text only its hash is held."""
    return (text if len(text) <= CHUNK else sha256(text.encode("utf-8", "surrogatepass"))), start


SCHEMA = (
    "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, "
    "n_spans bigint, n_layers bigint, n_refused bigint"
)


def digest(text: bytes | None) -> tuple:
    base, spans, layers, refused = find_secrets((text or b"").decode("utf-8", "replace"))
    counts = [sum(k == kind for *_, k in base) for kind in KINDS]
    return (*counts, sha256(spans_text(base)), spans_text(spans), len(spans), layers, refused)


def secret_spans(documents: DataFrame) -> DataFrame:
    """One row per document with the digest columns of its secrets.

    A null text counts as empty (no spans, checksum of the empty text). Every row is scanned by itself, so
    repeated rows give repeated results; an empty table gives none; other columns are not looked at. Texts
    are read whole whatever their length.
    """

    def make():
        return lambda ids, texts: [(i, *digest(t)) for i, t in zip(ids, texts, strict=True)]

    return map_rows(documents.select(F.col("doc_id").cast("bigint"), "text"), SCHEMA, make)


def op2_layered_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_spans(table(spark, folder, "documents"))
