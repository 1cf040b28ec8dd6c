"""Secret scan with a worklist that unwraps encoded layers.

Every text is scanned as it stands. Then each layer is searched for encodings. Percent escapes,
backslash escapes and character references turn the whole layer into new layers: one with each
of these kinds unwrapped once, and one with all of them unwrapped until none is left, however
deep they are nested, in one pass. Each base64 run, joined across line ends, gives others: one for
each of its four alignments that leads on, as other signs of its alphabet may stand before it, as
UTF-8 and, where it holds zero bytes, as UTF-16; and one for each place where gzip or zlib data
begins. Bytes that aren't UTF-8 are replaced, not a reason to leave a run closed. New layers are
scanned and unwrapped in turn until none is new; a layer already seen isn't entered again, unless
it stands for another part of the original: the same run at two places is found at both. Each
layer knows, for each of its code points, the part of the original text it stands for, so every
find maps back to it.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenara.llm.common import add_columns, table

KINDS = ("assign", "access", "hex")
#: Bytes that one compressed run may unpack to at once; a larger one is scanned in overlapping parts of this size and counted in `oversize`.
UNPACK_BYTES = 16 << 20
#: Bytes that parts overlap by at least; a coded run that goes on beyond a part begins the next one, up to half a part.
OVERLAP = 1 << 16
_STEP = 1 << 16
#: Letters of a base64 run at least: fewer hold eleven bytes at most, and no find is shorter than sixteen signs.
SHORTEST_RUN = 16

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\})+")
_REFERENCE = re.compile(r"(?:&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:amp|lt|gt|quot|apos);)+")
#: The named references that every HTML and XML text knows.
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_BASE64 = re.compile(rf"[A-Za-z0-9+/_-]{{{SHORTEST_RUN},}}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)*={{0,2}}")
#: How gzip and zlib data begin in base64.
_PACKED = re.compile(r"H4sI|eA[E-H]|eF[4-7]|eJ[w-z]|eN[o-r]")
_TEXTUAL = re.compile(rf"{_PERCENT.pattern}|{_ESCAPE.pattern}|{_REFERENCE.pattern}")
_CODED = re.compile(rf"{_TEXTUAL.pattern}|{_BASE64.pattern}")
_ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=%\\\r\n"


def finds(text: str) -> list[tuple[int, int, int]]:
    """(start, end, place in KINDS) of the secrets that stand openly in a text."""
    out = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out)


class Layer:
    """A text and, for each of its code points, the start and end of what it stands for in the original; `plain` if escapes in it are left to others."""

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray, plain: bool = False) -> None:
        self.text, self.start, self.end, self.plain = text, start, end, plain

    def original(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a:b].min()), int(self.end[a:b].max())

    def replaced(self, runs) -> Layer | None:
        """This layer with the runs (start, end, new text, start and end of each new code point in this layer)."""
        texts, starts, ends, at = [], [], [], 0
        for a, b, new, low, high in runs:
            texts += [self.text[at:a], new]
            starts += [self.start[at:a], self.start[low]]
            ends += [self.end[at:a], self.end[high - 1]]
            at = b
        if not texts:
            return None
        return Layer("".join([*texts, self.text[at:]]), np.concatenate([*starts, self.start[at:]]), np.concatenate([*ends, self.end[at:]]), plain=True)


def _decoded_utf8(data: bytes) -> tuple[str, np.ndarray]:
    """What is valid UTF-8 as text, each other byte as U+FFFD, and the number of bytes of each code point."""
    try:
        text = data.decode()
        if len(text) == len(data):
            return text, np.ones(len(text), np.int64)
    except UnicodeDecodeError:
        text = data.decode("utf-8", "surrogateescape")
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    odd = (code >= 0xDC80) & (code <= 0xDCFF)
    size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    if odd.any():
        text = np.where(odd, np.uint32(0xFFFD), code).astype("<u4").tobytes().decode("utf-32-le")
    return text, np.where(odd, 1, size).astype(np.int64)


def _characters(data: bytes, unit: int, base: int) -> tuple[str, np.ndarray, np.ndarray]:
    """UTF-8 bytes that stand `unit` code points apart, as text with the span of each code point."""
    text, size = _decoded_utf8(data)
    ends = np.cumsum(size)
    return text, base + (ends - size) * unit, base + ends * unit


def _percent(layer: Layer) -> Layer | None:
    runs = []
    for m in _PERCENT.finditer(layer.text):
        runs.append((m.start(), m.end(), *_characters(bytes.fromhex(m[0].replace("%", "")), 3, m.start())))
    return layer.replaced(runs)


def _sign(code: int) -> str:
    return chr(code) if code < 0xD800 or 0xE000 <= code < 0x110000 else "\ufffd"


def _one_by_one(layer: Layer, run: re.Pattern, one: re.Pattern, value) -> Layer | None:
    """The layer with each run of escapes unwrapped; `value` gives the code of a match of one escape."""
    runs = []
    for m in run.finditer(layer.text):
        codes, low, high, at = [], [], [], m.start()
        for u in one.finditer(m[0]):
            code = value(u)
            if codes and 0xDC00 <= code < 0xE000 and 0xD800 <= codes[-1] < 0xDC00:
                codes[-1] = 0x10000 + ((codes[-1] - 0xD800) << 10) + code - 0xDC00
                high[-1] = at + u.end()
                continue
            codes.append(code)
            low.append(at + u.start())
            high.append(at + u.end())
        runs.append((m.start(), m.end(), "".join(map(_sign, codes)), np.array(low), np.array(high)))
    return layer.replaced(runs)


_ONE_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\[uxU]([0-9A-Fa-f]+)")
_BACKSLASHED = re.compile(r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}")
_ONE_REFERENCE = re.compile(r"&(?:#([0-9]+)|#[xX]([0-9A-Fa-f]+)|([a-z]+));")


def _escapes(layer: Layer) -> Layer | None:
    def value(u: re.Match) -> int:
        m = _ONE_ESCAPE.fullmatch(u[0])
        return int(m[1] or m[2], 16)

    return _one_by_one(layer, _ESCAPE, _BACKSLASHED, value)


def _reference(m: re.Match) -> int:
    return int(m[1]) if m[1] else int(m[2], 16) if m[2] else ord(_NAMED.get(m[3], "\ufffd"))


def _references(layer: Layer) -> Layer | None:
    return _one_by_one(layer, _REFERENCE, _ONE_REFERENCE, _reference)


_HEX_DIGITS = frozenset(b"0123456789abcdefABCDEF")


def _hex(held: bytearray, digits: int) -> int | None:
    """The value of the last digits held, if they are hexadecimal."""
    part = held[len(held) - digits :]
    return int(part, 16) if len(part) == digits and _HEX_DIGITS.issuperset(part) else None


def _closed(held: bytearray) -> tuple[int, int, bool] | None:
    """(length, value, whether it is a byte) of the escape that the bytes held end with, if they do."""
    last = held[-1]
    if last in _HEX_DIGITS:
        for mark, digits in ((b"%", 2), (b"\\x", 2), (b"\\u", 4), (b"\\U", 8)):
            length = len(mark) + digits
            if held[-length : -digits or None] == mark and len(held) >= length and (value := _hex(held, digits)) is not None:
                return length, value, mark == b"%"
    elif last == 125:
        at = held.rfind(b"\\u{", max(0, len(held) - 10))
        if at >= 0 and (m := _ONE_ESCAPE.fullmatch(held[at:].decode("latin-1"))):
            return len(held) - at, int(m[1], 16), False
    elif last == 59:
        at = held.rfind(b"&", max(0, len(held) - 10))
        if at >= 0 and _REFERENCE.fullmatch(said := held[at:].decode("latin-1")):
            return len(held) - at, _reference(_ONE_REFERENCE.fullmatch(said)), False
    return None


def _settled(layer: Layer) -> Layer:
    """The layer with all textual escapes unwrapped until none is left, in one pass.

    Bytes are held on a stack; an escape that its last byte closes gives way to what it stands
    for, which may close or open another. What an escape gives is never longer than the escape,
    so the pass is linear however deep escapes are nested.
    """
    held, low, high = bytearray(), array("q"), array("q")
    for i, sign in enumerate(layer.text):
        for byte in sign.encode("utf-8", "replace"):
            held.append(byte)
            low.append(i)
            high.append(i + 1)
        while held[-1] in _CLOSERS and (found := _closed(held)):
            length, value, is_byte = found
            start = low[-length]
            del held[-length:], low[-length:], high[-length:]
            if not is_byte and 0xDC00 <= value < 0xE000 and 0xD800 <= (first := _high(held)) < 0xDC00:
                start = low[-3]
                del held[-3:], low[-3:], high[-3:]
                value = 0x10000 + ((first - 0xD800) << 10) + value - 0xDC00
            new = bytes([value]) if is_byte else chr(min(value, 0x10FFFF)).encode("utf-8", "surrogatepass")
            held += new
            low.extend([start] * len(new))
            high.extend([i + 1] * len(new))
    text, size = _decoded_utf8(bytes(held))
    ends = np.cumsum(size)
    firsts, lasts = np.array(low, np.int64)[ends - size], np.array(high, np.int64)[ends - 1]
    return Layer(text, layer.start[firsts], layer.end[lasts - 1], plain=True)


_CLOSERS = _HEX_DIGITS | {59, 125}


def _high(held: bytearray) -> int:
    """The code point that the last three bytes held are, or 0."""
    try:
        return ord(bytes(held[-3:]).decode("utf-8", "surrogatepass"))
    except (UnicodeDecodeError, TypeError):
        return 0


def _packed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 2 and (data[0] << 8 | data[1]) % 31 == 0


def _inflated(parts):
    """Parts of what gzip or zlib data unpacks to, all its members; what comes before an error counts."""
    engine = zlib.decompressobj(47)
    head = b""
    for part in parts:
        part, head, more = head + part, b"", False
        while part or more:
            if engine.eof:
                part = part.lstrip(b"\0")
                if 0 < len(part) < 3:
                    head = part
                    break
                if not _packed(part):
                    return
                engine = zlib.decompressobj(47)
            try:
                out = engine.decompress(part, _STEP)
                part = engine.unused_data if engine.eof else engine.unconsumed_tail
            except zlib.error:
                return
            more = len(out) == _STEP and not engine.eof  # output may wait when all input is read
            if out:
                yield out


def _unpacked(data: bytes):
    """Parts of what compressed data holds, through all its layers of compression; a layer that unpacks to itself ends there."""
    parts, heads, first = iter([data]), set(), data
    while _packed(first) and first[:_STEP] not in heads:
        heads.add(first[:_STEP])
        parts = _inflated(chain([first], parts))
        first = next(parts, b"")
    return chain([first], parts)


def _pieces(parts, limit: int):
    """The parts put together to pieces of `limit` bytes at most that overlap."""
    held = bytearray()
    for part in parts:
        held += part
        while len(held) > limit:
            piece = bytes(held[:limit])
            yield piece
            back = max(min(OVERLAP, limit // 2), min(limit // 2, limit - len(piece.rstrip(_ALPHABET))))
            del held[: limit - back]
    yield bytes(held)


def _texts(data: bytes):
    """(text, first and last byte of each code point): as UTF-8, and as UTF-16 at both places a unit may begin if there are zero bytes."""
    yield _characters(data, 1, 0)
    if b"\0" in data:
        for phase in (0, 1):
            part = data[phase:] + b"\0" * ((len(data) - phase) % 2)
            text = "".join(map(_sign, np.frombuffer(part, "<u2").tolist()))
            at = phase + 2 * np.arange(len(text), dtype=np.int64)
            yield text, at, np.minimum(at + 2, len(data))


def _leads_on(text: str) -> bool:
    return bool(text) and bool(finds(text) or _CODED.search(text))


def _base64(layer: Layer, limit: int):
    """Layers of the layer's base64 runs; True for a run that is large when unpacked, before its parts."""
    for m in _BASE64.finditer(layer.text):
        signs = np.frombuffer(m[0].rstrip("=").encode(), np.uint8)
        where = np.flatnonzero((signs != 10) & (signs != 13) & (signs != 32) & (signs != 9))
        body = signs[where].tobytes().translate(bytes.maketrans(b"-_", b"+/"))
        where += m.start()
        for p in _PACKED.finditer(body.decode()):
            a, b = layer.original(int(where[p.start()]), m.end())
            for k, piece in enumerate(_pieces(_unpacked(_decoded(body[p.start() :])), limit)):
                if k == 1:
                    yield True
                for text, _, _ in _texts(piece):
                    if _leads_on(text):
                        yield Layer(text, np.broadcast_to(a, len(text)), np.broadcast_to(b, len(text)))
        for off in range(4):
            for text, low, high in _texts(_decoded(body[off:])):
                if _leads_on(text):
                    at = where[off:]
                    first, last = low // 3 * 4 + low % 3, np.minimum((high - 1) // 3 * 4 + (high - 1) % 3 + 1, len(at) - 1)
                    yield Layer(text, layer.start[at[first]], layer.end[at[last]])


def _decoded(body: bytes) -> bytes:
    """The bytes of a run of the base64 alphabet; a last sign that is no byte is left out."""
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + b"=" * (-len(body) % 4))


def scan(text: str, limit: int = UNPACK_BYTES) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int]:
    """Open finds; all finds with those of unwrapped layers; the number of layers; runs that unpack to more than `limit` bytes."""
    base = finds(text)
    if not _CODED.search(text):
        return base, base, 1, 0
    whole = np.arange(len(text))
    work, seen, found, closed = [iter([Layer(text, whole, whole + 1)])], set(), set(base), 0
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
        elif layer is True:
            closed += 1
        elif layer.text:
            # cycles repeat both, and texts of one original have finitely many spans
            key = (xxhash.xxh3_128_digest(layer.text.encode("utf-8", "replace")), *layer.original(0, len(layer.text)))
            if key not in seen:
                seen.add(key)
                if len(seen) > 1:
                    found |= {(*layer.original(a, b), kind) for a, b, kind in finds(layer.text)}
                work.append(_inside(layer, limit))
    return base, sorted(found), len(seen), closed


def _inside(layer: Layer, limit: int):
    """What a layer's encodings hold, one after the other."""
    if not layer.plain and _TEXTUAL.search(layer.text):
        once = [x for x in (_percent(layer), _escapes(layer), _references(layer)) if x]
        yield from once
        if len(once) > 1 or _TEXTUAL.search(once[0].text):
            yield _settled(layer)
    yield from _base64(layer, limit)


_SPAN = "array<struct<kind:string,start:int,end:int>>"


def find_secrets(docs: DataFrame, text: str = "text", limit: int = UNPACK_BYTES) -> DataFrame:
    """`docs` plus `base` and `spans` (kind, start, end in code points), `layers` and `oversize`.

    `base` has what stands openly, `spans` that and what unwrapped layers hold. Null and empty
    texts have neither; repeated rows are scanned each for itself; a text's finds at one place
    are listed once a kind. A compressed run that unpacks to more than `limit` bytes is scanned in
    overlapping parts and counted in `oversize`. Time and memory follow the length of a text, not how
    deep escapes in it are nested. Existing columns of these names are replaced.
    """

    def make():
        def work(texts):
            out: tuple[list, list, list, list] = ([], [], [], [])
            for t in texts:
                got = scan(t, limit) if t else ([], [], 0, 0)
                for column, x in zip(out, got, strict=True):
                    column.append([{"kind": KINDS[k], "start": a, "end": b} for a, b, k in x] if isinstance(x, list) else x)
            return out

        return work

    return add_columns(docs, [text], f"base {_SPAN}, spans {_SPAN}, layers int, oversize int", make)


def listed(spans: str):
    """Spans as kind:start:end by start, then kind in the order of KINDS, comma-joined."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of `documents`; see the README's contract table."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), "layers", "oversize")
