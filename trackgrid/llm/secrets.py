"""Secret scan that unwraps encoded layers.

A text is a worklist of layers. Each layer is scanned, then its encoded parts (URL
escapes, Unicode escapes, base64, compressed data in base64) become new layers, until
nothing new decodes. A layer knows for each character the span of the original text it
came from, so a secret found inside is reported by its place in the original.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import itertools
import re
import zlib
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds of secrets in their order, pattern and least length.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
_LEAST = {"assign": 6, "access": 20}

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)")
#: Lines of base64, broken or not; only the last may be short.
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]{16,})*(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)?={0,2}")
_GLUE = re.compile(r"[/_+-]")
_CONTROL = re.compile(rb"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_TAIL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-= \t\r\n"

#: A compressed layer beyond this many bytes is scanned in parts of as many characters.
MAX_LAYER = 64 << 20
#: Compressed bytes that are unpacked at a time.
STEP = 4096
#: A part repeats at least so many characters of the part before.
OVERLAP = 1 << 20


def scan(text: str) -> list[tuple[str, int, int]]:
    """Secrets of one text as ``(kind, start, end)``, leftmost and not overlapping per kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= _LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= _LEAST["access"]]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


class Layer:
    """A decoded text whose characters map to spans of the original.

    ``pieces`` are ``(start in layer, start, end, per)``: from there on, every character stands for the next
    character of the original (``per`` 1), the next four for three (``per`` 4/3), or the whole span (``per`` 0).
    """

    def __init__(self, text: str, pieces: list[tuple[int, int, int, float]]):
        self.text, self.pieces = text, pieces
        self.starts = [p[0] for p in pieces]

    def origin(self, at: int) -> tuple[int, int]:
        first, start, end, per = self.pieces[bisect_right(self.starts, at) - 1]
        if per == 1:
            return start + at - first, start + at - first + 1
        if per:
            group = (at - first) // 3 * 4
            return start + group, min(end, start + group + 4)
        return start, end

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self.origin(start)[0], self.origin(end - 1)[1]


def _text(data: bytes) -> str | None:
    """Text of decoded bytes, if they are text."""
    try:
        return data.decode("utf-8") or None
    except UnicodeDecodeError:
        return None


def _mode(data: bytes) -> int | None:
    """How data that begins like zlib, gzip or bzip2 is unpacked: zlib's window argument, or 0 for bzip2."""
    if data[:2] == b"\x1f\x8b":
        return 31
    if data[:3] == b"BZh" and data[4:10] == b"1AY&SY":
        return 0
    return 15 if len(data) > 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0 else None


def _unpacker(mode: int):
    return zlib.decompressobj(mode) if mode else bz2.BZ2Decompressor()


def _stream(chunks, mode: int):
    """Content of compressed data, in chunks; of damaged data all that comes before the damage."""
    unpack = _unpacker(mode)
    for chunk in chunks:
        for k in range(0, len(chunk), STEP):
            piece = chunk[k:k + STEP]
            if unpack.eof:
                return
            before = unpack.copy() if mode else None
            try:
                out = unpack.decompress(piece)
            except (zlib.error, OSError):
                if before is not None:
                    yield _until_damage(before, piece)
                return
            if out:
                yield out


def _until_damage(unpack, piece: bytes) -> bytes:
    out = []
    try:
        for k in range(len(piece)):
            out.append(unpack.decompress(piece[k:k + 1]))
    except zlib.error:
        pass
    return b"".join(out)


def _inflate(data: bytes):
    """Content of compressed data: bytes, chunks of them if it is over the limit, or None if nothing unpacks."""
    mode = _mode(data)
    if mode is None:
        return None
    stream, held, size = _stream([data], mode), [], 0
    for out in stream:
        held.append(out)
        size += len(out)
        if size >= MAX_LAYER:
            return itertools.chain(held, stream)
    return b"".join(held) or None


def _bare(data: bytes) -> bytes | None:
    """Content of deflated data without a head: it has to end with the data and to be text or compressed in turn."""
    unpack = zlib.decompressobj(-15)
    try:
        out = unpack.decompress(data, MAX_LAYER)
    except zlib.error:
        return None
    return out if unpack.eof and not unpack.unused_data and out and (_text(out) or _mode(out) is not None) else None


def _used(data: bytes) -> int | None:
    """Bytes of compressed data up to its end; None if it does not end well."""
    unpack = _unpacker(_mode(data))
    try:
        for k in range(0, len(data), STEP):
            unpack.decompress(data[k:k + STEP])
            if unpack.eof:
                return min(k + STEP, len(data)) - len(unpack.unused_data)
    except (zlib.error, OSError):
        pass
    return None


def _unpacked(data: bytes):
    """Texts of compressed data, unwrapped until it is compressed no more, or None if it is not compressed.

    What unpacks is real data, so bytes that are not UTF-8 are replaced and the rest is read.
    """
    content = _inflate(data)
    if content is None:
        return None
    while isinstance(content, bytes):
        deeper = _inflate(content)
        if deeper is None:
            return [content.decode("utf-8", "replace")] if content else []
        content = deeper
    return _parts(content)


def _parts(chunks):
    """Texts of chunks of bytes, no longer than the limit by much; a run of base64 that a border cuts is whole in the next."""
    head = next(chunks, b"")
    chunks = itertools.chain([head], chunks)
    while (mode := _mode(head)) is not None:
        inner = next(_stream([head], mode), b"")
        if not inner:
            break
        head, chunks = inner, _stream(chunks, mode)
    decode = codecs.getincrementaldecoder("utf-8")("replace").decode
    held, size = [], 0
    for chunk in chunks:
        held.append(decode(chunk))
        size += len(held[-1])
        if size >= MAX_LAYER:
            part = "".join(held)
            yield part
            run = len(part) - len(part.rstrip(_TAIL))
            held = [part[-max(run, OVERLAP):]] if run < MAX_LAYER // 2 else [part[-OVERLAP:]]
            size = len(held[0])
    held.append(decode(b"", True))
    yield "".join(held)


def _escapes(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with all escapes of one kind replaced, or None if there are none."""
    text, out, pieces, at, size = layer.text, [], [], 0, 0
    for m in pattern.finditer(text):
        plain = decode(m[0])
        if plain is None:
            continue
        for part, start, whole in ((text[at:m.start()], at, False), (plain, m.start(), True)):
            if part:
                if whole:
                    pieces.append((size, *layer.span(m.start(), m.end()), 0))
                else:
                    pieces += _carried(layer, start, start + len(part), size)
                out.append(part)
                size += len(part)
        at = m.end()
    if not out:
        return None
    if at < len(text):
        pieces += _carried(layer, at, len(text), size)
        out.append(text[at:])
    return Layer("".join(out), pieces)


def _carried(layer: Layer, start: int, end: int, size: int) -> list[tuple[int, int, int, float]]:
    """Pieces for a stretch of a layer that is taken over unchanged."""
    out = []
    k = bisect_right(layer.starts, start) - 1
    while k < len(layer.pieces) and layer.pieces[k][0] < end:
        first, s, e, per = layer.pieces[k]
        low = max(first, start)
        if per == 1:
            out.append((size + low - start, s + low - first, e, 1))
        elif per:
            # Groups of three characters may be entered in the middle; one piece each keeps their spans.
            high = min(end, layer.pieces[k + 1][0] if k + 1 < len(layer.pieces) else end)
            out += [(size + at - start, *layer.origin(at), 0) for at in range(low, high)]
        else:
            out.append((size + low - start, s, e, 0))
        k += 1
    return out


def _percent(run: str) -> str:
    """Text of escaped bytes; bytes that are no UTF-8 are replaced, so that they hide nothing beside them."""
    return bytes.fromhex(run.replace("%", "")).decode("utf-8", "replace")


def _codepoint(escape: str) -> str | None:
    digits = escape.strip("\\&#;{}").lstrip("uxX").strip("{}")
    code = int(digits, 10 if escape[:2] == "&#" and escape[2] not in "xX" else 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _inner(layer: Layer):
    """Layers that decode out of one layer."""
    text = layer.text
    if "%" in text:
        yield _escapes(layer, _URL, _percent)
    if "\\" in text or "&#" in text:
        yield _escapes(layer, _UNICODE, _codepoint)
    for m in _BASE64.finditer(text):
        lines = [x.span() for x in _LINE.finditer(text, m.start(), m.end())]
        read, known = [False] * len(lines), [False] * len(lines)
        for first, last in _choices([e - s for s, e in lines]):
            if not all(read[first:last]):
                kind = yield from _decoded(layer, lines[first:last], m.end() if last == len(lines) else lines[last - 1][1])
                if kind:
                    known[first:last] = [True] * (last - first)
                if kind == "text":
                    read[first:last] = [True] * (last - first)
        # What neither is text nor unpacks may be in another encoding, or begin behind other text.
        first = 0
        for unknown, group in itertools.groupby(known, lambda x: not x):
            last = first + len(list(group))
            if unknown:
                yield from _decoded(layer, lines[first:last], m.end() if last == len(lines) else lines[last - 1][1], lenient=True)
                for s, e in lines[first:last]:
                    yield from _glued(layer, s, e)
            first = last


def _glued(layer: Layer, first: int, last: int):
    """Layers of base64 that stands behind other text in a run, after one of the signs that both may hold."""
    text = layer.text
    for m in _GLUE.finditer(text, first, last - 16):
        begin = m.end()
        head = text[begin:begin + 16]
        try:
            data = base64.b64decode(head, altchars=b"-_" if "-" in head or "_" in head else None, validate=True)
        except (binascii.Error, ValueError):
            continue
        # The first bytes tell whether it is worth to read on: text as far as it goes, or data that does unpack.
        if _mode(data) is not None:
            head = text[begin:min(begin + 1024, last)]
            data = base64.b64decode(head[:len(head) // 4 * 4], altchars=b"-_" if "-" in head or "_" in head else None)
            if sum(map(len, _stream([data], _mode(data)))) < 12 and _CONTROL.search(data):
                continue
        elif _CONTROL.search(data) or "\ufffd" in codecs.getincrementaldecoder("utf-8")("replace").decode(data):
            continue
        end = last - ((last - begin) % 4 == 1)
        yield from _decoded(layer, [(begin, end)], end, lenient=True)


def _choices(widths: list[int]) -> list[tuple[int, int]]:
    """Runs of lines that may be one base64 text: all, lines of one width with the lines beside them, and each alone; the longest first."""
    n = len(widths)
    out = {(i, i + 1) for i in range(n)} | {(0, n)}
    first = 0
    while first < n:
        last = first + 1
        while last < n and widths[last] == widths[first]:
            last += 1
        out |= {(low, high) for low in (max(first - 1, 0), first) for high in (last, min(last + 1, n))}
        first = last
    return sorted(out, key=lambda x: (x[0] - x[1], x))


def _decoded(layer: Layer, lines: list[tuple[int, int]], stop: int, lenient: bool = False):
    """Layers that lines of base64 decode to; ``stop`` is behind their padding. Returns whether they are ``text``, ``packed`` or neither (empty).

    If ``lenient``, bytes that are no UTF-8 are replaced and the rest is read.
    """
    body = "".join(layer.text[s:e] for s, e in lines)
    if len(body) < 16 or len(body) % 4 == 1 or not (re.search("[A-Z]", body) and re.search("[a-z]", body)):
        return ""
    try:
        data = base64.b64decode(body + "=" * (-len(body) % 4), altchars=b"-_" if "-" in body or "_" in body else None, validate=True)
    except (binascii.Error, ValueError):
        return ""
    begin = lines[0][0]
    start, end = layer.span(begin, stop)
    used = _used(data) if _mode(data) is not None else None
    # Data without an end may be a part of the lines it belongs to, so it is read once no other choice was.
    texts = _unpacked(data) if used is not None or lenient else None
    if texts is not None:
        if used is not None and len(lines) > 1:
            # Lines behind the end of the compressed data are not part of it.
            need, k = -(-used * 4 // 3), 0
            while k < len(lines) - 1 and need > lines[k][1] - lines[k][0]:
                need -= lines[k][1] - lines[k][0]
                k += 1
            end = layer.span(begin, stop if k == len(lines) - 1 else lines[k][1])[1]
        for plain in texts:
            if plain:
                yield Layer(plain, [(0, start, end, 0)])
        # Text may begin like compressed data by chance.
        if _text(data) is None:
            return "packed"
        start, end = layer.span(begin, stop)
    elif _text(data) is None and (content := _bare(data)) is not None:
        for plain in _unpacked(content) or [content.decode("utf-8", "replace")]:
            yield Layer(plain, [(0, start, end, 0)])
        return "packed"
    if _text(data) is None and not lenient:
        return ""
    plain = data.decode("utf-8", "replace")
    # Groups of four characters stay together where the layer is the original and bytes are characters.
    exact = len(plain) == len(data) and layer.origin(begin)[1] - start == 1 and end - start == stop - begin
    if not exact:
        yield Layer(plain, [(0, start, end, 0)])
    elif all((e - s) % 4 == 0 for s, e in lines[:-1]):
        pieces, at = [], 0
        for s, e in lines:
            if at < len(plain):
                pieces.append((at, start + s - begin, start + (e if e < lines[-1][1] else stop) - begin, 4 / 3))
            at += (e - s) // 4 * 3
        yield Layer(plain, pieces)
    else:
        where = [start + k - begin for s, e in lines for k in range(s, e)]
        yield Layer(plain, [(at, where[at // 3 * 4], where[min(at // 3 * 4 + 3, len(where) - 1)] + 1, 0) for at in range(0, len(plain), 3)])
    return "text" if _text(data) is not None else ""


def find_secrets(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """``(spans of the text itself, all spans)`` as sorted ``(start, end, kind)``.

    Layers are unwrapped until none is new. A layer that was seen with the same text at
    the same place is not scanned again, so cycles end.
    """
    text = text or ""
    base = [(s, e, k) for k, s, e in scan(text)]
    found = set(base)
    seen: set = set()
    # Depth first, so that only the layers around the current one are held.
    work = [_inner(Layer(text, [(0, 0, len(text), 1)]))] if text else []
    while work:
        for inner in work[-1]:
            if inner is None:
                continue
            key = (hashlib.blake2b(inner.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), inner.pieces[0][1], inner.pieces[-1][2])
            if key in seen:
                continue
            seen.add(key)
            found.update((*inner.span(s, e), k) for k, s, e in scan(inner.text))
            work.append(_inner(inner))
            break
        else:
            work.pop()
    def order(x):
        return x[0], KINDS.index(x[2]), x[1]
    return sorted(base, key=order), sorted(found, key=order)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redact(text: str | None, spans: list[tuple[int, int, str]], mark: str = "<secret>") -> str | None:
    """The text with every span replaced; overlapping spans become one mark."""
    if text is None or not spans:
        return text
    out, at, end = [], 0, -1
    for s, e, _ in sorted(spans):
        if s >= end:
            out += [text[at:s], mark]
            at = end = e
        else:
            end = at = max(end, e)
    return "".join([*out, text[at:]])


_SPANS = "array<struct<kind:string,start:long,end:long>>"


def scan_secrets(docs: DataFrame, *, text: str = "text", clean: bool = True, mark: str = "<secret>") -> DataFrame:
    """All columns plus ``secret_base``, ``secret_spans`` (base and decoded) and, if ``clean``, ``clean_text``.

    Spans are code points of the original text, end exclusive, ordered by start, kind
    and end. A secret inside a decoded layer has the span of the characters it came from; a
    span that is also found plainly is given once. ``clean_text`` has every span replaced.

    Layers are percent escapes, escapes of characters, base64 (alone, over lines or behind other text of its signs) and zlib, gzip,
    bzip2 or bare deflate inside it; damaged data is read up to the damage and bytes that are no UTF-8 are
    replaced. A compressed layer over ``MAX_LAYER`` bytes is read in parts that overlap; texts of any length
    are read whole.

    NULL text has no spans and stays NULL; empty text has none. Every row is judged on its
    own: repeated rows repeat, an empty table gives an empty result. Columns of the input
    with the new names are replaced.
    """
    names = ["secret_base", "secret_spans"] + ["clean_text"] * clean
    keep = [c for c in docs.columns if c not in names]

    @F.pandas_udf(f"secret_base {_SPANS}, secret_spans {_SPANS}" + ", clean_text string" * clean)
    def judged(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base, spans = find_secrets(t)
            as_rows = [[{"kind": k, "start": s, "end": e} for s, e, k in x] for x in (base, spans)]
            rows.append((*as_rows, redact(t, spans, mark))[:len(names)])
        return pd.DataFrame(rows, columns=names)

    return docs.select(*keep, judged(F.col(text)).alias("_found")).select(*keep, "_found.*")
