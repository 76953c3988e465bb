"""Layers that are damaged, glued to text, in other encodings or packed in other ways."""

import base64
import bz2
import gzip
import random
import zlib

import pytest

from trackgrid.llm import secrets

SECRET = "password=Xk29Lmq01zzA and token: qwertyuiop"


def b64(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


def kinds(text):
    return {text[s:e] for s, e, k in secrets.find_secrets(text)[1] if k == "assign"}


def spans(text):
    return [(s, e) for s, e, k in secrets.find_secrets(text)[1] if k == "assign"]


def bare(data):
    pack = zlib.compressobj(9, zlib.DEFLATED, -15)
    return pack.compress(data) + pack.flush()


LONG = (SECRET + " " + " ".join(str(random.Random(1).random()) for _ in range(40))).encode()


@pytest.mark.parametrize("data", [
    zlib.compress(LONG)[:-9], gzip.compress(LONG)[:-20], gzip.compress(LONG)[:-6] + b"abcdef", zlib.compress(LONG)[:-4] + b"\0\0\0\0", bz2.compress(LONG), bare(LONG), bare(gzip.compress(LONG)), bz2.compress(bz2.compress(LONG)),
    "größe ".encode("latin-1") + SECRET.encode(), b"\xff\xfe" + SECRET.encode() + b"\x80", b"x^" + SECRET.encode()])
def test_layers_of_all_kinds(data):
    assert spans("see " + b64(data) + " end")


@pytest.mark.parametrize("head", ["/cfg_", "/a/b/c-", "https://host.net/x/", "key-", "_", "path/to/some_thing_"])
@pytest.mark.parametrize("data", [SECRET.encode(), zlib.compress(SECRET.encode())])
def test_base64_behind_other_text(head, data):
    text = "see " + head + b64(data) + " end"
    found = spans(text)
    assert any(s >= 4 + len(head) for s, _ in found) and all(4 <= s and e <= len(text) - 4 for s, e in found)


def test_bytes_that_are_no_text_hide_nothing():
    escaped = "".join(f"%{b:02X}" for b in b"\xff" + SECRET.encode() + b"\xc3")
    assert spans(escaped)
    assert spans("a%FF" + "".join(f"%{b:02X}" for b in SECRET.encode()))


def test_damage_in_the_middle_keeps_what_is_before():
    packed = bytearray(zlib.compress(LONG * 50, 1))
    whole = zlib.decompressobj().decompress(bytes(packed[:len(packed) // 2]))
    packed[len(packed) // 2:] = b"\xff" * (len(packed) - len(packed) // 2)
    got = secrets._inflate(bytes(packed))
    assert got.startswith(whole[:len(whole) - 300])


def test_long_runs_take_no_square_of_time():
    draw = random.Random(7)
    run = b64(draw.randbytes(3 << 20))
    secrets.find_secrets(run)
    secrets.find_secrets("/".join("abcDEF0123456789" for _ in range(20000)))


def naive(text, depth=0):
    """All secrets that any chain of decoding steps shows, as texts."""
    out = {m.group(0) for m in secrets.ASSIGN.finditer(text) if len(m.group(2)) >= 6}
    if depth == 4:
        return out
    from urllib.parse import unquote
    import re

    if "%" in text:
        out |= naive(unquote(text, errors="replace"), depth + 1)
    if "\\u" in text:
        out |= naive(re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), text), depth + 1)
    for m in re.finditer(r"[A-Za-z0-9+/]{16,}={0,2}", text):
        try:
            data = base64.b64decode(m[0] + "=" * (-len(m[0].rstrip("=")) % 4 - m[0].count("=")))
        except ValueError:
            continue
        for unpack in (lambda x: x, zlib.decompress, gzip.decompress, bz2.decompress):
            try:
                out |= naive(unpack(data).decode(), depth + 1)
            except Exception:
                continue
    return out


@pytest.mark.parametrize("seed", range(40))
def test_random_nests_against_a_naive_decoder(seed):
    draw = random.Random(seed)
    text = f"note {SECRET} done"
    for _ in range(draw.randrange(1, 4)):
        step = draw.choice(["url", "unicode", "base64", "zlib", "gzip", "bz2"])
        if step == "url":
            text = "".join(f"%{b:02X}" if draw.random() < 0.7 else chr(b) for b in text.encode())
        elif step == "unicode":
            text = "".join(f"\\u{ord(c):04x}" if draw.random() < 0.7 else c for c in text)
        else:
            data = text.encode()
            data = {"zlib": zlib.compress, "gzip": gzip.compress, "bz2": bz2.compress}.get(step, bytes)(data)
            text = "x " + b64(data) + " y"
    wanted = naive(text)
    count = len({(s, e) for s, e, k in secrets.find_secrets(text)[1] if k == "assign"})
    assert bool(count) == bool(wanted)
