"""Plain versions of the text operators, written from their contracts; for small tables only."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def lower(text):
    return (text or "").translate(_LOWER)


def url_rule(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut].translate(_LOWER), rest[cut:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    best = None
    for action, rule in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (action, rule)
    return host, path, best


def contamination(docs, items, window=13):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k:k + n])].add(i)
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, found = ALNUM.findall(lower(t)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k:k + n])):
                    found |= own
                    hit.update(range(k, k + n))
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def base_quality(text):
    w = WORD.findall(text or "")
    lines = Counter(x for x in (text or "").split("\n") if WORD.search(x))
    at = defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k:k + 8])].append(k)
    covered = {j for ks in at.values() if len(ks) > 1 for k in ks for j in range(k, k + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(n - 1 for n in lines.values()), len(covered), failed


def base_secrets(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def shingles(text, size=3):
    w = WORD.findall(lower(text))
    return {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def near_groups(docs, limit=85):
    """(doc, set size, least doc reachable) by comparing every pair."""
    sets = [(d, shingles(t)) for d, t in docs]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, sa) in enumerate(sets):
        for b, sb in sets[:k]:
            if sa and sb and 100 * min(len(sa), len(sb)) >= limit * max(len(sa), len(sb)):
                both = len(sa & sb)
                if 100 * both >= limit * (len(sa) + len(sb) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return [(d, len(s), find(d)) for d, s in sets]


def repeats(docs, size=200):
    """(doc, bytes, removed, runs, digest of the rest) by counting every string of ``size`` bytes."""
    seen = Counter()
    data = [(d, (t or "").encode()) for d, t in docs]
    for _, b in data:
        seen.update(b[k:k + size] for k in range(len(b) - size + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if seen[b[k:k + size]] > 1:
                gone[k:k + size] = b"\1" * size
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(left)))
    return out
