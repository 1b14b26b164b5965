"""Plain versions of the operators for small inputs, straight from their definitions."""

from __future__ import annotations

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def substring_dedup(docs: dict[int, str | None], length: int = 50) -> set[tuple]:
    words = {d: WORD.findall(t or "") for d, t in docs.items()}
    least: dict[tuple, int] = {}
    for d, w in words.items():
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            least[k] = min(least.get(k, d), d)
    out = set()
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - length + 1):
            if least[tuple(w[i : i + length])] < d:
                gone |= set(range(i, i + length))
        out.add((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode())))
    return out


def byte_dedup(rows: list[tuple[int, str | None]], length: int = 200) -> list[tuple]:
    texts = [(t or "").encode() for _, t in rows]
    count: dict[bytes, int] = {}
    for b in texts:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    out = []
    for (d, _), b in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def fingerprint(text: str | None, shingle: int = 4) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + shingle]).encode(), 42) for i in range(max(1, len(w) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def simhash(docs: list[tuple[int, str | None]]) -> set[tuple]:
    prints = [(d, fingerprint(t)) for d, t in docs]
    up = {d: d for d, _ in prints}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (d, f) in enumerate(prints):
        for e, g in prints[:i]:
            if (f ^ g).bit_count() <= 4:
                a, b = sorted((top(d), top(e)))
                up[b] = a
    return {(d, f"{f:016x}", top(d)) for d, f in prints}


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def secrets(text: str | None) -> tuple:
    t = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(t) if len(m[0]) >= 24]
    n = [sum(1 for f in found if f[1] == k) for k in range(3)]
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))
    return (*n, sha(joined.encode()), joined)


def contained(docs: list[tuple], items: list[tuple], t: float = 0.8, size: int = 5) -> set[tuple]:
    def grams(text):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
        return {" ".join(w[i : i + size]) for i in range(len(w) - size + 1)}

    out = set()
    asked = [(i, grams(x)) for i, x in items]
    for d, text in docs:
        own = grams(text)
        for i, g in asked:
            if g and len(g & own) >= t * len(g) - 1e-9:
                out.add((d, i, len(g), len(g & own), len(g & own) / len(g)))
    return out


def rules(text: str | None) -> tuple:
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows: dict[tuple, list[int]] = {}
    for i in range(len(w) - 4):
        windows.setdefault(tuple(w[i : i + 5]), []).append(i)
    repeat = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(5)}
    failed = len(w) < 10 or 100 * len(repeat) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeat), failed)


def alignment(rows: list[tuple[int, str | None]], a, b, a_bytes, b_bytes) -> list[tuple]:
    """Operator 12 from its definition: ``a`` and ``b`` give ids of a text, ``a_bytes`` and ``b_bytes`` the bytes of an id."""
    told, held = [], {}
    for d, text in rows:
        ta, tb = (a(" " + text), b(text)) if text else ([], [])
        if not text or any(b"".join(map(f, t)) != (" " + text).encode() for f, t in ((a_bytes, ta), (b_bytes, tb))):
            told.append((d, [], [], [], ""))
            continue
        spans = []
        for f, t in ((a_bytes, ta), (b_bytes, tb)):
            at, own = 0, []
            for i in t:
                own.append((at, at + len(f(i)), i))
                at += len(f(i))
            spans.append(own)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        for p in set(links):
            held[p] = held.get(p, 0) + 1
        cuts = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in own if low <= s and e <= c) for own in spans))
            low = c
        told.append((d, ta, tb, links, ";".join(groups)))
    best_a, best_b = {}, {}
    for (i, j), n in held.items():
        best_a[i], best_b[j] = max(best_a.get(i, 0), n), max(best_b.get(j, 0), n)
    return [
        (d, len(ta), len(tb), g.count(";") + 1 if g else 0, len(links), sum(held[p] == best_a[p[0]] for p in links), sum(held[p] for p in links), sha(g.encode()) if g else "", sum(held[p] == best_b[p[1]] for p in links))
        for d, ta, tb, links, g in told
    ]
