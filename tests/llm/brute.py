"""Plain versions of the operators, one document at a time, to test the others against."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def quality_row(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {k for i, w in enumerate(windows) if w in often for k in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def leaks(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(docs, radius=3):
    prints = np.array([fingerprint(t) for _, t in docs], np.uint64)
    parent = list(range(len(docs)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k in range(len(docs)):
        for j in np.flatnonzero(np.bitwise_count(prints[k + 1 :] ^ prints[k]) <= radius):
            a, b = root(k), root(k + 1 + int(j))
            parent[a] = b
    least = {}
    for k, (doc, _) in enumerate(docs):
        r = root(k)
        least[r] = min(least.get(r, doc), doc)
    return [(doc, f"{int(prints[k]):016x}", least[root(k)]) for k, (doc, _) in enumerate(docs)]


ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    text = text or ""
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)).encode()).hexdigest()
    return *(sum(s[2] == k for s in spans) for k in ("assign", "access", "hex")), digest


def pieces(docs, encode, capacity=1024):
    out = []
    for doc, text in docs:
        ids = [*encode(text or ""), 2]
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.append((doc, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return out


def archived(pages):
    first = {}
    for page, html in pages:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, html in pages:
        data = (html or "").encode()
        again = page is not None and first[html or ""] != page
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "revisit" if again else "response", first[html or ""] if again else None))
    return out


def toxic_ratios(texts, words, order=5, shared=2, discount=0.75):
    """Log ratios of words of lower-case letters by Kneser-Ney models over (class, text)."""
    counts = {order: Counter()}
    for cls, text in texts:
        for w in text.split():
            marked = "\2" * (order - 1) + w + "\3"
            counts[order].update((cls, marked[k - order + 1 : k + 1]) for k in range(order - 1, len(marked)))
    for n in range(order - 1, 0, -1):
        longer = {(c, g) if n > shared else (0, g) for c, g in counts[n + 1]}
        counts[n] = Counter((c, g[1:]) for c, g in longer)
    totals, followers = {n: Counter() for n in counts}, {n: Counter() for n in counts}
    for n, by_gram in counts.items():
        for (c, g), k in by_gram.items():
            totals[n][c, g[:-1]] += k
            followers[n][c, g[:-1]] += 1

    def log_likelihood(cls, w):
        marked, out = "\2" * (order - 1) + w + "\3", 0.0
        for k in range(order - 1, len(marked)):
            p = (counts[1][0, marked[k]] + 0.5) / (sum(counts[1].values()) + 0.5 * 65536)
            for n in range(2, order + 1):
                g, c = marked[k - n + 1 : k + 1], cls if n > shared else 0
                t = totals[n][c, g[:-1]]
                rest = min(discount * followers[n][c, g[:-1]] / t, 1.0) if t else 1.0
                p = max(counts[n][c, g] - discount, 0.0) / max(t, 1) + rest * p
            out += math.log(p)
        return out

    return {w: log_likelihood(1, w) - log_likelihood(0, w) for w in words}
