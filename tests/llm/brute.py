"""Plain versions of the contracts, for small tables: one loop each, no Spark."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def top_k(vectors, k=10, scale=1024):
    """vectors: (id, list) rows; queries have ids divisible by 100."""
    good = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in sorted(good):
        if i % 100 == 0:
            queries.setdefault(i, v)
    out = []
    for q, v in queries.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def dedup(rows, length=100):
    """rows: (doc_id, text) in any order, ids unique and not null; doc_id -> (n_bytes, n_removed, n_spans, sha256)."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            if w in seen:
                gone[s:s + length] = b"\x01" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    w = {s: weights[n % len(weights)] for n, s in enumerate(names)}
    left, at_limit, out = share * sum(sizes.values()), set(), {}
    while True:
        free = [s for s in names if s not in at_limit]
        rest = left - sum(most * sizes[s] for s in at_limit)
        out = {s: most * sizes[s] if s in at_limit else rest * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if out[s] > most * sizes[s]}
        if not over:
            return out
        at_limit |= over


def fingerprint(text, n=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, seed=42)
        for bit in range(64):
            ones[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * ones[bit] > len(shingles))


def simhash(rows, n=3, d=3):
    """(doc_id, text) -> sorted (doc_id, hex, component)."""
    prints = [(i, fingerprint(t, n)) for i, t in rows]
    parent = {f: f for _, f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = np.array(sorted(parent), np.uint64)
    for i, f in enumerate(fps):
        for g in fps[i + 1:][np.bitwise_count(fps[i + 1:] ^ f) <= d]:
            a, b = find(int(f)), find(int(g))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return sorted(((i, f"{f:016x}", least.get(find(f))) for i, f in prints), key=str)


def quality_counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n, rep = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, rep, n < 50 or 100 * rep > 50 * n


def url(u, rules):
    u = u or ""
    host = path = ""
    if "://" in u:
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.split(r"[?#]", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, best


def tokens(rows, encode, end=1):
    """(doc_id, text) with unique ids -> doc_id: (start, n_tokens, crc)."""
    out, start = {}, 0
    for i, t in sorted(rows):
        ids = [*encode(t or ""), end]
        out[i] = start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    return out


def components(edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in sorted(near):
        if n in out:
            continue
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = n
                todo += near[x]
    return out


def best_segmentation(word, scores, unknown):
    """All ways to cut a word into pieces or single unknown characters: the highest sum."""
    best = None
    for k in range(len(word)):
        for cuts in combinations(range(1, len(word)), k):
            parts = [word[i:j] for i, j in zip([0, *cuts], [*cuts, len(word)])]
            if all(p in scores or (len(p) == 1) for p in parts):
                total = sum(scores.get(p, unknown) for p in parts)
                best = total if best is None else max(best, total)
    return best
