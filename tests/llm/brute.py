"""Plain Python forms of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lower_ascii(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def shingles(text: str | None, n: int) -> set:
    w = words(lower_ascii(text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def components(docs: list[tuple[int, str | None]], n: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest id in its component)."""
    sets = [(i, shingles(t, n)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            by[g].append(k)
    shared = Counter()
    for ks in by.values():
        for a in range(len(ks)):
            for b in range(a):
                shared[ks[b], ks[a]] += 1
    for (a, b), both in shared.items():
        if 100 * both >= percent * (len(sets[a][1]) + len(sets[b][1]) - both):
            x, y = find(sets[a][0]), find(sets[b][0])
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def exact(docs: list[tuple[int, str | None]]) -> dict[int, tuple]:
    groups = defaultdict(list)
    for i, t in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    out = {}
    for bare, rows in groups.items():
        keep = min(rows)[1]
        for _, i in rows:
            out[i] = (keep, len(rows), i == keep, sha(bare))
    return out


def substring(docs: list[tuple[int, str | None]], size: int = 20) -> dict[int, tuple]:
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            window = tuple(w[k : k + size])
            if window in seen:
                gone[k : k + size] = [True] * size
            seen.add(window)
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def suffixes(docs: list[tuple[int, str | None]], size: int = 200) -> dict[int, tuple]:
    count = Counter()
    raw = [(i, (t or "").encode()) for i, t in docs]
    for _, b in raw:
        count.update(b[k : k + size] for k in range(len(b) - size + 1))
    out = {}
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if count[b[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def rule_figures(text: str | None) -> tuple:
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = set()
    for k in range(len(w) - 2):
        if windows[tuple(w[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


def shard_rows(docs: list[tuple[int, str | None]], n: int) -> dict[int, tuple]:
    """Distinct ids only: doc_id -> (size, crc, shard, slot)."""
    sizes = {i: len((t or "").encode()) + 8 for i, t in docs}
    total, before, out, slots = sum(sizes.values()), 0, {}, Counter()
    for i, t in sorted(docs, key=lambda d: d[0]):
        shard = min(n - 1, (2 * before + sizes[i]) * n // (2 * total))
        out[i] = (sizes[i], zlib.crc32((t or "").encode()), shard, slots[shard])
        slots[shard] += 1
        before += sizes[i]
    return out


def kneser_ney(texts: list[str], order: int) -> tuple:
    """(probability of a symbol after a context) of an interpolated modified Kneser-Ney model
    over code points, 1 / 1024 below the unigrams; counts as dictionaries."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        padded = (0,) * (order - 1) + tuple(map(ord, t))
        counts[order].update(padded[i : i + order] for i in range(len(t)))
    for n in range(order - 1, 0, -1):
        counts[n].update(g[1:] for g in counts[n + 1])
    cut = {}
    for n in range(1, order + 1):
        c = [sum(v == k for v in counts[n].values()) for k in range(5)]
        y = c[1] / max(c[1] + 2 * c[2], 1)
        cut[n] = [0] + [min(k - 0.1, max(0.1, k - (k + 1) * y * c[k + 1] / max(c[k], 1))) for k in (1, 2, 3)]
    follow = [defaultdict(list) for _ in range(order + 1)]
    for n in range(1, order + 1):
        for g, v in counts[n].items():
            follow[n][g[:-1]].append(v)

    def p(gram: tuple) -> float:
        out = 1 / 1024
        for n in range(1, order + 1):
            g = gram[order - n :]
            seen = follow[n][g[:-1]]
            if seen:
                v = counts[n][g]
                out = (v - cut[n][min(v, 3)]) / sum(seen) + sum(cut[n][min(x, 3)] for x in seen) / sum(seen) * out
        return out

    return p, counts[order]
