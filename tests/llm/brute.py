"""Plain re-statements of the operators, for small data."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def find_roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def base_signals(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    n = len(words)
    return (
        n,
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(inside),
        n < 50 or 100 * len(inside) > 50 * n,
    )


def fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(docs, distance=2):
    """doc_id -> (fingerprint, component) by comparing all pairs."""
    prints = {i: fingerprint(t) for i, t in docs.items()}
    ids = sorted(prints)
    fps = np.array([prints[i] for i in ids], np.uint64)
    pairs = []
    for k, fp in enumerate(fps):
        near = np.flatnonzero(np.bitwise_count(fps[k + 1 :] ^ fp) <= distance)
        pairs += [(ids[k], ids[k + 1 + j]) for j in near]
    roots = find_roots(ids, pairs)
    return {i: (f"{prints[i]:016x}", roots[i]) for i in ids}


def phrases(sample, text):
    """Cross-parsing phrases of ``text`` against ``sample`` by substring search."""
    count = at = 0
    while at < len(text):
        size = 1
        while at + size <= len(text) and text[at : at + size] in sample:
            size += 1
        at += max(1, size - 1)
        count += 1
    return count


def targets(sizes, weights, cap=3):
    """Water-filling targets by repeated resharing."""
    got = {s: 0.0 for s in sizes}
    fixed = {s for s in sizes if not sizes[s]}
    while True:
        left = sum(sizes.values()) - sum(got[s] for s in fixed)
        total = sum(weights[s] for s in sizes if s not in fixed)
        for s in sizes:
            if s not in fixed:
                got[s] = left * weights[s] / total
        over = {s for s in sizes if s not in fixed and got[s] > cap * sizes[s]}
        if not over:
            return got
        for s in over:
            got[s] = float(cap * sizes[s])
        fixed |= over


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def by(rows, key):
    found = defaultdict(list)
    for row in rows:
        found[row[key]].append(row)
    return found
