"""The contracts again, one document at a time, without Spark and without the operators' helpers."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def shingles(text, width=5):
    w = WORD.findall(low(text or ""))
    if len(w) < width:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def fingerprints(rows):
    out = []
    texts = [t or "" for _, t in rows]
    for i, (doc, _) in enumerate(rows):
        t, following = texts[i], texts[(i + 1) % len(rows)]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        out.append((doc, len(t), sha(edited), jaccard(shingles(t), shingles(edited)), jaccard(shingles(t), shingles(following))))
    return out


def lines(rows, least_docs=5, least_chars=40):
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    where = defaultdict(set)
    for doc, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                where[key(line)].add(doc)
    hot = {k: max(d) for k, d in where.items() if len(d) >= least_docs}
    out = {}
    for doc, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if hot.get(key(x), doc) == doc]
        out[doc] = (len(every), len(every) - len(kept), "\n".join(kept))
    return out


def substrings(rows, length=400):
    texts = [(doc, (t or "").encode()) for doc, t in rows]
    seen = Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    out = {}
    for doc, b in texts:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[doc] = (len(b), sum(gone), spans, sha(kept))
    return out


def longest_repeats(symbols):
    """For each position the longest substring from it that starts elsewhere too."""
    n, out = len(symbols), []
    for i in range(n):
        best = 0
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and symbols[i + k] == symbols[j + k]:
                    k += 1
                best = max(best, k)
        out.append(best)
    return out


def quality(text, long_repeat=20, covered=0.10, longest=50, fraction=0.04):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
    longs = longest_repeats(w)
    under = {j for i, k in enumerate(longs) if k >= long_repeat for j in range(i, i + k)}
    good = not failed and len(under) <= covered * len(w) and max(longs, default=0) <= max(longest, fraction * len(w))
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(repeated), failed, good


def quality_by_windows(text, long_repeat=20, covered=0.10, longest=50, fraction=0.04):
    """The same from counted windows alone: for texts of any length."""
    w = WORD.findall(text or "")

    def under(k):
        count = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        return {j for i in range(len(w) - k + 1) if count[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}

    five, lines = under(5), [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(five) > 20 * len(w)
    good = not failed and len(under(long_repeat)) <= covered * len(w) and not under(int(max(longest, fraction * len(w))) + 1)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(five), failed, good


def scores(rows, discounts, order=3):
    held = lambda doc: doc is not None and zlib.crc32(str(doc).encode()) % 5 == 1
    texts = [(doc, held(doc), [*WORD.findall(low(t or "")), None]) for doc, t in rows]
    grams = [Counter() for _ in range(order)]  # by length less one: history and word
    for _, h, w in texts:
        if not h:
            for k in range(order):
                padded = [0] * k + w
                grams[k].update((tuple(padded[i : i + k]), x) for i, x in enumerate(w))
    one = Counter({w: c for (_, w), c in grams[0].items()})
    total, distinct = sum(one.values()), len(one)
    factors = [discounts([0, *(sum(v == r for v in c.values()) for r in range(1, 7))]) for c in grams]
    less = lambda d, c: (d[c] if c <= 5 else 1.0) * c
    word = {w: less(factors[0], c) / total for w, c in one.items()}
    unknown = 1 - sum(word.values()) if total else 1.0
    after = [defaultdict(dict) for _ in range(order)]
    for k in range(1, order):
        for (h, w), c in grams[k].items():
            after[k][h][w] = c
    kept_weights = {}

    def history(h):
        if h not in kept_weights:
            own, all_ = after[len(h)][h], sum(after[len(h)][h].values())
            kept = sum(less(factors[len(h)], c) for c in own.values())
            all_ += kept >= all_ * (1 - 1e-12)
            kept_weights[h] = all_, (1 - kept / all_) / (1 - sum(chance(h[1:], x) for x in own))
        return kept_weights[h]

    def chance(h, w):
        if not h:
            return word.get(w, unknown)
        if h not in after[len(h)]:
            return chance(h[1:], w)
        all_, weight = history(h)
        own = after[len(h)][h]
        return less(factors[len(h)], own[w]) / all_ if w in own else weight * chance(h[1:], w)

    out = {}
    for doc, h, w in texts:
        base = sum(math.log10((one[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
        padded = [0] * (order - 1) + w
        score = sum(math.log10(chance(tuple(padded[i : i + order - 1]), x)) for i, x in enumerate(w))
        out[doc] = (h, len(w), sum(one[x] > 0 for x in w), total, base, score)
    return out, word, unknown, after, chance


def components(rows):
    sets = [(doc, shingles(t)) for doc, t in rows]
    parent = {doc: doc for doc, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(i)
    for i, (doc, s) in enumerate(sets):
        common = Counter(j for x in s for j in where[x] if j > i)
        for j, k in common.items():
            if 100 * k >= 80 * (len(s) + len(sets[j][1]) - k):
                a, b = sorted((root(doc), root(sets[j][0])))
                parent[b] = a
    return {doc: (len(s), root(doc)) for doc, s in sets}


def targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2.0):
    """Step by step: shares by weight, cut at the caps, the excess shared again."""
    order = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        whole = sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * left / whole >= epochs * sizes[s]}
        if not full:
            return out | {s: weight[s] * left / whole for s in free}
        for s in full:
            out[s] = epochs * sizes[s]
            left -= out[s]
        free -= full
    return out
