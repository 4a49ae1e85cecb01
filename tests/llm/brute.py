"""Plain versions of the operators, for small fixtures."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np

from gleaner.llm import kernel, quality as q

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def groups(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def repeats(rows, length):
    seen = defaultdict(list)
    data = [(d, (t or "").encode()) for d, t in rows]
    for i, (_, b) in enumerate(data):
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]].append((i, k))
    covered = [bytearray(len(b)) for _, b in data]
    for places in seen.values():
        if len(places) > 1:
            for i, k in places:
                covered[i][k : k + length] = b"\1" * length
    out = {}
    for (d, b), c in zip(data, covered, strict=True):
        kept = bytes(x for x, y in zip(b, c, strict=True) if not y)
        spans = sum(1 for k in range(len(c)) if c[k] and (k == 0 or not c[k - 1]))
        out[d] = (len(b), len(b) - len(kept), spans, kept)
    return out


def tiles(item, doc, least):
    """Covered words of ``item`` by greedy tiles, longest first."""
    mark_i, mark_d, covered, count = set(), set(), 0, 0
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in mark_i and j + n not in mark_d:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return covered, count
        n, i, j = best
        mark_i.update(range(i, i + n))
        mark_d.update(range(j, j + n))
        covered, count = covered + n, count + 1


def unigram_counts(rows, held):
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update([*words(t), None])
    return c


def _mix(*hashes):
    """The hash of a pair of words."""
    with np.errstate(over="ignore"):
        return int(kernel.mix(np.array([hashes[0]], np.uint64) * kernel._GRAM + np.array([hashes[1]], np.uint64))[0])


def quality(rows, labels, buckets=q.BUCKETS, pairs=q.PAIRS, smoothing=q.SMOOTHING, seed=q.SEED):
    """(weights, keys, labelled good ids) of the importance-resampling classifier; rows share no id."""
    by = defaultdict(list)
    for i, quality_, toxic in labels:
        if None not in (i, quality_, toxic):
            by[i].append(quality_ == 1 and toxic == 0)
    good = {i for i, v in by.items() if all(v)} & {i for i, _ in rows}

    def grams(text):
        w = WORD.findall(text or "")
        h = [kernel.word_hash(x, lower=False) for x in w]
        c = Counter(x % (buckets - 1) for x in h) + Counter(buckets + _mix(a, b) % pairs for a, b in zip(h, h[1:]))
        out = {k: 1 + int(math.log2(n)) for k, n in c.items()}
        same = [0, *(int(a == b) for a, b in zip(w, w[1:]))]
        again = sum(1 for k in range(len(w)) if same[k] and sum(same[max(0, k - 4) : k + 1]) >= 3)
        if again:
            out[buckets - 1] = again
        return out

    docs = {i: grams(t) for i, t in rows}
    raw, target = Counter(), Counter()
    for i, g in docs.items():
        raw.update(g)
        if i in good:
            target.update(g)
    kind = lambda k: int(k >= buckets)
    T, R = ([sum(n for k, n in c.items() if kind(k) == x) for x in (0, 1)] for c in (target, raw))
    scale = [T[x] / max(1, R[x]) for x in (0, 1)]
    center = [0.0, 0.0]
    for x in (0, 1):
        if scale[x]:
            each = sorted((math.log((target[k] + smoothing) / (raw[k] * scale[x] + smoothing)), target[k]) for k in raw if kind(k) == x)
            seen = 0
            for ratio, n in each:
                seen += n
                if seen >= T[x] / 2:
                    center[x] = ratio
                    break
    weights = {}
    for i, g in docs.items():
        total = 0.0
        for k, n in g.items():
            x = kind(k)
            if not scale[0] or not scale[x]:
                continue
            t, r = max(0, target[k] - n * (i in good)), max(0, (raw[k] - n) * scale[x])
            ratio = math.log((t + smoothing) / (r + smoothing)) - center[x]
            slack = q.DEAD[x] + q.MARGIN[x] * math.sqrt(max(0, 1 - scale[x]) / (r + smoothing))
            total += n * math.copysign(max(abs(ratio) - slack, 0), ratio)
        weights[i] = total
    return weights, {i: w + gumbel(i, seed) for i, w in weights.items()}, good


def gumbel(i, seed=q.SEED):
    mask = (1 << 64) - 1

    def mix(h):
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & mask
        return h ^ (h >> 31)

    const = int(q._ID)
    u = mix((mix(((-1 if i is None else i) * const + seed) & mask) + const) & mask) >> 11
    return -math.log(-math.log((u + 0.5) / 2.0**53))


def drop_lines(rows, depth=3, constant=0.7):
    """{id: remaining text}; a row without id or text stays as it is; no two rows share an id."""
    leaves = defaultdict(list)
    for i, t in rows:
        if i is not None and t is not None:
            for line in set(t.split("\n")):
                w = WORD.findall(line)
                if w:
                    leaves[len(w), tuple("<*>" if re.search("[0-9]", x) else x for x in w[:depth])].append((i, line, w))
    first = {}
    for found in leaves.values():
        at = defaultdict(set)
        for i, _, w in found:
            for k, x in enumerate(w):
                at[k, x].add(i)
        shapes = defaultdict(list)
        for i, line, w in found:
            kept = [len(at[k, x]) > 1 for k, x in enumerate(w)]
            if sum(kept) / len(w) >= constant:
                shapes[" ".join(x if y else "<*>" for x, y in zip(w, kept))].append((i, line))
        for lines in shapes.values():
            if len({i for i, _ in lines}) > 1:
                for _, line in lines:
                    first[line] = min(i for i, _ in lines)
    return {i: t if i is None or t is None else "\n".join(x for x in t.split("\n") if x not in first or i <= first[x]) for i, t in rows}
