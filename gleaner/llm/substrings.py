"""Removal of repeated strings of ``length`` bytes or more, wherever they start.

1. Anchors.  In each window of ``length`` bytes the ``gram``-byte run with the
   smallest hash is the window's anchor: windows alike choose alike.  Windows
   in a row with one anchor value make a cell (cut at an occurrence of the
   anchor after ``piece`` windows, so a periodic text is many cells), and windows
   alike are in cells of the same anchor.  Anchors and cells are counted by
   anchor value and content (128 bits of BLAKE2), combined in each task.
2. What may hold a repeat is dealt to buckets: of cells that recur whole, two
   places (neighbouring cells with the same two documents at the same distance
   go as one stretch); of anchors with several distinct cells, one place of
   each.
3. The strings of a bucket are concatenated, less what no repeat can touch
   (runs of ``gram`` bytes met at one place only).  The suffixes are sorted to
   the needed depth, and the Burrows-Wheeler transform is searched by threshold-
   bounded interval expansion: intervals are extended backwards, breadth
   first, so that common prefixes come by increasing length; where ``length``
   steps have not parted two suffixes, they share ``length`` bytes.  Only what
   the expansion finds is removed: spans of the strings themselves and, for a
   cell that recurs whole, the spans of its other places as well.
4. An anchor with more than ``most`` distinct cells (the border of a passage that
   very many documents share) is cut finer before it is dealt: into cells of 16
   windows, then of one, by the place of the anchor in the window and by the
   bytes that all windows at those places have in common.  Windows alike still
   meet, and one window has one content, so no bucket grows with the corpus.
5. The spans of a document are joined and cut from its bytes.

Passages.  With ``words`` the same steps run once more over the texts' words
(``[^\\x20\\x09-\\x0D]+``, case as it is, as 64-bit hashes) in place of their bytes, and
the words that a run of ``words`` words met at two places covers are counted.  Such
a run may be shorter than ``length`` bytes, so nothing is removed for it.

Offsets are bytes of the UTF-8 text.  Strings are judged on the input and never
cross documents; a document may match itself, overlapping.

Defined results: null counts as the empty text; texts shorter than ``length``
keep everything.  Each row is a document of its own, whatever its doc_id:
repeated rows are repeats of each other, and rows that share a doc_id (or have
none) but not the text have their own spans (rows go by doc_id and a 64-bit hash
of the text).  An empty table gives an empty one.  Other columns are not read,
so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bits, kernel
from .workspace import Workspace

LENGTH, GRAM, MOST, BUCKET = 400, 64, 512, 1 << 20
#: Windows of a cell before a periodic text is cut, windows of the finer cells, and bytes of a stretch.
PIECE, FINER, STRETCH = 4096, (16, 1), 1 << 15
#: The same of passages of over fifty words, counted in words; the cells of an anchor are some 80 words each.
WORDS, WORDS_GRAM, WORDS_MOST, WORDS_BUCKET, WORDS_PIECE, WORDS_STRETCH = 51, 8, 4096, 1 << 18, 512, 1 << 12
#: Bytes of text at a time when anchors are sought: what is made of them stays in the cache.
TEXTS = 1 << 18
_FOUND = "g long, d long, e long, id long, h long, lo long, hi long, own boolean"


def _symbols(c: kernel.Chunk, kind: type) -> kernel.Chunk:
    """A chunk's bytes (np.uint8) or the hashes of its words (np.uint64)."""
    if kind is np.uint8:
        return c
    w = kernel.words(c, lower=False)
    return kernel.Chunk(c.first, c.last, w.hash, w.bounds)


def _sums(data: np.ndarray, base: np.uint64) -> np.ndarray:
    """Sums of bytes or word hashes, each times its power of base."""
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum((kernel._BYTE[data] if data.dtype == np.uint8 else data) * kernel.powers(base, len(data)), out=out[1:])
    return out


def _range_hash(sums: np.ndarray, inverse: np.uint64, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return kernel.mix((sums[hi] - sums[lo]) * kernel.powers(inverse, len(sums))[lo])


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each run of ``gram`` bytes, as :func:`_range_hash` has it."""
    sums = _sums(data, kernel._BASE)
    with np.errstate(over="ignore"):
        return kernel.mix((sums[gram:] - sums[:-gram]) * kernel.powers(kernel._BASE_INV, len(sums) - gram))


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best of x[i : i + width] for each i at which that fits."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = best(x[:-step], x[step:])
        have += step
    return x


def _digests(raw: bytes, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """128 bits of each slice as two longs."""
    hashed, view = hashlib.blake2b, memoryview(raw)
    return np.frombuffer(b"".join([hashed(view[a:b], digest_size=16).digest() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]), np.int64).reshape(-1, 2)


def anchors(c: kernel.Chunk, length: int, gram: int, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """(document, anchor, digest, start and end, whether it holds the anchor twice) of a chunk's cells; symbols count from the document's start."""
    n = len(c.data)
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    if n < length:
        return none
    h = _grams(c.data, gram)
    low = _slide(h, length - gram + 1, np.minimum)[: n - length + 1]
    end = np.repeat(c.bounds[1:], np.diff(c.bounds))[: n - length + 1]
    s = np.flatnonzero(np.arange(n - length + 1) + length <= end)
    if not len(s):
        return none
    fresh = np.ones(len(s), dtype=bool)
    fresh[1:] = (s[1:] != s[:-1] + 1) | (low[s[1:]] != low[s[:-1]])
    first = np.flatnonzero(fresh)
    start, stop = s[first], s[np.append(first[1:], len(s)) - 1]
    cuts = []
    for k in np.flatnonzero(stop - start >= piece):
        places = start[k] + np.flatnonzero(h[start[k] : stop[k] + 1] == low[start[k]])
        x = start[k]
        while (y := np.searchsorted(places, x + piece)) < len(places):
            x = places[y]
            cuts.append(x)
    start = np.sort(np.concatenate([start, np.array(cuts, np.int64)]))
    lo, hi = start, np.append(start[1:] - 1, stop[-1])
    # A cell ends where the next begins, or where its windows end.
    hi = np.minimum(hi, stop[np.searchsorted(stop, lo)]) + length
    doc = np.searchsorted(c.bounds, lo, side="right") - 1
    d = _digests(c.data.tobytes(), lo * c.data.itemsize, hi * c.data.itemsize)
    # A cell that holds its anchor twice may repeat itself.
    runs = low[lo]
    some = np.flatnonzero(h <= runs.max())
    values, number = np.unique(runs, return_inverse=True)
    of = np.minimum(np.searchsorted(values, h[some]), len(values) - 1)
    hit = values[of] == h[some]
    key = np.sort(of[hit] * n + some[hit])
    own = np.searchsorted(key, number * n + hi - gram, "right") - np.searchsorted(key, number * n + lo, "left") > 1
    return doc, runs.view(np.int64), d, lo - c.bounds[doc], hi - c.bounds[doc], own


def _anchors(length: int, gram: int, piece: int, kind: type):
    """(id, h, text) to _FOUND."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hs = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for c in kernel.chunks(batch.column(2), TEXTS):
                doc, g, d, lo, hi, own = anchors(_symbols(c, kind), length, gram, piece)
                row = c.first + doc
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g, d[:, 0], d[:, 1], ids[row], hs[row], lo, hi, own)], ["g", "d", "e", "id", "h", "lo", "hi", "own"])

    return run


def finer(segment: bytes, length: int, gram: int, width: int, kind: type = np.uint8) -> list[tuple]:
    """(g, d, e, start, end, own) of the cells of at most ``width`` windows that a cell is cut into.

    A window's place is that of its leftmost anchor in it, counted in steps of
    ``width``; with it, the symbols that all windows at such a place share name the cell.
    """
    data = np.frombuffer(segment, kind)
    unit = data.itemsize
    h = _grams(data, gram)
    places = np.flatnonzero(h == h.min())
    s = np.arange(len(data) - length + 1)
    p = places[np.searchsorted(places, s)]
    step = (p - s) // width
    first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (step[1:] != step[:-1])]))
    last = np.append(first[1:], len(s)) - 1
    core = p[first] - step[first] * width
    out = []
    for a, b, x, j in zip(first.tolist(), last.tolist(), core.tolist(), step[first].tolist(), strict=True):
        # The windows at this place begin at x - width + 1 up to x; all hold what lies between.
        g = hashlib.blake2b(segment[x * unit : (x - width + 1 + length) * unit], digest_size=8, salt=j.to_bytes(8, "little"), person=width.to_bytes(8, "little")).digest()
        d = np.frombuffer(hashlib.blake2b(segment[a * unit : (b + length) * unit], digest_size=16).digest(), np.int64)
        own = int(np.searchsorted(places, b + length - gram, "right") - np.searchsorted(places, a)) > 1
        out.append((int.from_bytes(g, "little", signed=True), int(d[0]), int(d[1]), a, b + length, own))
    return out


def _finer(length: int, gram: int, width: int, kind: type):
    """(k, id, h, lo, segment) to _FOUND."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, i, h, lo, segment in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                rows += [(g, d, e, i, h, lo + a, lo + b, own) for g, d, e, a, b, own in finer(segment, length, gram, width, kind)]
                if len(rows) > 50_000:
                    yield _rows(rows)
                    rows = []
            yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.int64()] * 7, pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(8)], ["g", "d", "e", "id", "h", "lo", "hi", "own"])


def _segments(kind: type):
    """(id, h, text, rows, [(k, lo, hi)]) to (k, id, h, lo, segment); of a row that is there twice, two of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = np.dtype(kind).itemsize
        for batch in batches:
            ids, hs, rows = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
            wanted = batch.column(4)
            ends = np.concatenate([[0], np.cumsum(wanted.value_lengths().to_numpy(zero_copy_only=False))])
            flat = wanted.flatten()
            k, lo, hi = (flat.field(name).to_numpy(zero_copy_only=False) for name in ("k", "lo", "hi"))
            for i, text in enumerate(batch.column(2)):
                data = text.as_buffer().to_pybytes()
                if kind is not np.uint8:
                    data = _symbols(kernel.Chunk(0, 1, np.frombuffer(data, np.uint8), np.array([0, len(data)])), kind).data.tobytes()
                for s in range(ends[i], ends[i + 1], 4096):
                    part = np.arange(s, min(s + 4096, ends[i + 1]))
                    cut = [data[a * unit : b * unit] for a, b in zip(lo[part].tolist(), hi[part].tolist(), strict=True)]
                    one = pa.RecordBatch.from_arrays([pa.array(k[part]), pa.array(np.full(len(part), ids[i])), pa.array(np.full(len(part), hs[i])), pa.array(lo[part]), pa.array(cut, pa.binary())], ["k", "id", "h", "lo", "segment"])
                    for _ in range(min(2, int(rows[i]))):
                        yield one

    return run


def _ordered(key: np.ndarray, pos: np.ndarray, width: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``key`` (of ``width`` bits) and ``pos`` (of ``bits``) in the order of key; of keys alike, in the order they had or in that of pos."""
    if width + bits > 63:
        order = np.argsort(key, kind="stable")
        return key[order], pos[order]
    both = np.sort(key << bits | pos)
    return both >> bits, both & ((1 << bits) - 1)


def suffixes(text: np.ndarray, stop: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of ``text`` to ``depth`` symbols or more.

    ``text`` holds symbols (bytes or numbers of words) plus one and 0 at the ends of the strings; ``stop`` is the
    distance of each position to the next end.  Ends differ from each other, in
    order of position.
    """
    n = len(text)
    bits = n.bit_length()
    # The symbols that there are, numbered in order: more of them fit into a key.
    there = np.bincount(text, minlength=257) > 0
    there[0] = True
    number = np.cumsum(there) - 1
    wide = max(1, int(number[-1]).bit_length())
    h = max(1, (63 - bits) // wide)
    slot = np.arange(n)
    key = np.zeros(n, dtype=np.int64)
    symbols = np.concatenate([number[text], np.zeros(h, np.int64)])
    for k in range(h):
        key <<= wide
        key |= symbols[k : k + n]
    # What lies behind an end does not count.
    tail = np.flatnonzero(stop < h)
    low = wide * (h - 1 - stop[tail])
    key[tail] = key[tail] >> low << low
    key, sa = _ordered(key, slot, wide * h, bits)
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (stop[sa[1:]] < h)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(fresh, slot, 0))
    open_ = slot[~(fresh & np.concatenate([fresh[1:], [True]]))]
    mixed = np.zeros(n, dtype=bool)
    while h < depth and len(open_):
        pos = sa[open_]
        group, key = rank[pos], rank[pos + h]
        # Groups whose positions all go on alike stay as they are.
        split = group[1:][(group[1:] == group[:-1]) & (key[1:] != key[:-1])]
        mixed[split] = True
        some = np.flatnonzero(mixed[group])
        mixed[split] = False
        h *= 2
        if not len(some):
            continue
        to = open_[some]
        key, pos = _ordered(group[some] << bits | key[some], pos[some], 2 * bits, bits)
        sa[to] = pos
        fresh = np.ones(len(to), dtype=bool)
        # Positions whose end lies within the new depth differ by their ends.
        fresh[1:] = (key[1:] != key[:-1]) | (stop[pos[1:]] < h)
        rank[pos] = np.maximum.accumulate(np.where(fresh, to, 0))
        left = np.ones(len(open_), dtype=bool)
        left[some] = ~(fresh & np.concatenate([fresh[1:], [True]]))
        open_ = open_[left]
    return sa


def expand(text: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """``apart[i]``: whether the suffixes at i - 1 and i of the suffix array share fewer than ``length`` symbols.

    Breadth-first backward extension of intervals on the Burrows-Wheeler
    transform: step l finds the places where exactly l symbols are shared.
    """
    n = len(text)
    before = text[sa - 1]
    before = before.astype(np.uint16) if text.dtype == np.int16 else before
    turn = np.argsort(before, kind="stable")
    # Ends are symbols of their own, below the others, in order of position.
    ends = turn[: np.count_nonzero(before == 0)]
    ends[:] = ends[np.argsort((sa[ends] - 1) % n)]
    back = np.empty(n, np.int64)
    back[turn] = np.arange(n)
    column = before[turn]
    other = np.ones(n, dtype=bool)
    other[1:] = (column[1:] != column[:-1]) | (column[1:] == 0)
    apart = np.zeros(n + 1, dtype=bool)
    apart[[0, n]] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        size = hi - lo
        total = int(size.sum())
        if not total:
            break
        source = np.repeat(np.arange(len(lo)), size)
        to = back[np.arange(total) + np.repeat(lo - (np.cumsum(size) - size), size)]
        if total > n >> 4:
            at = np.zeros(n, np.int64)
            at[to] = source + 1
            to = np.flatnonzero(at)
            source = at[to]
        else:
            order = np.argsort(to)
            to, source = to[order], source[order]
        first = other[to]
        first[0] = True
        first[1:] |= (source[1:] != source[:-1]) | (to[1:] != to[:-1] + 1)
        start = np.flatnonzero(first)
        lo = to[start]
        hi = lo + np.diff(np.append(start, total))
        new = ~apart[hi]
        lo, hi = lo[new], hi[new]
        apart[hi] = True
    return apart[:n]


def repeated(segments: list[np.ndarray], owner: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, end) of the spans that windows met at two places or more cover.

    Segment i is from document ``owner[i]``, symbol ``at[i]`` on; the same place of
    a document in two segments is one place.
    """
    sizes = np.array([len(s) for s in segments])
    n = int(sizes.sum()) + len(sizes)
    last = np.cumsum(sizes + 1) - 1
    text = np.zeros(n, dtype=np.int16 if segments[0].dtype == np.uint8 else np.int32)
    inside = np.ones(n, dtype=bool)
    inside[last] = False
    text[inside] = np.concatenate(segments).astype(text.dtype) + 1
    which = np.repeat(np.arange(len(sizes)), sizes + 1)
    stop = last[which] - np.arange(n)
    sa = suffixes(text, stop, length)
    apart = expand(text, sa, length)
    run = np.flatnonzero(apart)
    offset = np.arange(n) - (last - sizes)[which]
    place = (owner[which] << np.int64(36)) | (at[which] + offset)
    sorted_place = place[sa]
    differ = np.minimum.reduceat(sorted_place, run) != np.maximum.reduceat(sorted_place, run)
    hit = np.sort(sa[np.repeat(differ, np.diff(np.append(run, n)))])
    if not len(hit):
        return hit, hit, hit
    first = np.ones(len(hit), dtype=bool)
    first[1:] = (which[hit[1:]] != which[hit[:-1]]) | (hit[1:] > hit[:-1] + length)
    start = np.flatnonzero(first)
    final = np.append(start[1:], len(hit)) - 1
    return which[hit[start]], offset[hit[start]], offset[hit[final]] + length


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's group, its number within the group), rows alike in all keys being a group."""
    order = np.lexsort(keys[::-1])
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    number, nth = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    nth[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    return number, nth


def cuts(c: kernel.Chunk, owner: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, end) of what is left of segments without the runs of ``gram`` bytes met at one place only.

    A string of ``length`` bytes met twice has no such run.
    """
    per = np.maximum(np.diff(c.bounds) - gram + 1, 0)
    which = np.repeat(np.arange(c.n), per)
    start = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    place = c.bounds[which] + start
    h = _range_hash(_sums(c.data, kernel._BASE), kernel._BASE_INV, place, place + gram)
    # The upper bits that go with a number into one word; where they are alike by chance, more is left.
    bits = len(h).bit_length()
    key, order = _ordered((h >> np.uint64(bits + 1)).view(np.int64), np.arange(len(h)), 63 - bits, bits)
    group = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    doc = ((owner[which] << np.int64(36)) | (at[which] + start))[order]
    differ = np.minimum.reduceat(doc, group) != np.maximum.reduceat(doc, group)
    again = np.zeros(len(h) + 2, dtype=np.int8)
    again[1:-1][order[np.repeat(differ, np.diff(np.append(group, len(order))))]] = 1
    # Runs of recurring places, cut where a segment ends.
    edge = np.diff(again)
    opens, closes = edge[:-1] == 1, edge[1:] == -1
    border = np.cumsum(per)[per > 0]
    inner = border[border < len(h)]
    both = again[1:-1][inner - 1] & again[1:-1][inner]
    opens[inner[both > 0]] = True
    closes[inner[both > 0] - 1] = True
    a, b = np.flatnonzero(opens), np.flatnonzero(closes)
    keep = b - a + gram >= length
    a, b = a[keep], b[keep]
    return which[a], start[a], start[b] + gram


def _search(length: int, gram: int, kind: type):
    """Segments (k, id, h, lo, segment) and questions (k, id, h, lo, hi, g, d, e) of a bucket to what is repeated: (id, h, lo, hi, null, null, null) and, of each question whose whole cell is, (null, null, null, null, g, d, e)."""
    kinds = {"id": 0, "h": 0, "lo": 0, "hi": 0, "g": 1, "d": 1, "e": 1}

    def made(values: dict[str, np.ndarray], n: int) -> pa.Table:
        return pa.table({name: pa.array(values[name], pa.int64()) if name in values else pa.nulls(n, pa.int64()) for name in kinds})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        k, ids, hs, los = (left.column(name).to_numpy() for name in ("k", "id", "h", "lo"))
        c = next(kernel.chunks(left.column("segment"), 1 << 40), None)
        if c is None:
            return made({}, 0)
        data, bounds = c.data.view(kind), c.bounds // np.dtype(kind).itemsize
        c = kernel.Chunk(c.first, c.last, data, bounds)
        if len(data) < length:
            return made({}, 0)
        # The same place of a row and of its copy are two places.
        _, copy = _groups(k, ids, hs, los)
        owner, _ = _groups(ids, hs, copy)
        which, a, b = cuts(c, owner, los, length, gram)
        if not len(which):
            return made({}, 0)
        # Words are numbered within the bucket.
        raw = data if kind is np.uint8 else np.unique(data, return_inverse=True)[1]
        base = c.bounds[which]
        part, lo, hi = repeated([raw[x:y] for x, y in zip((base + a).tolist(), (base + b).tolist(), strict=True)], owner[which], los[which] + a, length)
        if not len(part):
            return made({}, 0)
        of, lo, hi = which[part], lo + a[part], hi + a[part]
        spans = made({"id": ids[of], "h": hs[of], "lo": los[of] + lo, "hi": los[of] + hi}, len(of))
        if not right.num_rows:
            return spans
        asked = {name: right.column(name).to_numpy() for name in ("k", "id", "h", "lo", "hi", "g", "d", "e")}
        # The first segment of each stretch and document holds the asked cells.
        number, _ = _groups(*(np.concatenate([x, asked[name]]) for x, name in ((k, "k"), (ids, "id"), (hs, "h"))))
        low = np.lexsort((los, number[: len(k)]))
        at = np.searchsorted(number[: len(k)][low], number[len(k) :])
        have = at < len(k)
        at = low[np.minimum(at, len(k) - 1)]
        have &= number[: len(k)][at] == number[len(k) :]
        begin, finish = c.bounds[of] + lo, c.bounds[of] + hi
        order = np.argsort(begin)
        begin, finish = begin[order], finish[order]
        x = c.bounds[at] + asked["lo"] - los[at]
        y = x + asked["hi"] - asked["lo"]
        last = np.searchsorted(begin, x, "right") - 1
        sure = have & (last >= 0) & (finish[np.maximum(last, 0)] >= y)
        return pa.concat_tables([spans, made({name: asked[name][sure] for name in ("g", "d", "e")}, int(sure.sum()))])

    return run


def _lists(column: pa.Array) -> Iterator[list[tuple[int, int]]]:
    """The sorted spans of each row."""
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    flat = column.flatten()
    lo, hi = (flat.field(name).to_numpy(zero_copy_only=False) for name in ("lo", "hi"))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield sorted(zip(lo[a:b].tolist(), hi[a:b].tolist(), strict=True)) if a < b else []


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    merged: list[list[int]] = []
    for lo, hi in spans:
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        elif lo < hi:
            merged.append([lo, hi])
    return merged


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans, passages) to the remaining bytes and the number of passages and of their words."""
    for batch in batches:
        rows: list[tuple] = []
        for text, spans, passages in zip(batch.column(1), _lists(batch.column(2)), _lists(batch.column(3)), strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            merged, words = _merged(spans), _merged(passages)
            edges = [0, *(x for s in merged for x in s), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((len(data), len(data) - len(kept), len(merged), kept, len(words), sum(b - a for a, b in words)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], pa.binary() if k == 3 else pa.int64()) for k in range(6))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_passages", "n_passage_words"])


def _union(frames: list[DataFrame]) -> DataFrame:
    return frames[0] if len(frames) == 1 else frames[0].unionByName(_union(frames[1:]))


def repeats(docs: DataFrame, length: int, gram: int, most: int, bucket: int, piece: int, stretch: int, kind: type) -> DataFrame:
    """(id, h, lo, hi) of the spans of ``docs`` (doc_id, id, h, text, key) that strings of ``length`` symbols met at two places or more cover, in any order."""
    ws = Workspace(docs.sparkSession, "substrings")
    place = F.struct("id", "h", "lo", "hi")
    key = ["g", "d", "e"]

    def take(wanted: DataFrame, name: str) -> DataFrame:
        """The symbols of wanted (k, id, h, lo, hi)."""
        lists = ws.save(wanted.groupBy("id", "h").agg(F.collect_list(F.struct("k", "lo", "hi")).alias("wanted")), "wanted")
        # Only texts of which something is wanted are shuffled.
        some = bits.near(docs, "key", lists.select(F.xxhash64("id", "h").alias("key")), lists.count(), "inner")
        rows = some.groupBy("id", "h").agg(F.first("text").alias("text"), F.count("*").alias("rows"))
        return ws.save(rows.join(lists, ["id", "h"]).select("id", "h", "text", "rows", "wanted").mapInArrow(_segments(kind), "k long, id long, h long, lo long, segment binary"), name)

    every = ws.save(docs.select("id", "h", "text").mapInArrow(_anchors(length, gram, piece, kind), _FOUND), "anchors")
    # Cells whose anchor is met once are left out by that number alone, before whole cells are counted.
    again = ws.save(every.groupBy("g").agg(F.count("*").alias("n"), F.max("own").alias("own")).filter("n > 1 or own").select("g"), "again")
    found = ws.save(bits.near(every, "g", again, again.count()), "found")
    ws.drop(every, again)
    levels, asks, parts = [found], [], []
    for width in (*(min(w, max(1, length // 2)) for w in FINER), 0):
        cells = found.groupBy(*key).agg(F.count("*").alias("c"), F.min(place).alias("one"), F.max(place).alias("two"), F.max("own").alias("own"))
        groups = cells.groupBy("g").agg(F.sum("c").alias("n"), F.count("*").alias("kinds"), F.max("own").alias("any_own")).filter("n > 1 or any_own")
        cells = ws.save(cells.join(groups, "g").select(*key, "c", "one", "two", "kinds", "own"), "cells")
        pair = [F.col("one.id"), F.col("one.h"), F.col("two.id"), F.col("two.h"), F.col("two.lo") - F.col("one.lo")]
        asks.append(cells.filter("c > 1").select(F.xxhash64(*pair, F.expr(f"one.lo div {stretch}")).alias("k"), "one", "two", *key))
        several = cells.filter("kinds > 1 or own").select(F.col("g").alias("k"), "one.*", "kinds")
        parts.append(several.filter(F.col("kinds") <= most).drop("kinds") if width else several.drop("kinds"))
        hot = several.filter(F.col("kinds") > most).drop("kinds")
        if not width or hot.isEmpty():
            break
        found = ws.save(take(hot, "hot").mapInArrow(_finer(length, gram, width, kind), _FOUND), "finer")
        levels.append(found)

    asked = _union(asks)
    stretches = asked.groupBy("k", "one.id", "one.h", F.col("two.id").alias("id2"), F.col("two.h").alias("h2"), (F.col("two.lo") - F.col("one.lo")).alias("by")).agg(F.min("one.lo").alias("lo"), F.max("one.hi").alias("hi"))
    stretches = ws.save(stretches, "stretches")
    second = stretches.filter("id <> id2 or h <> h2 or by <> 0").select("k", F.col("id2").alias("id"), F.col("h2").alias("h"), (F.col("lo") + F.col("by")).alias("lo"), (F.col("hi") + F.col("by")).alias("hi"))
    segments = take(_union([stretches.select("k", "id", "h", "lo", "hi"), second, *parts]), "segments")

    size = (segments.agg(F.sum(F.octet_length("segment"))).first()[0] or 0) // np.dtype(kind).itemsize
    dealt = F.pmod(F.xxhash64("k"), F.lit(max(1, -(-size // bucket)))).alias("bucket")
    questions = asked.select("k", "one.id", "one.h", "one.lo", "one.hi", *key, dealt)
    answers = segments.select("*", dealt).groupBy("bucket").cogroup(questions.groupBy("bucket")).applyInArrow(_search(length, gram, kind), "id long, h long, lo long, hi long, g long, d long, e long")
    answers = ws.save(answers, "answers")

    sure = answers.filter("g is not null").select(*key)
    whole = [level.join(sure, key).select("id", "h", "lo", "hi") for level in levels]
    spans = ws.save(_union([answers.filter("g is null").select("id", "h", "lo", "hi"), *whole]).distinct(), "spans")
    ws.drop_all(but=spans)
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST, bucket: int = BUCKET, piece: int = PIECE, words: int | None = None, words_gram: int = WORDS_GRAM, words_most: int = WORDS_MOST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (binary); with ``words`` n_passages and n_passage_words, too."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own_id = F.col(f"`{id_col}`").cast("long")
    docs = docs.select(own_id.alias("doc_id"), F.coalesce(own_id, F.lit(0)).alias("id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("text"))
    docs = docs.withColumn("key", F.xxhash64("id", "h"))
    spans = repeats(docs, length, gram, most, bucket, piece, STRETCH, np.uint8).withColumn("words", F.lit(False))
    if words:
        spans = spans.unionByName(repeats(docs, words, words_gram, words_most, WORDS_BUCKET, WORDS_PIECE, WORDS_STRETCH, np.uint64).withColumn("words", F.lit(True)))
    of = lambda flag: F.collect_list(F.when(flag, F.struct("lo", "hi")))
    per_doc = spans.groupBy("id", "h").agg(of(~F.col("words")).alias("spans"), of(F.col("words")).alias("passages"))
    flagged = bits.mark(docs, "key", spans.select(F.xxhash64("id", "h").alias("key")), "hit", spans.select("id", "h").distinct().count())
    out = flagged.filter("hit").join(per_doc, ["id", "h"], "left").select("doc_id", "text", "spans", "passages")
    none = F.lit(None).cast("array<struct<lo:long,hi:long>>")
    bare = flagged.filter("not hit").select("doc_id", "text", none.alias("spans"), none.alias("passages"))
    out = out.unionByName(bare).mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_passages long, n_passage_words long")
    return out if words else out.drop("n_passages", "n_passage_words")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=WORDS)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "n_passage_words")
