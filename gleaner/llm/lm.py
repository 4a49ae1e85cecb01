"""Language-model scoring by a Brown class-based bigram model.

The probability of a token after another is that of its class after the
other's class times that of the word within its class.  A text is its words
(A-Z lower-cased) and one end token; its first token follows the end token.

Classes: exchange clustering.  It starts on the ``core`` most frequent words,
one after the other: from classes dealt by frequency, each word moves to the
class in which the bigram likelihood of the training text is largest, until a
round moves nothing or ``rounds`` are over.  The exchange then goes on over all
words in blocks of documents' tasks: a pass counts, for each word, the classes
before and after it, and moves it to the class with the largest gain in the same
likelihood, its own bigrams taken out of its old class first.  The first pass
places the words that have no class yet; each of ``sweeps`` more moves all words
that gain by it, against the counts from before.  The likelihood of the class
bigrams is measured after each sweep, and one that has not raised it is taken back.  The core's size, like the number of
classes, is where the clustering starts and no bound on the words that are clustered.

A token's probability is ``MIX`` times that of the class model and the rest times
that of its word alone (the base), so little text does not make the model worse than the base.

What moves: word counts and (word, class beside it) counts, combined in each
task before they are shuffled and keyed by word.  Words met often enough to be
among ``lexicon`` (14 bytes each, and the core at least) are broadcast for lookups; the classes of
all others are a table keyed by word.  Neighbours of which one is such a word leave
a pass as a row of their own, by word, and meet that table by joins: texts never move.  A word's class, and so every score,
is the same wherever the word is looked up.  All counts are of all training documents and grow with them; nothing on the driver does.

Defined results: null and empty texts are one end token.  A null doc_id is in
training (its checksum is of the empty text).  Rows that repeat count again.
An empty table gives an empty one.  Other columns are not read, so their names
cannot clash.  Words are known by 64-bit hashes.  Words never met in training are
a class of their own, to which goes half of what leads to words met once; each has
the probability of one place in the vocabulary within it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import kernel
from .workspace import Workspace

CORE, CLASSES, ROUNDS, SWEEPS, LEXICON = 2048, 48, 8, 1, 4_000_000
FOLDS, HELD_OUT = 7, 2
END = np.uint64(0x454E440000000001)
SMOOTHING, MIX = 0.01, 0.8


def held_out(ids: pa.Array) -> np.ndarray:
    return np.fromiter((zlib.crc32(b"" if x is None else str(x).encode()) % FOLDS == HELD_OUT for x in ids.to_pylist()), bool, len(ids))


def tokens(c: kernel.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a chunk's tokens, an end token after each document's words, and where each document's tokens start."""
    w = kernel.words(c)
    at = w.bounds + np.arange(c.n + 1)
    out = np.full(len(w.hash) + c.n, END, dtype=np.uint64)
    if len(w.hash):
        out[np.arange(len(w.hash)) + np.repeat(np.arange(c.n), w.per_doc)] = w.hash
    return out, at


def _training(c: kernel.Chunk, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens of a chunk, and whether each is the first of its document."""
    h, at = tokens(c)
    use = np.repeat(~held[c.first : c.last], np.diff(at))
    first = np.zeros(len(h), dtype=bool)
    first[at[:-1]] = True
    return h[use], first[use]


class _Sums:
    """Counts by key that are combined whenever many have gathered."""

    def __init__(self, most: int = 750_000):
        self.most, self.held, self.parts = most, 0, []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.held += len(keys)
        if self.held > self.most:
            keys, counts = self.get()
            # What stays large gets more room, so combining stays rare.
            self.parts, self.held, self.most = [(keys, counts)], len(keys), max(self.most, 2 * len(keys))

    def get(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = np.concatenate([k for k, _ in self.parts])
        counts = np.concatenate([n for _, n in self.parts])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(counts, first) if len(first) else counts


#: Distinct keys that a worker holds before it hands them on.
FLUSH = 1_000_000


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = _Sums()
    made = lambda: pa.RecordBatch.from_arrays([pa.array(x) for x in sums.get()], ["word", "n"])
    for batch in batches:
        held = held_out(batch.column(0))
        for c in kernel.chunks(batch.column(1)):
            h, _ = _training(c, held)
            sums.add(*np.unique(h.view(np.int64), return_counts=True))
            if sums.held > FLUSH:
                yield made()
                sums = _Sums()
    yield made()


class Lexicon:
    """Sorted hashes of the broadcast words with their counts, and at the end of these 0 for words outside."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        self.words, first = np.unique(words, return_index=True)
        self.size = len(self.words)
        self.counts = np.append(counts[first], 0).astype(np.int32 if counts.max(initial=0) < 1 << 31 else np.int64)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Index of each word, ``size`` for words outside."""
        if not self.size:
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.words, h), self.size - 1)
        return np.where(self.words[at] == h, at, self.size)

    def of(self, h: np.ndarray) -> np.ndarray:
        """The same, repeats looked up once."""
        distinct, back = np.unique(h, return_inverse=True)
        return self.ids(distinct)[back]


def _core_pairs(shared, shared_rank, core: int):
    """(pair, n) of neighbouring training tokens that both are among the first ``core`` words; words go by rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, rank = shared.value, np.append(shared_rank.value, core).astype(np.int64)
        sums = _Sums()
        for batch in batches:
            held = held_out(batch.column(0))
            for c in kernel.chunks(batch.column(1)):
                h, first = _training(c, held)
                if not len(h):
                    continue
                k = rank[lexicon.of(h.view(np.int64))]
                before = _before(k, np.flatnonzero(first))
                both = (k < core) & (before < core)
                sums.add(*np.unique(before[both] * core + k[both], return_counts=True))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in sums.get()], ["pair", "n"])

    return run


def _before(k: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What stands before each token; a document's first token follows its end token."""
    out = np.empty_like(k)
    out[1:] = k[:-1]
    out[starts] = k[np.append(starts[1:], len(k)) - 1]
    return out


def exchange(left: np.ndarray, right: np.ndarray, n: np.ndarray, size: int, classes: int, rounds: int) -> np.ndarray:
    """Classes of ``size`` words by the exchange algorithm on bigram counts.

    Maximises sum N(g,h) log N(g,h) - sum N(g,.) log N(g,.) - sum N(.,g) log N(.,g)
    over class bigram counts; ties keep a word where it is.
    """
    n = n.astype(np.float64)
    weight = np.bincount(left, n, size) + np.bincount(right, n, size)
    order = np.lexsort((np.arange(size), -weight))
    of = np.empty(size, np.int64)
    of[order] = np.arange(size) % classes
    xlogx = lambda x: np.where(x > 0.5, x * np.log(np.maximum(x, 1)), 0.0)
    N = np.zeros((classes, classes))
    np.add.at(N, (of[left], of[right]), n)
    by_left, by_right = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    cut_l, cut_r = np.searchsorted(left[by_left], np.arange(size + 1)), np.searchsorted(right[by_right], np.arange(size + 1))
    for _ in range(rounds):
        moved = 0
        for w in order:
            out, into = by_left[cut_l[w] : cut_l[w + 1]], by_right[cut_r[w] : cut_r[w + 1]]
            out, into = out[right[out] != w], into[left[into] != w]
            own = n[by_left[cut_l[w] : cut_l[w + 1]]].sum() - n[out].sum()
            to = np.bincount(of[right[out]], n[out], classes)
            fro = np.bincount(of[left[into]], n[into], classes)
            if not to.sum() + fro.sum() + own:
                continue
            old = of[w]
            N[old] -= to
            N[:, old] -= fro
            N[old, old] -= own
            # Margins with the word's bigrams, but for those it begins (rows) or ends (columns).
            rows, cols = N.sum(1) + fro, N.sum(0) + to
            # Gain of putting w into each class: the changed row, column and corner, less the changed margins.
            gain = (xlogx(N + to[None, :]) - xlogx(N)).sum(1) + (xlogx(N + fro[:, None]) - xlogx(N)).sum(0)
            corner, d = np.diag(N), np.arange(classes)
            gain += xlogx(corner + to[d] + fro[d] + own) - xlogx(corner + to[d]) - xlogx(corner + fro[d]) + xlogx(corner)
            gain -= xlogx(rows + to.sum() + own) - xlogx(rows) + xlogx(cols + fro.sum() + own) - xlogx(cols)
            best = int(np.argmax(gain))
            if gain[best] <= gain[old] + 1e-9:
                best = old
            N[best] += to
            N[:, best] += fro
            N[best, best] += own
            of[w] = best
            moved += best != old
        if not moved:
            break
    return of


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def gains(v: np.ndarray, old: np.ndarray, N: np.ndarray) -> np.ndarray:
    """Gain in likelihood (as in :func:`exchange`) of each word in each class, its own bigrams taken out of its old class.

    ``v``: counts of the classes before and, in the second half, after each word;
    ``old``: its class, one class more for words without; ``N``: class bigrams, the
    last row and column those of words without class.  Classes without tokens take no word.
    """
    classes = len(N) - 1
    out = np.zeros((len(v), classes))
    margins = []
    for half, M in ((v[:, : classes + 1], N.T), (v[:, classes + 1 :], N)):
        # M[g, c]: bigrams of class g with c on this side.
        word, c = np.nonzero(half)
        n, total = half[word, c], half.sum(1)
        had = M[:classes, c].T.copy()
        mine = old[word] < classes
        had[np.flatnonzero(mine), old[word[mine]]] -= n[mine]
        had = np.maximum(had, 0)
        term = _xlogx(had + n[:, None]) - _xlogx(had)
        some, first = np.unique(word, return_index=True)
        if len(some):
            out[some] += np.add.reduceat(term, first)
        sums = np.tile(M[:classes].sum(1), (len(v), 1))
        mine = np.flatnonzero(old < classes)
        sums[mine, old[mine]] -= total[mine]
        margins.append((np.maximum(sums, 0), total))
    for sums, total in margins:
        out -= _xlogx(sums + total[:, None]) - _xlogx(sums)
    empty = (N[:classes].sum(1) + N[:, :classes].sum(0)) == 0
    out[:, empty] = -np.inf
    return out


CONTEXTS = "word long, context long, n long, class long, once boolean, beside long"


def _contexts(shared, shared_classes, classes: int, new: bool | None, tail: bool):
    """CONTEXTS of the training text: how often the classes before and, ``classes + 1`` further up, after each word stand there, with the word's own class and whether it is met once.

    ``new``: only words without class; None: none but for the class bigrams.  Those are the rows without word: context =
    first * (2 * classes + 1) + second, where a second word met once counts ``classes`` higher, and 2 * classes is that of words without class.

    With ``tail`` words outside the lexicon have classes that are not known here: their own is -1, and where one stands beside
    a word, the row names it in ``beside`` and its context lacks the class.  Such neighbours are no part of the class bigrams.
    """
    side, width = classes + 1, 2 * classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, of = shared.value, np.append(shared_classes.value, np.int16(classes))
        single = lexicon.counts == 1
        table = np.zeros(side * width, np.int64)
        sums, far, held_rows = _Sums(), [], 0

        def rows(word, context, n, k, once, beside) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (word, context, n, k)), pa.array(once, pa.bool_()), pa.array(beside, pa.int64())], [x.split()[0] for x in CONTEXTS.split(", ")])

        def made() -> Iterator[pa.RecordBatch]:
            keys, n = sums.get()
            at = keys // (2 * side)
            yield rows(lexicon.words[at], keys % (2 * side), n, of[at], single[at], pa.nulls(len(at), pa.int64()))
            if far:
                h, context, k, once, named, beside = (np.concatenate(x) for x in zip(*far, strict=True))
                order = np.lexsort((beside, named, context, h))
                h, context, k, once, named, beside = (x[order] for x in (h, context, k, once, named, beside))
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (context[1:] != context[:-1]) | (named[1:] != named[:-1]) | (beside[1:] != beside[:-1])
                first = np.flatnonzero(fresh)
                yield rows(h[first], context[first], np.diff(np.append(first, len(h))), k[first], once[first], pa.array(beside[first], mask=~named[first]))

        for batch in batches:
            held = held_out(batch.column(0))
            for c in kernel.chunks(batch.column(1)):
                h, first = _training(c, held)
                if not len(h):
                    continue
                h = h.view(np.int64)
                ids = lexicon.of(h)
                out, k, once = ids == lexicon.size, of[ids].astype(np.int64), single[ids]
                starts = np.flatnonzero(first)
                after = np.arange(1, len(h) + 1)
                after[np.append(starts[1:], len(h)) - 1] = starts
                before = np.empty_like(after)
                before[after] = np.arange(len(h))
                second = np.where(k == classes, 2 * classes, np.where(once, k + classes, k))
                own = ~(out | out[before]) if tail else np.ones(len(h), bool)
                table += np.bincount((k[before] * width + second)[own], minlength=len(table))
                for shift, other in ((0, before), (side, after)):
                    if new is None and (shift or not tail):
                        continue
                    use = k == classes if new else np.ones(len(h), bool)
                    lost = out[other] if tail else np.zeros(len(h), bool)
                    near = np.flatnonzero(use & ~out & ~lost) if new is not None else ()
                    if len(near):
                        sums.add(*np.unique(ids[near] * (2 * side) + shift + k[other[near]], return_counts=True))
                    x = np.flatnonzero(use & (out | lost))
                    if len(x):
                        named = lost[x]
                        far.append((h[x], shift + np.where(named, 0, k[other[x]]), np.where(out[x] & tail, -1, k[x]), once[x], named, np.where(named, h[other[x]], 0)))
                        held_rows += len(x)
                if sums.held + held_rows > FLUSH:
                    yield from made()
                    sums, far, held_rows = _Sums(), [], 0
        yield from made()
        met = np.flatnonzero(table)
        none = pa.nulls(len(met), pa.int64())
        yield rows(none, met, table[met], none, pa.nulls(len(met), pa.bool_()), none)

    return run


def _resolved(met: DataFrame, tail: DataFrame | None, classes: int) -> DataFrame:
    """CONTEXTS with all classes known, the class bigrams complete.  Words of the tail are rare, so no key is hot."""
    if tail is None:
        return met
    whole = met.filter("beside is null and (word is null or class >= 0)")
    part = met.filter("word is not null and (beside is not null or class < 0)")
    mine = part.filter("class < 0").drop("class", "once").join(tail.select("word", "class", (F.col("n") == 1).alias("once"), F.lit(True).alias("_t")), "word").drop("_t")
    part = part.filter("class >= 0").unionByName(mine)
    named = part.filter("beside is not null").join(tail.select(F.col("word").alias("beside"), F.col("class").alias("_k")), "beside").withColumn("context", F.col("context") + F.col("_k")).drop("_k")
    part = part.filter("beside is null").unionByName(named)
    pairs = part.filter(F.col("context") <= classes).select(F.lit(None).cast("long").alias("word"), (F.col("context") * (2 * classes + 1) + F.col("class") + F.when(F.col("once"), classes).otherwise(0)).alias("context"), "n", F.lit(None).cast("long").alias("class"), F.lit(None).cast("boolean").alias("once"), F.lit(None).cast("long").alias("beside"))
    return whole.unionByName(part).unionByName(pairs)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 10_000) -> Iterator[pa.Table]:
    """Batches joined to tables of ``rows`` rows or more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _words_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(words, counts by context, classes) of rows (word, context, n, class) in order of word; a word's rows may go on in the next batch."""
    last, row, old = np.zeros(0, np.int64), np.zeros((0, width)), np.zeros(0, np.int64)
    for table in _gathered(batches):
        word, context, n, k = (table.column(c).to_numpy() for c in range(4))
        new = np.concatenate([[True], word[1:] != word[:-1]])
        words, kinds = word[new], k[new]
        v = np.bincount((np.cumsum(new) - 1) * width + context, n, len(words) * width).reshape(-1, width)
        if len(last) and last[0] == words[0]:
            v[0] += row[0]
        elif len(last):
            words, v, kinds = np.concatenate([last, words]), np.concatenate([row, v]), np.concatenate([old, kinds])
        last, row, old = words[-1:], v[-1:], kinds[-1:]
        yield words[:-1], v[:-1], kinds[:-1]
    yield last, row, old


def _moves(shared, N: np.ndarray):
    """(word, class, inside) of the words that move, those without class and those that gain by it; ``inside``: in the lexicon."""
    classes = len(N) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for words, v, old in _words_of(batches, 2 * (classes + 1)):
            if not len(words):
                continue
            gain = np.round(gains(v, old, N), 6)
            new = np.argmax(gain, axis=1)
            here = gain[np.arange(len(old)), np.minimum(old, classes - 1)]
            move = (old == classes) | (gain[np.arange(len(old)), new] > here + 1e-6)
            yield pa.RecordBatch.from_arrays([pa.array(words[move]), pa.array(new[move]), pa.array(lexicon.ids(words[move]) < lexicon.size)], ["word", "class", "inside"])

    return run


def likelihood(N: np.ndarray) -> float:
    """What the exchange raises, of class bigrams."""
    return float(_xlogx(N).sum() - _xlogx(N.sum(0)).sum() - _xlogx(N.sum(1)).sum())


class Model:
    """Smoothed log10 probabilities of class bigrams and of words in their classes."""

    def __init__(self, table: np.ndarray, n_words: int):
        """``table``: class bigrams as in :func:`_contexts`, with all words in classes."""
        self.classes = classes = len(table) - 1
        self.n_words = n_words
        often, once = table[:, :classes].astype(np.float64), table[:, classes : 2 * classes].astype(np.float64)
        self.class_tokens = (often + once).sum(0)
        # Half of what leads to words met once is taken to lead to words never met.
        n = np.concatenate([often + once / 2, once.sum(1, keepdims=True) / 2], axis=1)
        self.transition = np.log10((n + SMOOTHING) / (n.sum(1, keepdims=True) + SMOOTHING * (classes + 1)))

    def emission(self, k: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 P(word | class); the last class is that of words never met."""
        tokens = np.append(self.class_tokens, 0)[k]
        return np.where(n > 0, np.log10(np.maximum(n, 1) / np.maximum(tokens, 1)), -np.log10(self.n_words + 1))


REST = "rest array<struct<a:long,ak:long,b:long,bk:long,bn:long>>"


def _score(shared, shared_classes, shared_model, n_total: int, mix: float, whole: bool):
    """SCORED and REST: neighbours (a, b) of which one is not in the lexicon: its word, or the class, and b's count.  They are no part of the sums."""
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("a", "ak", "b", "bk", "bn")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, model = shared.value, shared_model.value
        of, counts = np.append(shared_classes.value, np.int16(model.classes)), lexicon.counts
        scale = np.log10(n_total + model.n_words + 1)
        for batch in batches:
            held = held_out(batch.column(0))
            for c in kernel.chunks(batch.column(1)):
                h, at = tokens(c)
                h = h.view(np.int64)
                ids = lexicon.of(h)
                k, n = of[ids].astype(np.int64), counts[ids].astype(np.int64)
                out = (ids == lexicon.size) & (not whole)
                before, lost = _before(k, at[:-1]), _before(out, at[:-1])
                base = np.log10(n + 1.0) - scale
                log = _mixed(model.emission(k, n) + model.transition[before, k], base, mix)
                here = ~(out | lost)
                sums = lambda x, use: pa.array(np.add.reduceat(np.where(use, x, 0), at[:-1]))  # noqa: B023, E731  each document has its end token
                x = np.flatnonzero(~here)
                word = _before(h, at[:-1])
                rows = pa.StructArray.from_arrays([pa.array(word[x], mask=~lost[x]), pa.array(before[x], pa.int64()), pa.array(h[x], mask=~out[x]), pa.array(k[x], pa.int64()), pa.array(n[x], pa.int64())], ["a", "ak", "b", "bk", "bn"])
                rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(x, at).astype(np.int32)), rows).cast(kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n), pa.array(held[c.first : c.last]), pa.array(np.diff(at)), sums((n > 0).astype(np.int64), ~out), pa.array(np.full(c.n, n_total)), sums(base, ~out), sums(log, here), rest], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "rest"])

    return run


def _mixed(log: np.ndarray, base: np.ndarray, mix: float) -> np.ndarray:
    return np.logaddexp((log + np.log10(mix)) * _LN, (base + np.log10(1 - mix)) * _LN) / _LN if mix < 1 else log


_LN = np.log(10.0)
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _cut(counts: DataFrame, n_words: int, most: int) -> int:
    """The smallest count such that at most ``most`` words are met that often."""
    if n_words <= most:
        return 1
    top = F.least("n", F.lit(1 << 20)).alias("n")
    left, cut = most, (1 << 20) + 1
    for r in counts.groupBy(top).agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        left -= r["words"]
        if left < 0:
            break
        cut = r["n"]
    return cut


class Fitted:
    """A model with the classes of the lexicon (an array beside it) and of all other words (a table: word, class, n; None if there are none)."""

    def __init__(self, lexicon: Lexicon, classes: np.ndarray, tail: DataFrame | None, model: Model, n_total: int):
        self.lexicon, self.classes, self.tail, self.model, self.n_total = lexicon, classes, tail, model, n_total


def fit(docs: DataFrame, ws: Workspace, core: int, classes: int, rounds: int, sweeps: int, lexicon: int) -> Fitted:
    """Counts, classes and class bigrams of the training part of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    counts = ws.save(docs.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    n_words, n_total = (int(x or 0) for x in counts.agg(F.count("*"), F.sum("n")).first())
    top = counts.orderBy(F.desc("n"), "word").limit(core).toArrow()
    least = _cut(counts, n_words, lexicon)
    known = counts.filter(F.col("n") >= least).toArrow()
    words = Lexicon(*(np.concatenate([t.column(c).to_numpy() for t in (top, known)]) for c in ("word", "n")))
    del known
    shared, whole = share(words), words.size == n_words

    core = len(top)
    first = words.ids(top.column("word").to_numpy())
    rank = np.full(words.size, core, np.int32)
    rank[first] = np.arange(core)
    pairs = docs.mapInArrow(_core_pairs(shared, share(rank), core), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).orderBy("pair").toArrow()
    pair, n = pairs.column("pair").to_numpy(), pairs.column("n").to_numpy()
    of = np.full(words.size, classes, np.int16)
    if core:
        of[first] = exchange(pair // core, pair % core, n, core, min(classes, core), rounds)

    side, width = classes + 1, 2 * classes + 1

    def table_of(rows: DataFrame) -> np.ndarray:
        got = rows.filter("word is null").groupBy("context").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(side * width, np.int64)
        out[got.column("context").to_numpy()] = got.column("n").to_numpy()
        return out.reshape(side, width)

    def bigrams(table: np.ndarray) -> np.ndarray:
        return np.concatenate([table[:, :classes] + table[:, classes : 2 * classes], table[:, 2 * classes :]], axis=1).astype(np.float64)

    def moved_by(rows: DataFrame, N: np.ndarray, of: np.ndarray, tail: DataFrame | None) -> tuple[np.ndarray, DataFrame | None]:
        """The classes after the words of ``rows`` have moved."""
        rows = rows.filter("word is not null").select("word", "context", "n", "class").repartition("word").sortWithinPartitions("word")
        moved = ws.save(rows.mapInArrow(_moves(shared, N), "word long, class long, inside boolean"), "moved")
        near = moved.filter("inside").select("word", F.col("class").cast("short")).toArrow()
        of = of.copy()
        of[words.ids(near.column("word").to_numpy())] = near.column("class").to_numpy()
        del near
        if not whole:
            far = moved.filter("not inside").select("word", F.col("class").alias("new"))
            known = tail.join(far, "word", "left").select("word", F.coalesce("new", "class").alias("class"), "n") if tail else far.join(counts, "word").select("word", F.col("new").alias("class"), "n")
            tail = ws.save(known, "tail")
        ws.drop(moved)
        return of, tail

    # Of the core's classes all bigrams are known, and each token has one token before and one after it: so the first pass needs no count of its own.
    N = np.zeros((side, side))
    if core:
        kinds = of[first]
        np.add.at(N, (kinds[pair // core], kinds[pair % core]), n)
        size = np.bincount(kinds, words.counts[first], classes)
        N[:classes, classes], N[classes, :classes] = size - N[:classes, :classes].sum(1), size - N[:classes, :classes].sum(0)
        N[classes, classes] = n_total - N.sum()
    of, tail = moved_by(docs.mapInArrow(_contexts(shared, share(of), classes, True, False), CONTEXTS), N, of, None)
    best: tuple[float, np.ndarray, DataFrame | None, np.ndarray] | None = None
    for step in range(sweeps + 1):
        # The last pass only counts.
        new = None if step == sweeps else False
        met = ws.save(docs.mapInArrow(_contexts(shared, share(of), classes, new, tail is not None), CONTEXTS), "contexts")
        rows = _resolved(met, tail, classes)
        table = table_of(rows)
        value = likelihood(bigrams(table))
        if best and value <= best[0]:
            break
        best = value, of, tail, table
        if new is not None:
            of, tail = moved_by(rows, bigrams(table), of, tail)
        ws.drop(met)
    ws.drop(counts)
    return Fitted(words, best[1], best[2], Model(best[3], n_words), n_total)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", core: int = CORE, classes: int = CLASSES, rounds: int = ROUNDS, sweeps: int = SWEEPS, lexicon: int = LEXICON, mix: float = MIX) -> DataFrame:
    """One row per row of ``docs``: SCORED."""
    spark = docs.sparkSession
    ship(spark)
    share = spark.sparkContext.broadcast
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ws = Workspace(spark, "lm")
    fitted = fit(docs, ws, core, classes, rounds, sweeps, lexicon)
    model, tail = fitted.model, fitted.tail
    run = _score(share(fitted.lexicon), share(fitted.classes), share(model), fitted.n_total, mix, tail is None)
    part = docs.mapInArrow(run, f"{SCORED}, {REST}")
    if tail is None:
        return part.drop("rest")
    # A row's number is fixed by its table, so it can be found again.
    part = ws.save(part.withColumn("row", F.monotonically_increasing_id()), "scored")
    never = model.classes
    tokens_of = np.log10(np.maximum(model.class_tokens, 1))
    steps = spark.createDataFrame([(b, k, float(model.transition[b, k]), float(tokens_of[k]) if k < never else float(np.log10(model.n_words + 1))) for b in range(never + 1) for k in range(never + 1)], "ak long, bk long, step double, tokens double")
    rest = part.select("row", F.explode("rest").alias("t")).select("row", "t.*").withColumn("far", F.col("b").isNotNull())

    def joined(rows: DataFrame, word: str, made: dict) -> DataFrame:
        """Rows with a word get what is known of it, others stay; a null key would be a hot one."""
        known = tail.select(F.col("word").alias(word), F.col("class").alias("_k"), F.col("n").alias("_n"))
        got = rows.filter(F.col(word).isNotNull()).join(known, word, "left").withColumns(made).drop("_k", "_n")
        return rows.filter(F.col(word).isNull()).unionByName(got)

    rest = joined(rest, "a", {"ak": F.coalesce("_k", F.lit(never))})
    rest = joined(rest, "b", {"bk": F.coalesce("_k", F.lit(never)), "bn": F.coalesce("_n", F.lit(0))}).join(F.broadcast(steps), ["ak", "bk"])
    base = F.log10(F.col("bn") + 1.0) - float(np.log10(fitted.n_total + model.n_words + 1))
    log = F.col("step") - F.col("tokens") + F.when(F.col("bn") > 0, F.log10(F.col("bn").cast("double"))).otherwise(0.0)
    log = F.log10(mix * F.pow(F.lit(10.0), log) + (1 - mix) * F.pow(F.lit(10.0), base)) if mix < 1 else log
    far = F.col("far")
    added = rest.groupBy("row").agg(F.count_if(far & (F.col("bn") > 0)).alias("known"), F.sum(F.when(far, base)).alias("base"), F.sum(log).alias("log"))
    plus = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    return part.join(added, "row", "left").select("doc_id", "held_out", "n_tokens", plus("n_known", "known"), "train_tokens", plus("base_score", "base"), plus("score", "log"))


def op7_brown_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
