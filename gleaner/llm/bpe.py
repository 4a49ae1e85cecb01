"""Byte-level BPE by dynamic programming over prefixes.

For each prefix of a byte string exactly one token can end its encoding: the
suffix token that may follow the last token of the prefix before it.  The
table of these last tokens is all the state there is: appending bytes extends
it exactly, and an edit redoes it from the edit until it agrees again with
what was there.  Whether one token may follow another is read off the two
merge trees: the pair is possible if no merge across the border would come
before the merges that finish the two tokens.

Texts are cut by the vocabulary's pattern, each match is encoded by itself
(a match that is a token is that token), and special tokens have no meaning.
Null and empty texts give no tokens, repeated rows theirs again, and an empty
table an empty one.  The input's other columns stay as they are, but for one that
has the name of the added column: that one is replaced.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .workspace import extended

#: Pieces and token pairs that a worker remembers (some 250 and 100 bytes each)
#: before it forgets the older half.
PIECES, PAIRS = 500_000, 300_000

_FAR = 1 << 62


def _halve(known: dict) -> None:
    """Forget the older half."""
    for key in list(islice(known, len(known) // 2)):
        del known[key]


class Vocabulary:
    """Ranks of byte strings, and what follows from them about pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.longest = max(map(len, ranks))
        # The longest token that ends with these three bytes: none of more than two bytes ends otherwise.
        self._reach: dict[bytes, int] = {}
        for token in ranks:
            if len(token) > 2:
                self._reach[token[-3:]] = max(len(token), self._reach.get(token[-3:], 2))
        self._tree: dict[int, tuple[int, int] | None] = {}
        self._spines: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        self._follows: dict[int, bool] = {}
        #: The last token of prefixes met so far; words that begin alike share them.

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merge(self, data: bytes, until: int = 1) -> list[bytes]:
        """Plain merging by lowest rank, then leftmost; stops at ``until`` parts."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            best, at = min(((self.ranks.get(parts[i] + parts[i + 1], _FAR), i) for i in range(len(parts) - 1)), default=(_FAR, 0))
            if best == _FAR:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def tree(self, token: int) -> tuple[int, int] | None:
        """The two tokens that make this one; (-1, -1) for a byte; None if merging its bytes gives something else."""
        if token not in self._tree:
            data = self.bytes[token]
            if len(data) == 1:
                self._tree[token] = (-1, -1)
            else:
                parts = self.merge(data, until=2)
                self._tree[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 and self.merge(data) == [data] else None
        return self._tree[token]

    def _spine(self, token: int, side: int) -> tuple[list[int], bool]:
        """Tokens at one border of this one in the order in which merging makes them, and whether ranks rise; side 1 is the right."""
        known = self._spines[side]
        if token not in known:
            pair = self.tree(token)
            if pair is None or pair[0] < 0:
                known[token] = [token], pair is not None
            else:
                inner, rising = self._spine(pair[side], side)
                known[token] = [*inner, token], rising and (len(inner) == 1 or inner[-1] < token) and max(pair) < token
        return known[token]

    def _may_follow(self, a: int, b: int) -> bool:
        (left, rising), (right, also), names = self._spine(a, 1), self._spine(b, 0), self.bytes
        if not (rising and also):
            return self.merge(names[a] + names[b]) == [names[a], names[b]]
        i = j = 0
        rank, ends = self.ranks.get, (len(left) - 1, len(right) - 1)
        while True:
            grown_a = left[i + 1] if i < ends[0] else _FAR
            grown_b = right[j + 1] if j < ends[1] else _FAR
            across = rank(names[left[i]] + names[right[j]], _FAR)
            if across < grown_a and across <= grown_b and across < _FAR:
                return False
            if grown_a <= grown_b:
                if grown_a == _FAR:
                    return True
                i += 1
            else:
                j += 1

    def extend(self, data: bytes, last: list[int], end: int) -> None:
        """Append the last tokens of the prefixes of ``data`` up to ``end``; last[k] is that of ``data[:k]``."""
        rank, reach, follows, tree, width = self.ranks.get, self._reach.get, self._follows, self._tree, len(self.bytes)
        for i in range(len(last), end + 1):
            for j in range(max(0, i - reach(data[i - 3 : i], 2)) if i > 2 else 0, i):
                token = rank(data[j:i])
                if token is None or (token not in tree and self.tree(token) is None) or tree[token] is None:
                    continue
                if j:
                    key = last[j] * width + token
                    known = follows.get(key)
                    if known is None:
                        if len(follows) >= PAIRS:
                            _halve(follows)
                        known = follows[key] = self._may_follow(last[j], token)
                    if not known:
                        continue
                last.append(token)
                break
            else:
                raise ValueError("the vocabulary lacks a single byte")

    def piece(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        last = [-1]
        self.extend(data, last, len(data))
        return self.walk(last)

    def walk(self, last: list[int]) -> list[int]:
        out, i = [], len(last) - 1
        while i:
            out.append(last[i])
            i -= len(self.bytes[last[i]])
        return out[::-1]


class Prefixes:
    """A byte string with the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.vocabulary.extend(self.data, self.last, len(self.data))

    def edit(self, start: int, end: int, data: bytes) -> int:
        """Replace ``[start:end]``; returns how many prefixes were redone."""
        old, shift = self.last, len(data) - (end - start)
        self.data = self.data[:start] + data + self.data[end:]
        self.last = old[: start + 1]
        same, redone = 0, 0
        for i in range(start + 1, len(self.data) + 1):
            if i > start + len(data) and same >= self.vocabulary.longest:
                self.last += old[i - shift :]
                break
            self.vocabulary.extend(self.data, self.last, i)
            redone += 1
            same = same + 1 if i > start + len(data) and old[i - shift] == self.last[i] else 0
        return redone

    def ids(self) -> list[int]:
        return self.vocabulary.walk(self.last)


#: White space of Unicode; Python's own class has four control characters more.
_SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


class Encoder:
    """Whole texts to packed ids (little-endian unsigned 32 bits) and back."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        spaces = lambda p, s: p.replace(r"[^\s", f"[^{s}").replace(r"\s", f"[{s}]").replace(r"\S", f"[^{s}]")
        self.split = regex.compile(spaces(pattern, _SPACE)).findall
        # The same classes within ASCII, for the standard library's faster engine.
        ascii_ = spaces(pattern, r"\t-\r ").replace(r"[^\t-\r \p{L}\p{N}]", r"[^\t-\r A-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
        self.split_ascii = self.split if r"\p" in ascii_ else re.compile(ascii_).findall
        known: dict[str, bytes] = {}

        class Known(dict):
            def __missing__(self, piece: str) -> bytes:
                if len(self) >= PIECES:
                    _halve(self)
                ids = vocabulary.piece(piece.encode())
                packed = self[piece] = struct.pack(f"<{len(ids)}I", *ids)
                return packed

        known = Known()
        self.known = known.__getitem__

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.known, (self.split_ascii if text.isascii() else self.split)(text)))

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())) if ids else b""


_encoders: dict[tuple[bytes, str], Encoder] = {}


def _encoder(vocabulary: bytes, pattern: str) -> Encoder:
    key = (vocabulary, pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}), pattern)
    return _encoders[key]


def _slices(batch: pa.RecordBatch, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold about ``limit`` bytes each."""
    step = max(1, min(batch.num_rows, int(batch.num_rows * limit / max(1, batch.nbytes))))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def _with(batch: pa.RecordBatch, name: str, values: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, kind)], [*batch.schema.names, name])


def encode(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", ids_col: str = "ids", bytes_col: str | None = None) -> DataFrame:
    """``df`` and a binary column of ids; ``vocabulary`` is the path of a rank file that the driver can read.

    With ``bytes_col`` the ids are decoded again by the same worker.
    """
    spark = df.sparkSession
    ship(spark)
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    df = df.drop(ids_col, *([bytes_col] if bytes_col else []))
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        for whole in batches:
            for batch in _slices(whole):
                ids = [encoder.encode(x) for x in batch.column(at).to_pylist()]
                out = _with(batch, ids_col, ids, pa.binary())
                yield _with(out, bytes_col, [encoder.decode(x) for x in ids], pa.binary()) if bytes_col else out

    schema = extended(df.schema, ids_col, T.BinaryType())
    return df.mapInArrow(run, extended(schema, bytes_col, T.BinaryType()) if bytes_col else schema)


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` and a binary column of the ids' bytes."""
    spark = df.sparkSession
    ship(spark)
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    df = df.drop(bytes_col)
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, "")
        for whole in batches:
            for batch in _slices(whole):
                yield _with(batch, bytes_col, [encoder.decode(x) for x in batch.column(at).to_pylist()], pa.binary())

    return df.mapInArrow(run, extended(df.schema, bytes_col, T.BinaryType()))


def default_vocabulary() -> tuple[str, str]:
    """Path of the public multilingual 50k rank file and the pattern it goes with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = default_vocabulary()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode(docs, path, pattern, bytes_col="decoded")
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
