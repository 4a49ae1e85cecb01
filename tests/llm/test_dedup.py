"""Operators 1, 2, 3 and 9 against plain versions and at their edges."""

import hashlib
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pytest

from gleaner.llm import exact, kernel, lines, minhash, substrings

from .brute import groups, repeats, shingles

DOCS = "doc_id long, text string"


def near(prose, seed, edits):
    w = prose(seed, 60).split()
    for k in range(edits):
        w[(k * 17 + 3) % 60] = f"edit{seed}{k}"
    return " ".join(w)


@pytest.fixture
def docs(prose):
    rows = [(i, prose(i, 40 + i)) for i in range(20)]
    rows += [(100 + i, near(prose, 7, i % 5)) for i in range(40)] + [(200 + i, near(prose, 8, 0)) for i in range(15)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "one two"), (304, "ONE  two"), (305, "x" * 50_000), (306, "a b " * 5_000), (307, "a b " * 5_001), (308, "é ü 😀 \x85 x y"), (309, "É ü 😀 \x85 x y")]
    return rows


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("block", [3, 128])
def test_near_duplicates(spark, docs, percent, block):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(docs, DOCS), percent=percent, block=block).collect()}
    assert got == groups(docs, percent)


def test_near_duplicates_edges(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "y"), (None, "q r s", "z"), (2, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep string").withColumnRenamed("rep", "component_id")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "2", True), ("None", "1", False), ("None", "None", True)]
    assert minhash.keep_one(df).count() == 5


def test_superminhash_estimates():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    sig = minhash.superminhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 1024)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.05
    assert (minhash.superminhash(a[::-1].copy(), np.array([0, len(a)]), 64)[0] == minhash.superminhash(a, np.array([0, len(a)]), 64)[0]).all()


def test_intersections():
    rng = random.Random(3)
    sets = [np.array(sorted({rng.randrange(60) for _ in range(rng.randrange(1, 40))}), np.uint64) for _ in range(40)]
    assert (minhash.intersections(sets) == [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]).all()


@pytest.mark.parametrize("most", [2, 512])
def test_repeats(spark, most):
    rng = random.Random(5)
    base = ["".join(rng.choice("abc ") for _ in range(rng.randint(20, 120))) for _ in range(8)]
    rows = []
    for i in range(150):
        parts = [rng.choice(base)[rng.randint(0, 30) :] if rng.random() < 0.5 else "".join(rng.choice("abcdefgé ") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 6))]
        rows.append((i, "".join(parts) if i % 37 else None))
    rows += [(500, "a" * 300), (501, "ab" * 40), (502, ""), (503, "abc" * 100 + "x" + "abc" * 90)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.remove_repeats(spark.createDataFrame(rows, DOCS), length=40, gram=8, most=most, bucket=1 << 12, piece=64).collect()}
    assert got == repeats(rows, 40)


def test_repeats_of_rows_that_share_an_id(spark, prose):
    """Each row is a document of its own; texts without a copy keep everything."""
    t, u, v = prose(1, 300), prose(2, 300), prose(3, 90)
    rows = [(1, t), (1, u), (2, t), (2, v[:120]), (3, u[:500]), (None, v), (None, v), (None, v), (4, v[:399]), (5, t[50:450] + u[700:1200])]
    want = sorted((str(i), *w) for i, w in [(rows[k][0], x) for k, x in repeats(list(enumerate(t for _, t in rows)), 400).items()])
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.remove_repeats(spark.createDataFrame(rows, DOCS)).collect())
    assert got == want


def test_repeats_in_long_and_periodic_texts(spark, prose):
    """A text of 5 MB, periodic ones, and two strings that are alike to a polynomial hash modulo 2 ** 64."""
    thue = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    long = prose(11, 900_000)
    rows = [(1, long), (2, prose(12, 100) + long[4_000_000:4_100_000]), (3, "a" * 100_000), (4, "xyz" * 30_000), (5, thue[:1024]), (6, thue[1024:] + "!"), (7, prose(13, 5000))]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in substrings.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[3] == (100_000, 100_000, 1) and got[4] == (90_000, 90_000, 1)
    assert got[2][1] >= 100_000 and got[1][1] >= 100_000 and got[2][0] - got[2][1] <= len(prose(12, 100))
    assert got[7][1] == repeats([rows[6]], 400)[7][1]
    small = [rows[4], rows[5]]
    assert {i: got[i][:2] for i in (5, 6)} == {i: w[:2] for i, w in repeats(small, 400).items()}


def test_repeats_border_of_a_common_passage(spark, prose):
    """Very many documents share a passage, each with its own text around it: cells are cut finer, nothing is lost."""
    passage = prose(50, 100)[:500]
    rows = [(i, prose(100 + i, 12) + ("é" if i % 3 else " ") + passage + (" " if i % 2 else "x") + prose(400 + i, 15)) for i in range(60)]
    for most in (3, 512):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.remove_repeats(spark.createDataFrame(rows, DOCS), most=most).collect()}
        assert got == repeats(rows, 400)


def test_repeats_edges(spark, prose):
    assert substrings.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []
    t = prose(1, 300)
    rows = [(None, t, 1, "a"), (None, t, 2, "b"), (3, "short", 3, "c"), (4, None, 4, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int, h string")
    got = sorted((str(r.doc_id), r.n_removed) for r in substrings.remove_repeats(df).collect())
    assert got == [("3", 0), ("4", 0), ("None", len(t.encode())), ("None", len(t.encode()))]


def test_interval_expansion_finds_all_borders():
    rng = np.random.default_rng(2)
    for _ in range(20):
        parts = [rng.integers(97, 99, rng.integers(5, 40)).astype(np.uint8).tobytes() for _ in range(6)]
        text = np.concatenate([np.append(np.frombuffer(p, np.uint8).astype(np.int16) + 1, 0) for p in parts]).astype(np.int16)
        last = np.flatnonzero(text == 0)
        stop = last[np.searchsorted(last, np.arange(len(text)))] - np.arange(len(text))
        sa = substrings.suffixes(text, stop, 8)
        apart = substrings.expand(text, sa, 8)
        word = lambda i: text[i : i + min(8, stop[i])].tobytes() if stop[i] >= 8 else (i,)  # noqa: B023, E731
        assert [word(sa[k]) != word(sa[k - 1]) for k in range(1, len(sa))] == apart[1:].tolist()


def _ends(parts):
    """(text, stop) of strings as the suffix array takes them."""
    text = np.concatenate([np.append(np.frombuffer(p, np.uint8).astype(np.int16) + 1, 0) for p in parts]).astype(np.int16)
    last = np.flatnonzero(text == 0)
    return text, last[np.searchsorted(last, np.arange(len(text)))] - np.arange(len(text))


@pytest.mark.parametrize("bits", [63, 40])
def test_suffixes_are_in_order(monkeypatch, bits):
    """Few and many symbols, empty strings, copies; with and without room for key and place in one word."""
    pack = substrings._ordered
    monkeypatch.setattr(substrings, "_ordered", lambda key, pos, width, own: pack(key, pos, width if bits == 63 else 64, own))
    rng = np.random.default_rng(4)
    for high in (1, 2, 30, 256):
        parts = [rng.integers(0, high, rng.integers(0, 90)).astype(np.uint8).tobytes() for _ in range(12)]
        text, stop = _ends([*parts, *parts[:6], b"", bytes([255]) * 70, bytes(70)])
        for depth in (8, 64):
            sa = substrings.suffixes(text, stop, depth).tolist()
            # Suffixes alike to that depth are in any order; ends differ, by place.
            word = [(text[i : i + min(depth, stop[i])].tolist(), i if stop[i] < depth else -1) for i in range(len(text))]
            key = [(w + [0] * (j >= 0), j) for w, j in word]
            assert sorted(sa) == list(range(len(text)))
            assert [key[i] for i in sa] == sorted(key)


def test_suffixes_sort_copies_once(monkeypatch):
    """Of texts that are there twice, places that go on alike are not sorted again in each round."""
    rng = np.random.default_rng(6)
    part = rng.integers(97, 123, 20_000).astype(np.uint8).tobytes()
    text, stop = _ends([part, part])
    done = []
    for name in ("sort", "argsort"):
        monkeypatch.setattr(substrings.np, name, lambda x, *a, f=getattr(np, name), **b: (done.append(len(x)), f(x, *a, **b))[1])
    substrings.suffixes(text, stop, 400)
    assert sum(done) < 2 * len(text)


def test_passages_of_over_fifty_words(spark, prose):
    """Passages that two documents share are removed, documents without one are left alone; n_bytes is the whole text's either way."""
    rows, planted = [], {}
    for i in range(12):
        passage = prose(700 + i, 130)
        rows += [(2 * i, prose(i, 40) + " " + passage + " " + prose(20 + i, 30)), (2 * i + 1, prose(40 + i, 30) + " " + passage + " " + prose(60 + i, 40))]
        planted |= {2 * i: len(passage), 2 * i + 1: len(passage)}
    rows += [(100 + i, prose(100 + i, 190)) for i in range(12)]
    got = {r.doc_id: r for r in substrings.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert min(planted.values()) > 400 and planted.keys() == {i for i, r in got.items() if r.n_removed}
    assert all(got[i].n_removed >= n for i, n in planted.items())
    assert {i: r.n_bytes for i, r in got.items()} == {i: len(t.encode()) for i, t in rows}


def _passages(rows, least):
    """(maximal runs, words) of each text that runs of ``least`` words met at two places cover."""
    texts = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    met = Counter(tuple(w[k : k + least]) for w in texts.values() for k in range(len(w) - least + 1))
    out = {}
    for i, w in texts.items():
        cover = np.zeros(len(w) + 2, dtype=np.int8)
        for k in range(len(w) - least + 1):
            if met[tuple(w[k : k + least])] > 1:
                cover[k + 1 : k + 1 + least] = 1
        out[i] = (int((np.diff(cover) == 1).sum()), int(cover.sum()))
    return out


def test_short_passages_of_over_fifty_words(spark, table, prose):
    """Passages of 51 words and up that are shorter than 400 bytes: nothing is removed, they are counted."""
    rows = []
    for i in range(12):
        passage = " ".join(w[:5] for w in prose(700 + i, 51 + i % 4).split())
        rows += [(2 * i, prose(i, 40) + " " + passage + " " + prose(20 + i, 30)), (2 * i + 1, prose(40 + i, 30) + "\n" + passage.replace(" ", "  ", i % 3) + "\t" + prose(60 + i, 40))]
        assert len(passage.encode()) < 390
    # One word less is no passage.
    rows += [(50, prose(90, 9) + " a1 " + prose(91, 50) + " b1"), (51, "c1 " + prose(91, 50) + " d1 " + prose(92, 9))]
    rows += [(100 + i, prose(100 + i, 190)) for i in range(12)] + [(200, None), (201, "")]
    got = {r.doc_id: r for r in substrings.op2_suffix_array_dedup(spark, table("documents", rows, DOCS)).collect()}
    assert {i for i, r in got.items() if r.n_passages} == set(range(24)) and not any(r.n_removed for r in got.values())
    assert {i: (r.n_passages, r.n_passage_words) for i, r in got.items()} == _passages(rows, 51)


@pytest.mark.parametrize("most", [2, 512])
def test_passages(spark, most):
    """Few words, copies, periodic texts and common borders against a plain count; what is removed is as without passages."""
    rng = random.Random(9)
    base = [" ".join(rng.choice("a b c dd é".split()) for _ in range(rng.randint(10, 60))) for _ in range(8)]
    rows = []
    for i in range(120):
        parts = [" ".join(rng.choice(base).split()[rng.randint(0, 9) :]) if rng.random() < 0.5 else " ".join(rng.choice("a b c dd É f g".split()) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 6))]
        rows.append((i, rng.choice(" \n").join(parts) if i % 37 else None))
    rows += [(500, "a " * 300), (501, "a b " * 40), (502, ""), (503, "a b c " * 100 + "x " + "a b c " * 90)]
    df = spark.createDataFrame(rows, DOCS)
    got = substrings.remove_repeats(df, length=40, gram=8, most=most, bucket=1 << 12, piece=64, words=12, words_gram=3, words_most=most).collect()
    assert {r.doc_id: (r.n_passages, r.n_passage_words) for r in got} == _passages(rows, 12)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == repeats(rows, 40)


def test_lines_against_sql(spark, table):
    rows = [(i, "\n".join([f"Page {i} of {i * 3} printed today", "All rights reserved here.", f"unique line number {i} with own {'x' * (i + 1)} words", "short"])) for i in range(8)]
    rows += [(20, None), (21, ""), (22, "All rights reserved here.\nAll rights reserved here."), (23, "Page x of y printed today")]
    folder = table("documents", rows, DOCS)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in lines.op1_line_dedup(spark, folder).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    want = {r[0]: (r[1], r[2], r[3]) for r in con.execute(f"select doc_id, n_lines, n_dropped, kept_text from ({lines.OP1_SQL})").fetchall()}
    assert got == want
    assert got[0][1] == 0 and got[5][1] == 3 and got[22][1] == 2 and got[22][2] == "" and got[5][2] == "Page 5 of 15 printed today"


def test_lines_edges(spark):
    assert lines.drop_lines(spark.createDataFrame([], DOCS)).collect() == []
    df = spark.createDataFrame([(None, "a b c", "k"), (1, "a b c", "k"), (2, "a b c", "k"), (3, "a b c", "k"), (3, "a b c", "k")], "doc_id long, text string, id string")
    assert sorted((str(r.doc_id), r.text, r.id) for r in lines.drop_lines(df).collect()) == [("1", "a b c", "k"), ("2", "", "k"), ("3", "", "k"), ("3", "", "k"), ("None", "a b c", "k")]


def test_lines_of_long_texts(spark):
    """Very many recurring lines in one text, shared ids with different texts, clashing names."""
    common = [f"line {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} shared by two" for i in range(8000)]
    rows = [(1, "\n".join(common), "a", 1), (2, "own\n" + "\n".join(common) + "\n\nend of it", "b", 2), (2, common[5] + "\nother", "c", 3), (3, "nothing in common here", "d", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string, n_lines int")
    started = time.time()
    got = sorted((r.doc_id, r.text, r.gone, r.n_lines, r.n_gone) for r in lines.drop_lines(df, counts=("n_lines", "n_gone")).collect())
    assert got == [(1, rows[0][1], "a", 8000, 0), (2, "other", "c", 2, 1), (2, "own\n\nend of it", "b", 8003, 8000), (3, rows[3][1], "d", 1, 0)]
    assert time.time() - started < 60


@pytest.mark.parametrize("bits", [4, 256])
def test_exact(spark, table, prose, bits):
    rows = [(i, prose(i % 7, 20).replace(" ", "  " if i % 3 else "\t")) for i in range(40)] + [(50, None), (51, ""), (52, " \n"), (53, "a b"), (54, "ab")]
    folder = table("documents", rows, DOCS)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_duplicates(spark, f"{folder}/documents.parquet", digest_bits=bits).collect()}
    by = {}
    for i, t in rows:
        by.setdefault("".join((t or "").split()), []).append((-len(t or ""), i))
    want = {i: (min(m)[1], len(m), min(m)[1] == i, hashlib.sha256(k.encode()).hexdigest()) for k, m in by.items() for _, i in m}
    assert got == want


def test_exact_goes_on(spark, table, tmp_path):
    """A second run over more files goes on from the state of the first."""
    state = str(tmp_path / "state")
    folder = table("documents", [(1, "a b c"), (2, "d")], DOCS)
    path = f"{folder}/documents.parquet"
    exact.exact_duplicates(spark, path, state_dir=state).collect()
    spark.createDataFrame([(3, "abc"), (4, "e")], DOCS).write.mode("append").parquet(path)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_duplicates(spark, path, state_dir=state).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 1)}


def test_exact_compares_with_earlier_runs(spark, tmp_path):
    """With a short digest, a document of an earlier run and another folder is read back by its locator."""
    state = str(tmp_path / "state")
    a, b = str(tmp_path / "a b.parquet"), str(tmp_path / "b.parquet")
    spark.createDataFrame([(5, "first text")], DOCS).write.parquet(a)
    texts = [f"other {i}" for i in range(40)]
    spark.createDataFrame([(7 + i, t) for i, t in enumerate(texts)] + [(90, "firsttext")], DOCS).coalesce(1).write.parquet(b)
    exact.exact_duplicates(spark, a, state_dir=state, digest_bits=4).collect()
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_duplicates(spark, b, state_dir=state, digest_bits=4).collect()}
    assert got.pop(90) == (5, 2)
    assert got == {7 + i: (7 + i, 1) for i in range(40)}


def test_exact_edges(spark, table):
    empty = table("empty", [], DOCS)
    assert exact.exact_duplicates(spark, f"{empty}/empty.parquet").collect() == []
    rows = [(-(2**63), "x", "f"), (2**63 - 1, "x", "f"), (None, "x", "f"), (None, "y", "g"), (3, "z" * 2_000_000, "h"), (3, "z" * 2_000_000 + " ", "h"), (4, "u", "i"), (4, "v", "i")]
    folder = table("documents", rows, "doc_id long, text string, digest string")
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact.op9_exact_dedup(spark, folder).collect())
    low, high = str(-(2**63)), str(2**63 - 1)
    assert got == sorted([(low, low, 3, True), (high, low, 3, False), ("None", low, 3, False), ("None", "None", 1, True), ("3", "3", 2, True), ("3", "3", 2, True), ("4", "4", 1, True), ("4", "4", 1, True)])


def test_shingle_counts():
    text = "A b c d e f a B c d e"
    data = np.frombuffer(text.encode(), np.uint8)
    _, at = kernel.gram_sets(kernel.words(kernel.Chunk(0, 1, data, np.array([0, len(data)]))), 5)
    assert at[1] == len(shingles(text))
