"""Operators 11, 12 and 13 against plain versions and at their edges."""

import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from math import log10

import pytest

from gleaner.llm import cohorts, spelling, urlfilter

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
CLIENTS = "client_id long, city string, name string"
T0, CUTOFF = datetime(1970, 1, 1), datetime(2024, 3, 1)
MICRO = timedelta(microseconds=1)


def plain_cells(clicks, clients, step=3):
    city = {}
    for c, name, _ in clients:
        if name is not None:
            city[c] = min(city.get(c, name), name)
    rows = []
    for click, ts, arrived, client, kind, value, _ in set(clicks):
        if ts is None or client is None:
            continue
        h = 1 if click is None else zlib.crc32(str(click).encode())
        known = arrived is not None and arrived + timedelta(days=h % 100 if h % 3 == 0 else 0) < CUTOFF
        rows.append((client, (ts - T0) // MICRO, known, kind, 0 if value is None else int((100 * value + 0.5) // 1)))
    size = step * 86_400_000_000
    begins = defaultdict(dict)
    for client, ts, known, kind, _ in rows:
        for state in (0, 1):
            if kind == "purchase" and (state or known):
                begins[client][state] = min(ts, begins[client].get(state, ts))
    cells = defaultdict(lambda: [set(), set(), 0])
    for client, ts, known, _, cents in rows:
        own = begins[client]
        for state, start in own.items():
            if (state or known) and ts >= start:
                cell = cells[state, city.get(client, ""), start // size, (ts - start) // size]
                cell[0].add(client)
                cell[2] += cents
                if len(own) == 2 and own[0] // size != own[1] // size:
                    cell[1].add(client)
    return {k: (len(u), sum(zlib.crc32(str(c).encode()) for c in u), len(m), cents) for k, (u, m, cents) in cells.items()}


def cells_of(df):
    return {(r.state, r.segment, r.cohort, r.period): (r.users, r.users_crc32, r.moved, r.cents) for r in df.collect()}


def made_clicks(seed, n):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        ts = datetime(2024, 1, 1) + rng.randrange(100 * 86_400_000_000) * MICRO if rng.random() > 0.02 else None
        arrived = (ts or CUTOFF) + timedelta(seconds=rng.randrange(200_000)) if rng.random() > 0.02 else None
        # A third of all clicks has one client.
        client = rng.choice([7, rng.randrange(40), rng.randrange(40)]) if rng.random() > 0.02 else None
        rows.append((k if rng.random() > 0.02 else None, ts, arrived, client, rng.choice(["purchase", "view", "view", None]), rng.choice([None, 1.005, -3.5, 12.34, 0.0]), rng.choice([None, "{}"])))
    return rows + rows[:: 9] + [rows[3]] * 50


@pytest.mark.parametrize("parts", [1, 5, 64])
def test_retention(spark, parts):
    clicks = made_clicks(1, 1500)
    # The same moment, and the moment in which a period ends.
    start = datetime(2024, 2, 1, 1)
    clicks += [(9000 + k, start + d, start, 77, "purchase", 1.0, None) for k, d in enumerate([timedelta(0)] * 20 + [timedelta(days=3) - MICRO, timedelta(days=3), timedelta(days=6)])]
    clients = [(c, rng, "x") for c, rng in [(1, "A"), (1, "B"), (2, None), (3, ""), (7, "A"), (None, "Z"), (7, "A")]]
    got = cells_of(cohorts.retention(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(clients, CLIENTS), parts=parts))
    want = plain_cells(clicks, clients)
    assert got == want
    assert any(v[2] for v in want.values()) and {k[0] for k in want} == {0, 1}


def test_retention_edges(spark):
    none = spark.createDataFrame([], CLICKS)
    clients = spark.createDataFrame([(1, "A", "x")], CLIENTS)
    assert cohorts.retention(none, clients).collect() == []
    odd = [(1, datetime(1969, 12, 30, 1), datetime(2024, 1, 1), 5, "purchase", v, None) for v in (float("nan"), float("inf"), float("-inf"), None)]
    got = cells_of(cohorts.retention(spark.createDataFrame(odd, CLICKS).withColumnRenamed("props", "segment"), clients.limit(0)))
    assert got == {(s, "", -1, 0): (1, zlib.crc32(b"5"), 0, 0) for s in (0, 1)} or got == {(1, "", -1, 0): (1, zlib.crc32(b"5"), 0, 0)}


RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(docs):
    n = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    form, count = {}, {}
    for w in words:
        beside = [x for x in words if near(w, x)]
        best = min(beside, key=lambda x: (-words[x], x), default=None)
        form[w], count[w] = best if best and words[best] >= 10 * words[w] else None, len(beside)

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), words[w], count[w], words[form[w]] if form[w] else None) for w in words}


def variants_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def spelled():
    rng = random.Random(5)
    words = ["spelling", "variante", "grouping", "aaaaaaaa", "möglichkeit", "Übergang", "x" * 63, "y" * 64, "z" * 65, "ab" * 40]
    docs = []
    for k in range(60):
        text = []
        for w in words:
            for _ in range(rng.choice([1, 12])):
                at, c = rng.randrange(len(w)), rng.choice("aéxyz")
                text.append(rng.choice([w] * 12 + [w.upper(), w[:at] + c + w[at + 1 :], w[:at] + w[at + 1 :], w[:at] + c + w[at:]]))
        docs.append((k, " ".join(text)))
    chain = ["chainaaa"] * 2 + ["chainaab"] * 20 + ["chainabb"] * 200 + ["chainabbe"] * 2 + ["chainbbb"] * 2000
    return docs + docs[:3] + [(None, "spelling spellin1 variante"), (100, None), (101, ""), (102, "a1bcdefg×÷ß"), (103, "-".join(chain))]


@pytest.mark.parametrize("plain", [10, 64])
def test_spelling_variants(spark, plain):
    docs = spelled()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "text as word", "doc_id as rank")
    got = variants_of(spelling.spelling_variants(df, plain=plain))
    want = plain_variants(docs)
    assert got == want
    assert any(f and f != r for f, r, *_ in want.values()), "no chain of forms"


def test_spelling_ties_and_empty(spark):
    docs = [(1, "abcdefgh " * 50 + "abcdefgi " * 50 + "abcdefgj " * 3)]
    got = variants_of(spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == plain_variants(docs)
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_words(spark):
    word = "".join(random.Random(3).choices("abcdefgh", k=20_000))
    docs = [(k, f"{word} {word[:777]}Z{word[778:]} {word[:900]}{word[901:]}") for k in range(2)]
    got = spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"), alter=1 << 40)
    assert sorted((len(r.word), r.n, r.n_near) for r in got.collect()) == [(19_999, 2, 1), (20_000, 2, 1), (20_000, 2, 2)]


PAGES = "page_id long, url string"


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("http://A.Example.COM/en/x?q#f", "a.example.com", "/en/x", "example.com/en/"),
        ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/"),
        ("http://x.www.example.com/en/1", "x.www.example.com", "/en/1", "www.example.com/en/"),
        ("http://xexample.com/en/1", "xexample.com", "/en/1", "com/"),
        ("https://com/EN/", "com", "/EN/", "com/"),
        ("http://a.com", "a.com", "", None),
        ("http://a.com?x=/", "a.com", "", None),
        ("http://a.com:80/", "a.com:80", "/", None),
        ("x://b.net/fr/a://c.com/", "b.net", "/fr/a://c.com/", "net/fr/"),
        ("://b.net/es/#", "b.net", "/es/", "net/es/"),
        ("http://b.net/es", "b.net", "/es", None),
        ("http://É.net/es/\nq", "É.net", "/es/\nq", "net/es/"),
        ("b.net/es/", "", "", None),
        ("", "", "", None),
        (None, "", "", None),
    ],
)
def test_rules(spark, url, host, path, rule):
    df = spark.createDataFrame([(1, url)], PAGES)
    h, p = urlfilter.host_and_path(df["url"])
    r = df.select(h.alias("h"), p.alias("p"), urlfilter.rule_of(h, p).alias("r")).first()
    assert tuple(r) == (host, path, rule)


def made_pages(n, seed=2):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        top = rng.choice(["com", "org", "net"])
        rows.append((k, f"https://{rng.choice(['', 'm.', 'blog.'])}site{rng.randrange(30)}.example.{top}/{rng.choice(['en', 'de', 'fr', 'es'])}/{rng.randrange(1000)}{rng.choice(['', '?page=2', '#top', 'é'])}"))
    return rows + rows[:5] + [(None, None), (n, ""), (n + 1, "no scheme"), (n + 2, "http://long.example.org/" + "a/" * 40_000)]


def plain_models(rows, depth, share):
    """By dictionaries: for each kind, counts by order and context."""
    models = []
    for kind in urlfilter.KINDS:
        counts = Counter()
        for url, verdict in rows:
            data = (url or "").encode()
            if verdict == kind and zlib.crc32(data) % 5:
                data = b"\1" * depth + data + b"\0"
                for i in range(depth, len(data)):
                    for k in range(depth + 1):
                        counts[data[i - k : i], data[i]] += 1
        least = max(1, share * sum(n for (c, _), n in counts.items() if c == b""))
        total, kept = Counter(), defaultdict(dict)
        for (c, x), n in counts.items():
            total[c] += n
            if n >= least:
                kept[c][x] = n
        models.append((total, kept))
    return models


def plain_score(model, url, depth):
    total, kept = model
    data = b"\1" * depth + (url or "").encode() + b"\0"
    out = 0.0
    for i in range(depth, len(data)):
        p = 1 / 256
        for k in range(depth + 1):
            c = data[i - k : i]
            if c in kept:
                rest = len(kept[c]) + total[c] - sum(kept[c].values())
                p = (kept[c].get(data[i], 0) + rest * p) / (sum(kept[c].values()) + rest)
        out += log10(p)
    return out


@pytest.mark.parametrize("share", [2.0**-16, 2.0**-7])
def test_url_filter(spark, share):
    pages, depth = made_pages(400), 4
    df = spark.createDataFrame(pages, PAGES).selectExpr("*", "url as verdict", "page_id as score")
    got = urlfilter.judge(df, depth=depth, share=share).collect()
    assert len(got) == len(pages)
    rules = dict(zip(["com/", "example.com/en/", "www.example.com/en/", "net/es/", "net/fr/"], ["allow", "block", "allow", "block", "block"], strict=True))
    by_url = dict(pages)
    says = [(by_url[r.page_id], rules.get(r.rule)) for r in got]
    models = plain_models(says, depth, share)
    scores = []
    for r, (url, verdict) in zip(got, says, strict=True):
        if len(url or "") < 1000:
            d = (plain_score(models[0], url, depth) - plain_score(models[1], url, depth)) / (len((url or "").encode()) + 1)
            assert abs(d - r.score) < 1e-9
        scores.append((r.score, url, verdict, r.verdict))
        assert verdict in (None, r.verdict)
    held = [(s, v) for s, u, v, _ in scores if v and zlib.crc32((u or "").encode()) % 5 == 0]
    size = Counter(v for _, v in held)

    def wrong(limit):
        return sum((s < limit) == (v == "allow") and 1 / size[v] for s, v in held)

    edges = [k / 256 for k in range(-1000, 1000)]
    least = min(map(wrong, edges))
    limit = min((e for e in edges if wrong(e) <= least + 1e-12), key=abs)
    assert all(v == ("allow" if s >= limit else "block") for s, _, rule, v in scores if rule is None)
    # URLs that no model has seen are told apart, better with models of more entries.
    assert wrong(limit) < (0.1 if share < 0.001 else 0.3)


def test_probabilities_add_up():
    import numpy as np

    urls = [b"http://a.com/" + bytes([c]) * 3 for c in range(97, 120)]
    key, n = np.unique(urlfilter.symbols(urls, 3)[0], return_counts=True)
    context, at = np.unique(key >> 8, return_inverse=True)
    total = np.bincount(at, n)
    often = n >= 3
    kept = np.unique(key[often] >> 8)
    model = urlfilter.Markov(key[often], n[often], kept, total[np.searchsorted(context, kept)])
    for before in (b"\1\1\1", b"com", b"zzz", b"/aa"):
        keys = np.stack([np.array([sum(b << 8 * (k + 1) for k, b in enumerate(reversed(before[3 - order :])) if order) + x + ((order + 1) << 56) for x in range(256)]) for order in range(4)])
        assert abs(model.probability(keys).sum() - 1) < 1e-12


@pytest.mark.parametrize(("urls", "verdicts"), [([], []), (["http://a.com/", "q"], ["allow", "allow"]), (["q", None], ["allow", "allow"])])
def test_url_filter_without_kinds(spark, urls, verdicts):
    got = urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), PAGES)).orderBy("page_id").collect()
    assert [r.verdict for r in got] == verdicts or len(urls) == 2 and got[0].verdict == "allow"
