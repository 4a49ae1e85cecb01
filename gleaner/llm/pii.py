r"""Personal data by patterns, checksums and context words, all in SQL functions.

For each kind a regular expression proposes spans, a validator confirms them
(digit counts, address parts, Luhn, mod-97) and words beside a span move its
score: words of the kind up, words that tell of something else (versions,
orders, samples) down.  Offsets are code points, the end exclusive; they and
the neighbourhood come from :mod:`matches`, in time that grows with the text.

Base kinds (email, ip, card, phone) are always reported, with their score, and
``threshold`` is for whoever reads it; the further kinds (iban, national id) are
reported from ``threshold`` on.  An account number is as long as its country
says, so words in capitals behind it do not hide it.

The patterns are written so that no text makes them slow: quantifiers that
cannot give anything back are possessive, and a match may only start where a
run of its first class starts (or where the last match ended).  Both leave the
matches as they are.

Defined results: null counts as the empty text, which has no spans.  Each
input row gives one row, repeated rows included; an empty table gives an empty
one.  The input's other columns stay, but for one with the name of the added
column, which is replaced.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .matches import matches

WINDOW, THRESHOLD = 40, 0.5

# Length of account numbers (IBAN registry) by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _iban() -> str:
    by_length = defaultdict(list)
    for country, n in sorted(IBAN_LENGTHS.items()):
        by_length[n].append(country)
    forms = [rf"(?:{'|'.join(names)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, names in sorted(by_length.items())]
    return rf"(?<![A-Za-z0-9])(?:{'|'.join(forms)})(?![A-Za-z0-9])"


_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban(),
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
BASE = ("email", "ip", "card", "phone")
#: Score of a confirmed span before its neighbourhood counts.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "national_id": 0.4}
NEAR = {
    "email": "mail|contact|write|reach|kontakt|correo|courriel",
    "ip": "address|host|server|login|client|adresse",
    "card": "card|visa|master|amex|credit|debit|payment|karte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|fax|whatsapp|anruf",
    "iban": "iban|bank|account|konto|cuenta|compte",
    "national_id": "ssn|social|security|insurance|identity|national",
}
AGAINST = "version|example|sample|dummy|order no|isbn|release|serial"
FOR_IT, AGAINST_IT = 0.2, 0.3


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _mod97(x: Column) -> Column:
    """Remainder of a rearranged account number, letters as 10 to 35, digit by digit."""
    plain = F.replace(x, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    step = lambda rest, c: F.when(c.rlike("[0-9]"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        return F.length(_digits(x)).between(13, 19) & F.call_function("luhn_check", _digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    if kind == "iban":
        return _mod97(x) == 1
    if kind == "national_id":
        return ~x.rlike(r"^(?:000|666|9..)|-00-|-0000$")
    return F.lit(True)


def spans_of(text: Column, kind: str, may: Column) -> Column:
    """array<struct<kind, start, end, value, score>> in order of start; ``may``: whether the text can have a match at all."""

    def scored(s: Column) -> Column:
        near = F.lower(F.concat(s["before"], F.lit(" "), s["after"]))
        score = F.lit(PRIOR[kind]) + F.when(near.rlike(rf"\b(?:{NEAR[kind]})"), FOR_IT).otherwise(0.0) - F.when(near.rlike(rf"\b(?:{AGAINST})"), AGAINST_IT).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 6).alias("score"))

    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,score:double>>")
    confirmed = F.filter(matches(text, PATTERNS[kind], WINDOW), lambda s: _valid(kind, s["value"]))
    return F.when(may, F.transform(confirmed, scored)).otherwise(none)


def find(df: DataFrame, text_col: str = "text", into: str = "pii", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with an array column of spans, by kind in the order of PATTERNS and then by start."""
    df = df.drop(into)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    digit = text.rlike("[0-9]")
    may = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "iban": text.rlike("[A-Z]{2}[0-9]{2}"), "national_id": text.rlike("[0-9]-[0-9]{2}-[0-9]")}
    parts = []
    for kind in PATTERNS:
        spans = spans_of(text, kind, may.get(kind, digit))
        parts.append(spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= threshold))
    return df.withColumn(into, F.concat(*parts))


def redact(df: DataFrame, text_col: str = "text", pii_col: str = "pii", into: str = "redacted", threshold: float = 0.0) -> DataFrame:
    """``df`` with a copy of the text in which each span with a score from ``threshold`` on is ``<KIND>``; of overlapping spans the one that starts first counts."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    ordered = F.array_sort(F.transform(F.filter(pii_col, lambda s: s["score"] >= threshold), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))

    def step(state: Column, s: Column) -> Column:
        add = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        keep = s["start"] >= state["at"]
        return F.struct(F.when(keep, -s["end"]).otherwise(state["at"]).alias("at"), F.when(keep, add).otherwise(state["out"]).alias("out"))

    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return df.withColumn(into, done)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then the further kinds and the scores of all spans in the order of ``spans``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs).select("doc_id", "pii")
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    scores = F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(F.array_join(F.transform(base, label), ","), 256).alias("base_sha256"), F.array_join(F.transform("pii", label), ",").alias("spans"), *[count(k) for k in PATTERNS if k not in BASE], scores)
