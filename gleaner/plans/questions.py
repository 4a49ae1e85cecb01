"""Queries over conversations: routing, topics, query quality, claim gates, disagreements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evidence, gaps, gates, queries, rollups, routing, sessions
from ..operators.occurrences import occurring
from ..sources import payloads
from ..sources.stages import Folder
from .documents import SQL_SQUASH
from .registry import Registry, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def _users(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter("role = 'user'")


_WORD = "(?:^|[^\\pL\\pN_])"
_AFTER = "(?:$|[^\\pL\\pN_])"


def _sql_regex(pattern: str) -> str:
    """The routing pattern for RE2: word borders that know all letters, spelled out."""
    import re

    body = re.escape(pattern).replace("\\ ", " ").replace("\\-", "-")
    if re.match("[0-9A-Za-z_]", pattern[0]):
        body = _WORD + body
    if re.match("[0-9A-Za-z_]", pattern[-1]):
        body = body + "(?:s|es)?" + _AFTER
    return "(?i)" + body.replace("'", "''")


def _route_sql() -> str:
    rows = []
    for idx, (name, patterns, lanes, topic, skip) in enumerate(routing.RULES):
        named = [p for p in patterns if p != routing.ALWAYS]
        hits = " + ".join(f"CAST(regexp_matches(q, '{_sql_regex(p)}') AS INT)" for p in named) or "0"
        sizes = " + ".join(f"{len(p)} * CAST(regexp_matches(q, '{_sql_regex(p)}') AS INT)" for p in named) or "0"
        quoted = ", ".join(f"'{x}'" for x in lanes)
        rows.append(f"SELECT conv_id, turn, {idx} AS idx, '{name}' AS rule, '{topic}' AS topic, [{quoted}] AS lanes, {str(skip).lower()} AS skip, {str(not named).lower()} AS always, {hits} AS n, {sizes} AS size FROM qs")
    return f"""WITH qs AS (SELECT conv_id, turn, regexp_replace(lower(trim(text)), '^how (?:do|can|should) i ', 'how to ') AS q FROM conversations WHERE role = 'user'),
 m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, size DESC, idx) AS rk FROM ({' UNION ALL '.join(rows)}) WHERE n > 0 OR always),
 f AS (SELECT conv_id, turn, rule, topic, skip, idx FROM m WHERE rk = 1),
 l AS (SELECT m.conv_id, m.turn, unnest(m.lanes) AS lane, m.rk * 100 + unnest(range(len(m.lanes))) AS place FROM m JOIN f USING (conv_id, turn) WHERE NOT m.always OR m.idx = f.idx
   UNION ALL SELECT conv_id, turn, unnest(['searxng_general', 'exa_direct']), 100000 + unnest([0, 1]) FROM f WHERE NOT skip),
 d AS (SELECT conv_id, turn, lane, min(place) AS place FROM l GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY place) AS pos FROM d)"""


ROUTES = _route_sql()


@R.query(ROUTES + " SELECT conv_id, turn, rule, topic FROM f")
def route_questions(spark, sf_dir):
    return routing.route(_users(spark, sf_dir), "text").select("conv_id", "turn", "rule", "topic")


@R.query(ROUTES + " SELECT conv_id, turn, string_agg(lane, ',' ORDER BY pos) AS lanes FROM r WHERE pos <= 10 GROUP BY conv_id, turn")
def route_lanes(spark, sf_dir):
    return routing.route(_users(spark, sf_dir), "text").select("conv_id", "turn", F.array_join("lanes", ",").alias("lanes"))


def _has(keywords: list[str]) -> str:
    return "(" + " OR ".join(f"contains(t, '{k}')" for k in keywords) + ")"


_K = {k: _has(v) for k, v in routing.TOPIC_KEYWORDS.items()}
_PLAIN = "trim(regexp_replace(replace(lower(text), '''', ''), '\\s+', ' ', 'g'))"


@R.query(f"""WITH q AS (SELECT conv_id, turn, {_PLAIN} AS t FROM conversations), k AS (SELECT *, {_K['code']} AS c, {_K['academic']} AS a, {_K['business']} AS b FROM q)
 SELECT conv_id, turn, CASE WHEN b AND NOT c AND NOT a THEN 'business' WHEN c AND NOT a AND NOT b THEN 'code' WHEN a AND NOT c AND NOT b THEN 'academic' WHEN c OR a THEN 'mixed' ELSE 'general' END AS topic,
   {_has(routing.EXAMPLE_ACTIONS)} AND {_has(routing.EXAMPLE_TARGETS)} AS examples, {_has(routing.META_MARKERS)} AS meta FROM k""")
def topic_classify(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", routing.question_topic(F.col("text")).alias("topic"), routing.seeks_examples(F.col("text")).alias("examples"), routing.is_meta(F.col("text")).alias("meta"))


@R.query("SELECT conv_id, turn, regexp_replace(left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80), '-+$', '') AS slug FROM conversations WHERE role = 'user'")
def question_slugs(spark, sf_dir):
    return _users(spark, sf_dir).select("conv_id", "turn", routing.slug(F.col("text")).alias("slug"))


_OFFERED = "[['arxiv', 'linkup_direct'], ['exa_direct'], ['x_pulse', 'youcom_direct', 'exa_direct'], ['searxng_general']][1 + turn % 4]"


@R.query(f"""WITH p AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, '.'), lambda s: trim(s, ' ')), lambda s: s <> '') AS parts, {_OFFERED} AS lanes FROM conversations),
 q AS (SELECT *, coalesce(list_filter(list_transform(lanes, lambda x: regexp_extract(x, 'tavily|linkup|exa|youcom')), lambda x: x <> '')[1], 'tavily') AS provider FROM p),
 e AS (SELECT *, unnest(parts) AS description, unnest(range(len(parts))) AS pos FROM q)
 SELECT conv_id, turn, chr(CAST(65 + pos AS INT)) AS territory, description, array_to_string(CASE WHEN lanes[1] = 'searxng_general' THEN ['searxng_general', provider || '_direct'] WHEN lanes[1] = provider || '_direct' THEN [lanes[1], 'searxng_general'] ELSE [lanes[1], 'searxng_general', provider || '_direct'] END, ',') AS lanes,
   array_to_string(list_filter(list_transform(range(len(parts)), lambda i: chr(CAST(65 + i AS INT))), lambda x: x <> chr(CAST(65 + pos AS INT))), ',') AS not_overlap FROM e""")
def territories(spark, sf_dir):
    """What stands between full stops is a part of its turn; the lanes offered name every provider and none."""
    parts = F.filter(F.transform(F.split(F.col("text"), r"\."), lambda s: F.trim(s)), lambda s: s != "")
    offered = F.get(F.array(*[F.array(*map(F.lit, x)) for x in (["arxiv", "linkup_direct"], ["exa_direct"], ["x_pulse", "youcom_direct", "exa_direct"], ["searxng_general"])]), (F.col("turn") % 4).cast("int"))
    q = table(spark, sf_dir, "conversations").select("conv_id", "turn", parts.alias("parts"), offered.alias("lanes"))
    out = routing.territories(q, ["conv_id", "turn"])
    return out.select("conv_id", "turn", "territory", "description", F.array_join("assigned_lanes", ",").alias("lanes"), F.array_join("not_overlap", ",").alias("not_overlap"))


_ADDED = "CASE turn % 6 WHEN 0 THEN text || ' site:a.org' WHEN 1 THEN text || ' \"open quote' WHEN 2 THEN 'cotton Cotton cotton ' || text WHEN 3 THEN text || ' - filetype:p -no' WHEN 4 THEN left(text, 12) ELSE 'a \"b c\" inurl:x' END"
_OPS = "('site', 'filetype', 'intitle', 'inurl')"
_QUERY = f"""q0 AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'arxiv' ELSE 'searxng_general' END AS lane, {_ADDED} AS q FROM conversations),
 q1 AS (SELECT *, list_transform(list_filter(string_split_regex(q, '\\s+'), lambda t: t <> ''), lambda t: {{'t': t, 'core': regexp_replace(regexp_replace(t, '^-', ''), '^"+|"+$', '', 'g')}}) AS a FROM q0),
 q2 AS (SELECT * EXCLUDE (a), list_transform(a, lambda x: {{'t': x.t, 'op': CASE WHEN x.t = '-' THEN '-' ELSE regexp_extract(lower(x.core), '^(site|filetype|intitle|inurl):', 1) END, 'bare': regexp_replace(x.core, '^[.,;:!?()\\[\\]{{}}<>]+|[.,;:!?()\\[\\]{{}}<>]+$', '', 'g'), 'v': regexp_replace(trim(regexp_replace(x.core, '^[^:]*:', '')), '^"+|"+$', '', 'g')}}) AS a FROM q1),
 q3 AS (SELECT * EXCLUDE (a), list_transform(a, lambda x: {{'t': x.t, 'op': x.op, 'bare': CASE WHEN x.op = '' AND regexp_matches(x.bare, '[A-Za-z0-9]') THEN x.bare END, 'cut': regexp_replace(x.t, '^"+|"+$', '', 'g') = '-' OR (x.op IN {_OPS} AND (x.v = '' OR CASE x.op WHEN 'site' THEN NOT contains(x.v, '.') WHEN 'filetype' THEN length(regexp_replace(x.v, '^\\.+|\\.+$', '', 'g')) < 2 ELSE length(x.v) < 2 END))}}) AS a FROM q2),
 q4 AS (SELECT *, list_filter(list_transform(a, lambda x: x.bare), lambda b: b IS NOT NULL) AS terms FROM q3),
 q5 AS (SELECT *, list_transform(terms, lambda t: lower(t)) AS low FROM q4),
 q6 AS (SELECT *, list_filter(low, lambda x, i: list_position(low, x) = i) AS dist FROM q5),
 q7 AS (SELECT *, length(q) - length(replace(q, '"', '')) AS quotes FROM q6)"""


def _asked(spark, sf_dir):
    """The turns, with operators, open quotes, repeats and short ones among them."""
    t, n = F.col("text"), F.col("turn") % 6
    q = F.when(n == 0, F.concat(t, F.lit(" site:a.org"))).when(n == 1, F.concat(t, F.lit(' "open quote'))).when(n == 2, F.concat(F.lit("cotton Cotton cotton "), t)).when(n == 3, F.concat(t, F.lit(" - filetype:p -no"))).when(n == 4, F.left(t, F.lit(12))).otherwise('a "b c" inurl:x')
    return queries.annotate(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, "arxiv").otherwise("searxng_general").alias("lane"), q.alias("q")), "q")


@R.query(f"""WITH {_QUERY} SELECT conv_id, turn, CAST(len(terms) AS INT) AS terms, array_to_string(list_concat(list_transform(list_filter(a, lambda x: x.cut), lambda x: 'TRUNCATED_OPERATOR ' || x.t),
  CASE WHEN quotes % 2 = 1 THEN ['UNBALANCED_QUOTES "'] ELSE [] END, CASE WHEN len(terms) < 2 THEN ['EMPTY_OR_TRIVIAL ' || len(terms)] ELSE [] END, CASE WHEN len(terms) > 14 THEN ['EXCESSIVE_LENGTH ' || len(terms)] ELSE [] END,
  CASE WHEN len(dist) < len(low) THEN ['DUPLICATE_TERMS ' || array_to_string(list_transform(list_filter(dist, lambda x: len(list_filter(low, lambda y: y = x)) >= 2), lambda x: terms[list_position(low, x)]), ',')] ELSE [] END,
  CASE WHEN lane = 'arxiv' AND len(list_filter(a, lambda x: x.op IN ('site', 'filetype'))) > 0 THEN ['UNSUPPORTED_OPERATOR_FOR_LANE ' || array_to_string(list_transform(list_filter(a, lambda x: x.op IN ('site', 'filetype')), lambda x: x.t), ',')] ELSE [] END), '; ') AS codes FROM q7""")
def query_issues(spark, sf_dir):
    codes = F.array_join(F.transform(queries.issues(F.col("q"), F.col("lane")), lambda i: F.concat_ws(" ", i["code"], i["detail"])), "; ")
    return _asked(spark, sf_dir).select("conv_id", "turn", F.size("q_terms").alias("terms"), codes.alias("codes"))


@R.query(f"""WITH {_QUERY}, r AS (SELECT *, list_filter(a, lambda x: NOT x.cut) AS kept, list_filter(dist, lambda x: len(list_filter(low, lambda y: y = x)) >= 3) AS many, coalesce(list_position(list_transform(a, lambda x: (starts_with(x.t, '-') AND x.t <> '-') OR x.op IN ('site', 'filetype', 'inurl')), true), 0) AS place FROM q7),
 s AS (SELECT *, list_transform(kept, lambda x: coalesce(lower(x.bare), '')) AS lows FROM r),
 t AS (SELECT *, array_to_string(list_transform(list_filter(kept, lambda x, i: NOT (list_contains(many, coalesce(lower(x.bare), '')) AND list_position(lows, coalesce(lower(x.bare), '')) <> i)), lambda x: x.t), ' ') AS fixed,
  coalesce(CASE WHEN place > 0 AND len(a) > 1 THEN array_to_string(list_transform(list_filter(a, lambda x, i: i <> place), lambda x: x.t), ' ') END, CASE WHEN regexp_matches(q, '"[^"\n]+"') THEN regexp_replace(q, '"([^"\n]+)"', '\\1') END, CASE WHEN len(a) > 1 AND len(terms) >= 5 THEN array_to_string(list_transform(a[:-2], lambda x: x.t), ' ') END) AS wide FROM s)
 SELECT conv_id, turn, CASE WHEN (length(fixed) - length(replace(fixed, '"', ''))) % 2 = 1 THEN fixed || '"' ELSE fixed END AS repaired, nullif(wide, q) AS broadened FROM t""")
def query_repair_and_broaden(spark, sf_dir):
    out = queries.broaden(queries.repair(_asked(spark, sf_dir), "repaired"), "q", F.lit("THIN"), "broadened")
    return out.select("conv_id", "turn", "repaired", "broadened")


@R.query("""SELECT conv_id, turn, ['EMPTY', 'THIN', 'GOOD', 'ERROR'][1 + turn % 4] IN ('EMPTY', 'THIN') AND conv_id % 3 <> 0 AND conv_id % 3 <> 2 AS retry FROM conversations""")
def retry_allowed(spark, sf_dir):
    """D-09: lanes that are paid, free, and without a number for their cost."""
    of = F.get(F.array(*map(F.lit, ("EMPTY", "THIN", "GOOD", "ERROR"))), (F.col("turn") % 4).cast("int"))
    lane = F.when(F.col("conv_id") % 3 == 0, "paid_proxy").otherwise("arxiv")
    cost = F.when(F.col("conv_id") % 3 == 2, "free").otherwise("0")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", queries.may_retry(of, lane, cost, ["paid_proxy"]).alias("retry"))


@R.query("SELECT conv_id, turn, text || ' failure OR problem OR criticism OR limitation OR bug' AS query FROM conversations WHERE role = 'user'")
def counter_queries(spark, sf_dir):
    return _users(spark, sf_dir).select("conv_id", "turn", queries.counter_query(F.col("text")).alias("query"))


_WORDISH = "len(regexp_extract_all({x}, '[A-Za-z0-9]+'))"
_VERB = "(?i)(?:^|[^\\pL\\pN_])(is|are|was|were|has|have|had|will|would|can|could|did|does|released|announced|launched|reported|confirmed|said|found|showed|shipped|reached|reach|grew|fell|rose|declined|increased|decreased)(?:$|[^\\pL\\pN_])"
_HEDGE = "(?i)(?:^|[^\\pL\\pN_])(probably|i think|likely|seems|might)(?:$|[^\\pL\\pN_])"
_SOURCE = "(?i)https?://[^\\s<>()\\]]+|\"[^\"]{6,}\"|“[^”]{6,}”|''[^'']{6,}''|‘[^’]{6,}’"
_BARE = f"({_WORDISH.format(x='c')} >= 4 AND (regexp_matches(c, '{_VERB}') OR regexp_matches(c, '\\d')) AND NOT regexp_matches(c, '{_SOURCE}'))"
_SAID = "CASE turn % 3 WHEN 0 THEN '# ' || text WHEN 1 THEN text || chr(10) || 'It probably was found in 2020. See \"a quoted source\" of 12 words. Nothing here:' ELSE replace(text, ' la ', ' is ') END"


@R.query(f"""WITH t AS (SELECT conv_id, turn, {_SAID} AS text FROM conversations), l AS (SELECT conv_id, turn, text, list_transform(string_split_regex(text, '\\r\\n|\\n|\\r'), lambda x: {{'line': x, 's': trim(x)}}) AS ls FROM t),
 k AS (SELECT conv_id, turn, text, list_transform(ls, lambda x: {{'line': x.line, 'skip': x.s = '' OR starts_with(x.s, '#') OR starts_with(x.s, '```') OR starts_with(x.s, '|') OR (ends_with(x.s, ':') AND {_WORDISH.format(x='x.s')} <= 8),
   'cs': list_filter(list_transform(string_split(regexp_replace(x.line, '([.!?])\\s+([A-Z0-9"''“‘])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda c: trim(c)), lambda c: c <> '')}}) AS ls FROM l),
 j AS (SELECT conv_id, turn, text, list_transform(ls, lambda x: {{'line': x.line, 'skip': x.skip, 'cs': list_transform(x.cs, lambda c: {{'c': c, 'why': CASE WHEN {_BARE} THEN CASE WHEN regexp_matches(c, '{_HEDGE}') THEN 'hedging_without_source+missing_source' ELSE 'missing_source' END ELSE '' END}})}}) AS ls FROM k),
 f AS (SELECT conv_id, turn, text, list_transform(ls, lambda x: CASE WHEN x.skip THEN x.line ELSE nullif(array_to_string(list_transform(list_filter(x.cs, lambda c: c.why = ''), lambda c: c.c), ' '), '') END) AS kept,
   flatten(list_transform(ls, lambda x: CASE WHEN x.skip THEN [] ELSE list_transform(list_filter(x.cs, lambda c: c.why <> ''), lambda c: c.why || ': ' || CASE WHEN length({SQL_SQUASH.format(x='c.c')}) <= 160 THEN {SQL_SQUASH.format(x='c.c')} ELSE rtrim(left({SQL_SQUASH.format(x='c.c')}, 157)) || '...' END) END)) AS flags FROM j)
 SELECT conv_id, turn, CASE WHEN len(flags) = 0 THEN text ELSE regexp_replace(array_to_string(list_filter(kept, lambda x: x IS NOT NULL), chr(10)), '^\\s+|\\s+$', '', 'g') END AS text, CAST(len(flags) AS INT) AS dropped, array_to_string(flags, chr(10)) AS flags FROM f""")
def claim_gate(spark, sf_dir):
    """The turns, with headings, hedged and quoted sentences among them."""
    t, n = F.col("text"), F.col("turn") % 3
    said = F.when(n == 0, F.concat(F.lit("# "), t)).when(n == 1, F.concat(t, F.lit('\nIt probably was found in 2020. See "a quoted source" of 12 words. Nothing here:'))).otherwise(F.replace(t, F.lit(" la "), F.lit(" is ")))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("text"))
    return c.select("conv_id", "turn", gates.gate_claims(F.col("text")).alias("g")).select("conv_id", "turn", "g.text", "g.dropped", F.array_join("g.flags", "\n").alias("flags"))


@R.query(r"""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
 j AS (SELECT *, len(regexp_extract_all(line, '[A-Za-z0-9]+')) >= 4 AND (regexp_matches(line, '(?i)(?:^|[^\pL\pN_])(is|are|was|were|has|have|had|will|would|can|could|did|does|released|announced|launched|reported|confirmed|said|found|showed|shipped|reached|reach|grew|fell|rose|declined|increased|decreased)(?:$|[^\pL\pN_])') OR regexp_matches(line, '\d')) AS claim,
   regexp_matches(line, '(?i)https?://[^\s<>()\]]+|"[^"]{6,}"|“[^”]{6,}”|''[^'']{6,}''|‘[^’]{6,}’') AS source, regexp_matches(line, '(?i)(?:^|[^\pL\pN_])(probably|i think|likely|seems|might)(?:$|[^\pL\pN_])') AS hedge FROM s)
 SELECT doc_id, CAST(pos - 1 AS INT) AS pos, concat_ws('+', CASE WHEN claim AND NOT source AND hedge THEN 'hedging_without_source' END, CASE WHEN claim AND NOT source THEN 'missing_source' END) AS reasons FROM j""")
def claim_gate_lines(spark, sf_dir):
    """The flags of whole lines."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.col("text"), "\n")).alias("pos", "line"))
    return lines.select("doc_id", "pos", gates.claim_reasons(F.col("line")).alias("reasons"))


_SPOKEN = "CASE conv_id % 3 WHEN 0 THEN text ELSE CASE turn % 4 WHEN 1 THEN 'Nothing found. ' || text WHEN 2 THEN text || ' The DOI is 10.1' ELSE text END END"


@R.query(f"""WITH s AS (SELECT conv_id, turn, lower(trim({_SPOKEN})) AS t FROM conversations),
 m AS (SELECT conv_id, turn, contains(t, 'no study') OR contains(t, 'does not exist') OR contains(t, 'doesn''t exist') OR contains(t, 'not found') OR contains(t, 'nothing found') OR contains(t, 'measurement vacuum') OR contains(t, 'couldn''t find') AS no,
   contains(t, 'arxiv') OR contains(t, 'doi') OR contains(t, 'paper') OR contains(t, 'study') OR contains(t, 'comparison') OR contains(t, 'vs') OR contains(t, '0.') AS yes FROM s WHERE t <> ''),
 g AS (SELECT conv_id, min(turn) FILTER (no) AS denies, min(turn) FILTER (yes) AS affirms, count(*) AS n FROM m GROUP BY conv_id) SELECT conv_id, denies, affirms FROM g WHERE n > 1 AND denies <> affirms""")
def disagreement_pairs(spark, sf_dir):
    """Two of three conversations have turns that deny and affirm."""
    t, n = F.col("text"), F.col("turn") % 4
    said = F.when(F.col("conv_id") % 3 == 0, t).when(n == 1, F.concat(F.lit("Nothing found. "), t)).when(n == 2, F.concat(t, F.lit(" The DOI is 10.1"))).otherwise(t)
    return gates.disagreements(table(spark, sf_dir, "conversations").withColumn("text", said), "conv_id", "turn", "text")


_SIM = "list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^\\pL\\pN]+', ' ', 'g'), ' '), lambda t: length(t) > 2 AND t NOT IN ('the','and','for','with','from','that','this'))))"
_RATIO = "CASE WHEN least(len({x}), len({y})) = 0 THEN 0 WHEN len(list_intersect({x}, {y})) = least(len({x}), len({y})) THEN len(list_intersect({x}, {y})) / greatest(len({x}), len({y})) ELSE len(list_intersect({x}, {y})) / (len({x}) + len({y}) - len(list_intersect({x}, {y}))) END"


@R.query(f"""WITH q AS (SELECT conv_id, turn, {_SIM} AS t FROM conversations), p AS (SELECT a.conv_id, a.turn AS a, b.turn AS b, {_RATIO.format(x='a.t', y='b.t')} AS similarity FROM q a JOIN q b ON a.conv_id = b.conv_id AND a.turn < b.turn)
 SELECT conv_id, a, b, round(similarity, 9)::DOUBLE AS similarity FROM p WHERE similarity >= 0.05""")
def question_jaccard(spark, sf_dir):
    """Turns of one conversation that are alike to a twentieth or more."""
    return gaps.similar_pairs(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 0.05).withColumn("similarity", F.round("similarity", 9))


@R.query(f"""WITH q AS (SELECT conv_id, list(struct_pack(q := text, t := {_SIM}) ORDER BY turn) AS qs FROM conversations GROUP BY conv_id)
 SELECT conv_id, array_to_string(list_transform(list_reduce(qs, lambda kept, q: CASE WHEN len(list_filter(kept, lambda k: {_RATIO.format(x='k.t', y='q.t')} >= 0.2)) > 0 THEN kept ELSE list_append(kept, q) END, []::STRUCT(q VARCHAR, t VARCHAR[])[]), lambda k: k.q), chr(10)) AS kept FROM q""")
def question_dedupe_greedy(spark, sf_dir):
    q = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("q"))
    return q.select("conv_id", F.array_join(gaps.dedupe_questions(F.transform("q", lambda x: x["text"]), least=0.2), "\n").alias("kept"))


@R.query(f"""WITH q AS (SELECT lang, list(struct_pack(i := item_id, t := {_SIM}) ORDER BY item_id) AS qs FROM (SELECT item_id, item_id % 4 AS lang, text FROM benchmark) GROUP BY lang)
 SELECT lang, unnest(list_transform(list_reduce(qs, lambda kept, q: CASE WHEN len(list_filter(kept, lambda k: {_RATIO.format(x='k.t', y='q.t')} >= 0.02)) > 0 THEN kept ELSE list_append(kept, q) END, []::STRUCT(i BIGINT, t VARCHAR[])[]), lambda k: k.i)) AS id FROM q""")
def questions_kept_first(spark, sf_dir):
    """G-39 by rounds over the graph of similar pairs: benchmark items, in four sets, alike to a fiftieth or more."""
    q = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 4).alias("lang"), "item_id", "text")
    return gaps.keep_first(q, "lang", "item_id", "text", 0.02)


_FAILED = "CASE turn % 5 WHEN 0 THEN 'Error: ' || text WHEN 1 THEN '  ' WHEN 2 THEN text || ' No response received.' WHEN 3 THEN 'The study failed. ' || text ELSE text END"


@R.query(f"SELECT conv_id, turn, trim(x) = '' OR contains(lower(x), 'error:') OR contains(lower(x), 'timeout waiting for response') OR contains(lower(x), 'authentication failed') OR contains(lower(x), 'invalid_grant') OR contains(lower(x), 'no response received') AS failed FROM (SELECT conv_id, turn, {_FAILED} AS x FROM conversations)")
def failed_runs(spark, sf_dir):
    """G-22."""
    t, n = F.col("text"), F.col("turn") % 5
    x = F.when(n == 0, F.concat(F.lit("Error: "), t)).when(n == 1, "  ").when(n == 2, F.concat(t, F.lit(" No response received."))).when(n == 3, F.concat(F.lit("The study failed. "), t)).otherwise(t)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", gates.failed_run(x).alias("failed"))


_PHRASE = "CASE turn % 4 WHEN 0 THEN lower(left(text, 14)) WHEN 1 THEN 'the Cat of paris' WHEN 2 THEN 'latest cat news' ELSE 'c++ and re-use' END"
_PLAINWORDS = "list_filter(regexp_extract_all(lower(x), '[a-z0-9]+'), lambda t: t NOT IN ('a', 'an', 'and', 'for', 'of', 'the', 'to', 'with'))"


@R.query(f"WITH p AS (SELECT conv_id, turn, {_PHRASE} AS x FROM conversations), w AS (SELECT *, {_PLAINWORDS} AS ws FROM p) SELECT conv_id, turn, len(ws) BETWEEN 1 AND 4 AND x = lower(x) AND NOT regexp_matches(x, '\\d') AND NOT coalesce(ws[1] IN ('what', 'why', 'how', 'when', 'where', 'who', 'which', 'compare', 'latest'), false) AND conv_id % 3 < 2 AS ambiguous FROM w")
def ambiguous_phrases(spark, sf_dir):
    """G-13: short beginnings of turns and some phrases; the sources are of none, one or two families."""
    t, n = F.col("text"), F.col("turn") % 4
    x = F.when(n == 0, F.lower(F.left(t, F.lit(14)))).when(n == 1, "the Cat of paris").when(n == 2, "latest cat news").otherwise("c++ and re-use")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", evidence.ambiguous_phrase(x, F.col("conv_id") % 3).alias("ambiguous"))


_SENTENCE = f"left(trim(regexp_extract({SQL_SQUASH.format(x='{x}')}, '^(?:.*?[.!?](?: |$)|.*$)')), 280)"
_TERMS = "list_filter(regexp_extract_all(lower({x}), '[a-z0-9]{{3,}}'), lambda t: t NOT IN ('" + "', '".join(text.QUERY_STOPWORDS) + "'))"
_FITS = "({s} <> '' AND (len(terms) = 0 OR len(list_filter(terms, lambda t: contains(lower({s}), t))) >= CASE WHEN len(terms) = 1 THEN 1 ELSE greatest(2, (len(terms) + 1) // 2) END))"


@R.query(f"""WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS xs, left(arg_min(text, turn), 40) AS question, CASE WHEN conv_id % 4 = 0 THEN 'ANSWER: ' || arg_min(text, turn) WHEN conv_id % 4 = 1 THEN 'NOT_FOUND' END AS said FROM conversations GROUP BY conv_id),
 t AS (SELECT *, {_TERMS.format(x='question')} AS terms, list_transform(xs, lambda x: {_SENTENCE.format(x='x')}) AS ss FROM c)
 SELECT conv_id, coalesce(CASE WHEN conv_id % 4 = 0 AND {SQL_SQUASH.format(x='xs[1]')} <> '' THEN {_SENTENCE.format(x='xs[1]')} END, list_filter(ss[2:], lambda s: {_FITS.format(s='s')})[1], list_filter(ss, lambda s: {_FITS.format(s='s')})[1], '') AS answer FROM t""")
def heuristic_answers(spark, sf_dir):
    """G-09: the first turn's beginning is the question, the later turns are snippets, all turns texts; some backends answer."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("xs"))
    first = F.get("xs", F.lit(0))
    said = F.when(F.col("conv_id") % 4 == 0, F.array(F.concat(F.lit("ANSWER: "), first))).when(F.col("conv_id") % 4 == 1, F.array(F.lit("NOT_FOUND"))).otherwise(F.array().cast("array<string>"))
    return c.select("conv_id", evidence.heuristic_answer(said, F.slice("xs", F.lit(2), F.size("xs")), F.col("xs"), F.left(first, F.lit(40))).alias("answer"))


@R.query(f"""WITH t AS (SELECT conv_id, turn, {_TERMS.format(x='text')} AS terms, lower(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS hay FROM conversations)
 SELECT conv_id, turn, CAST(len(terms) AS INT) AS terms, CAST(CASE WHEN len(terms) = 0 THEN 0 WHEN len(terms) = 1 THEN 1 ELSE greatest(2, (len(terms) + 1) // 2) END AS INT) AS least, CAST(len(list_filter(terms, lambda t: contains(hay, t))) AS INT) AS matches FROM t WHERE hay IS NOT NULL""")
def query_term_matches(spark, sf_dir):
    """E-18: the terms of a turn in the next one."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.query_terms(F.col("text")).alias("t"), F.lower(F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).alias("hay")).filter("hay is not null")
    return c.select("conv_id", "turn", F.size("t").alias("terms"), text.min_matches(F.col("t")).alias("least"), text.term_matches(F.col("hay"), F.col("t")).alias("matches"))


_BACK = "'Note. ANSWER: ' || CASE WHEN turn % 5 = 0 THEN 'not_found' ELSE text END || chr(10) || 'SOURCES: https://a.org/' || turn || '), https://b.org/x. https://a.org/' || turn"


@R.query(f"SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN '' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS answer, 'https://a.org/' || turn || ' https://b.org/x' AS urls FROM conversations")
def backend_outputs(spark, sf_dir):
    """G-25."""
    x = F.concat(F.lit("Note. ANSWER: "), F.when(F.col("turn") % 5 == 0, "not_found").otherwise(F.col("text")), F.lit("\nSOURCES: https://a.org/"), F.col("turn"), F.lit("), https://b.org/x. https://a.org/"), F.col("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", gates.backend_output(x).alias("b")).select("conv_id", "turn", "b.answer", F.array_join("b.urls", " ").alias("urls"))


_TRIED = f"{SQL_SQUASH.format(x='text')}"


@R.query(f"WITH w AS (SELECT conv_id, turn, left({_TRIED}, 300) AS q, list(left({_TRIED}, 300)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tried FROM conversations) SELECT conv_id, turn, CASE WHEN q <> '' AND NOT coalesce(list_contains(tried, q), false) THEN q END AS query FROM w")
def reformulations(spark, sf_dir):
    """N-19: each turn as a new query after those before it."""
    from pyspark.sql import Window

    before = F.collect_list(F.left(text.squash(F.col("text")), F.lit(300))).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", before.alias("tried"))
    return c.select("conv_id", "turn", gates.reformulation(F.col("text"), F.col("tried")).alias("query"))


@R.query(f"WITH r AS (SELECT conv_id, '- ' || role || ': ' || left({SQL_SQUASH.format(x='text')}, 20) AS line, turn FROM conversations) SELECT conv_id, '## Turns' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY turn) AS report FROM r GROUP BY conv_id")
def conversation_reports(spark, sf_dir):
    """B-08."""
    rows = table(spark, sf_dir, "conversations")
    return rollups.report(rows, "conv_id", "Turns", "turn", F.concat_ws(": ", F.col("role"), F.left(text.squash(F.col("text")), F.lit(20))))


@R.query("""WITH u AS (SELECT conv_id, count(*) AS calls, CAST(sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) AS BIGINT) AS prompt_chars, CAST(sum(CASE WHEN role = 'user' THEN 0 ELSE length(text) END) AS BIGINT) AS output_chars FROM conversations GROUP BY conv_id)
 SELECT *, CAST(CASE WHEN prompt_chars = 0 THEN 0 ELSE greatest(1, round_even(prompt_chars / 4.0, 0)) END AS BIGINT) AS prompt_tokens, CAST(CASE WHEN output_chars = 0 THEN 0 ELSE greatest(1, round_even(output_chars / 4.0, 0)) END AS BIGINT) AS output_tokens FROM u""")
def checker_usage(spark, sf_dir):
    """H-10."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("role") == "user", F.col("text")).alias("p"), F.when(F.col("role") != "user", F.col("text")).alias("o"))
    return rollups.checker_usage(c, "conv_id", "p", "o")


@R.query("""SELECT conv_id, turn, CASE turn % 8 WHEN 0 THEN 'q-' || conv_id WHEN 2 THEN 'q-' || conv_id WHEN 4 THEN 'q-' || conv_id WHEN 6 THEN 'q-' || conv_id WHEN 3 THEN 'a b ' || conv_id WHEN 5 THEN 'site:x y' WHEN 7 THEN 'two words' END AS query FROM conversations""")
def request_queries(spark, sf_dir):
    """D-11: queries in JSON bodies, form bodies, addresses and paths, with and without a prefix, and requests without any."""
    i, n = F.col("conv_id").cast("string"), F.col("turn") % 8
    q = F.concat(F.lit("q-"), i)
    url = F.when(n == 0, F.lit("http://x.org/s")).when(n == 2, F.lit("http://x.org/s?a=1")).when(n == 4, F.concat(F.lit("http://x.org/s?a=1&q="), q)).when(n == 6, F.concat(F.lit("http://x.org/s?search_query="), q, F.lit("&x=2"))).when(n == 3, F.concat(F.lit("http://x.org/a%20b%20"), i, F.lit("/"))).when(n == 5, "http://x.org/?keyword=site:x+y").when(n == 7, "http://x.org/?q=ask:+two%20words").otherwise("http://x.org/plain")
    body = F.when(n == 0, F.concat(F.lit('{"query": "'), q, F.lit('"}'))).when(n == 2, F.concat(F.lit("x=1&term="), q))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", queries.request_query(url, body).alias("query"))


def _checked(spark, sf_dir):
    """Answers with a quote, dates, numbers, list numbers and an uncertain section; sources that hold some of them."""
    c = table(spark, sf_dir, "conversations").withColumn("conv_id", F.col("conv_id") * 100 + F.col("turn"))
    plain = F.regexp_replace("text", "[0-9\"“”‘’']", "")
    answer = F.concat(F.lit('It had 42 looms and "ten long years" of work (3) on June 2, 2021.\n1. It cost $1,200.\nCaveats:\nPerhaps 77 of them.\n## So\n'), F.replace(plain, F.lit(":"), F.lit(";")))
    body = F.concat(F.lit("the 42  looms, TEN LONG\nyears"), F.when(F.col("conv_id") % 2 == 0, " cost $1,200 on june 2, 2021").otherwise(""))
    return c.select("conv_id", answer.alias("answer")), c.select("conv_id", body.alias("body"))


@R.query("""WITH t AS (SELECT DISTINCT conv_id % 50 AS k, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS token FROM conversations), d AS (SELECT doc_id % 50 AS k, lower(text) AS text FROM documents)
 SELECT t.k, t.token FROM t WHERE EXISTS (SELECT 1 FROM d WHERE d.k = t.k AND contains(d.text, t.token))""")
def tokens_in_sources(spark, sf_dir):
    """G-19: the words of conversations that are in a document of their pool, as words or within others; fifty pools."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 50).alias("k"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("token"))
    return occurring(c, table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("k"), F.lower("text").alias("text")), "k")


@R.query("SELECT conv_id, 6 AS checked, CASE WHEN conv_id % 2 = 0 THEN 6 ELSE 3 END AS supported, CASE WHEN conv_id % 2 = 0 THEN '' ELSE 'date June 2, 2021; number $1,200; number 2021' END AS unsupported, CASE WHEN conv_id % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS pass_rate FROM (SELECT conv_id * 100 + turn AS conv_id FROM conversations)")
def verbatim_pass_rate(spark, sf_dir):
    """G-19."""
    out = gates.verbatim_check(*_checked(spark, sf_dir), "conv_id", "answer", "body")
    return out.select("conv_id", "checked", "supported", F.array_join(F.transform("unsupported", lambda u: F.concat_ws(" ", u["type"], u["token"])), "; ").alias("unsupported"), "pass_rate")


@R.query("SELECT conv_id, conv_id % 2 <> 0 AS flagged, CASE WHEN conv_id % 2 = 0 THEN '' ELSE 'June 2, 2021|$1,200|2021' END AS claims, CASE WHEN conv_id % 2 <> 0 THEN CASE WHEN conv_id % 3 = 0 THEN 'm' ELSE 'unknown' END END AS model FROM (SELECT conv_id * 100 + turn AS conv_id FROM conversations)")
def audit_flags(spark, sf_dir):
    """G-20: a third of the answers is one model's."""
    checked = gates.verbatim_check(*_checked(spark, sf_dir), "conv_id", "answer", "body")
    models = table(spark, sf_dir, "conversations").withColumn("conv_id", F.col("conv_id") * 100 + F.col("turn")).select("conv_id", F.explode(F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("m"), F.lit("m"))).otherwise(F.array(F.lit("m"), F.lit("n")))).alias("model"))
    a = gates.audit(checked, models, "conv_id", "model")
    return a.select("conv_id", "flagged", F.array_join(F.transform("claims", lambda c: c["claim"]), "|").alias("claims"), F.get("claims", F.lit(0))["model"].alias("model"))


_FIRSTS = "[text || ' named examples', text || ' list of examples', text || ' real named cases', text || ' real-world instances', text || ' documented examples', text || ' specific cases with names']"


@R.query(f"""WITH p AS (SELECT conv_id, turn, text, translate(text, '“”‘’', '""' || chr(39) || chr(39)) AS plain FROM conversations),
 f AS (SELECT *, trim(coalesce(nullif(regexp_extract(plain, '"([^"]+)"|\\x27([^\\x27]+)\\x27', 1), ''), regexp_extract(plain, '"([^"]+)"|\\x27([^\\x27]+)\\x27', 2))) AS phrase FROM p),
 q AS (SELECT conv_id, turn, text, list_concat(['which firms' || turn], {_FIRSTS}[1:4], CASE WHEN phrase = '' THEN {_FIRSTS}[5:6] ELSE ['"' || phrase || '" examples', '"' || phrase || '" list', '"' || phrase || '" named cases', '"' || phrase || '" real-world instances'] END) AS direct FROM f)
 SELECT conv_id, turn, array_to_string(list_concat(direct, [text || ' named examples evidence source ' || i FOR i IN range(len(direct) + 1, 10)]), '|') AS questions FROM q""")
def subquestions(spark, sf_dir):
    """C-10, C-12: one of two candidates is about the question; nine in all; around a quoted phrase where there is one."""
    offered = F.array(F.concat(F.lit("which firms"), F.col("turn")), F.lit("What does it mean"))
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.array_join(routing.fill_subquestions(F.col("text"), offered, 9), "|").alias("questions"))


def recursion_inputs(spark, sf_dir):
    """Sessions, what their scouts propose, and what is proposed below a question: a conversation's sentences; below each the six that follow, every third for the scout."""
    return recursion_rows(table(spark, sf_dir, "conversations"))


def recursion_rows(c):
    said = c.select(F.col("conv_id").alias("session"), "turn", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("k", "question"))
    # The six that follow come along in the same walk: nothing is joined, and no text is dealt twice.
    order = Window.partitionBy("session").orderBy("turn", "k")
    placed = said.withColumn("i", F.row_number().over(order) - 1)
    ahead = placed.withColumn("next", F.array(*[F.lead("question", n).over(order) for n in range(1, 7)]))
    below = ahead.select("session", F.col("question").alias("parent"), "i", F.posexplode("next").alias("step", "question")).filter("question is not null")
    below = below.select("session", "parent", (F.col("i") * 10 + F.col("step") + 1).alias("pos"), "question")
    i = F.col("conv_id")
    sessions = c.select("conv_id").distinct().select(i.alias("session"), F.when(i % 5 == 0, "search").when(i % 2 == 0, "research").otherwise("deep_research").alias("protocol"), (i % 7).cast("int").alias("models"), (i % 4 * F.lit(0.2)).alias("cost"))
    return sessions, placed.filter("i % 3 = 0").select("session", F.col("i").alias("pos"), "question"), below


@R.query()
def recursion_plan(spark, sf_dir):
    """G-40 over conversations; folds that SQL cannot take, held against a plain loop in the tests."""
    plan = gaps.plan_recursion(*recursion_inputs(spark, sf_dir))
    return plan.select("session", "leaves", F.size("dropped").alias("dropped"), F.explode("nodes").alias("n")).select("session", "leaves", "dropped", "n.*")


@R.query("SELECT conv_id, min(turn) FILTER (length(text) > 120) AS chosen FROM conversations GROUP BY conv_id")
def first_successes(spark, sf_dir):
    """N-09: the first turn of a conversation that is long enough."""
    c = table(spark, sf_dir, "conversations").withColumn("ok", F.length("text") > 120)
    return gates.first_success(c, "conv_id", "turn", "ok")


@R.query("SELECT conv_id, turn, last_value(CASE WHEN length(text) > 120 THEN sha256(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS heading FROM conversations")
def carried_headings(spark, sf_dir):
    """I-05: the last long turn so far, by its digest."""
    c = table(spark, sf_dir, "conversations").withColumn("said", F.when(F.length("text") > 120, F.sha2("text", 256)))
    return gates.carry_last(c, "conv_id", "turn", "said", "heading").select("conv_id", "turn", "heading")


@R.query("SELECT conv_id, turn, text FROM conversations WHERE (conv_id + turn) % 6 IN (0, 4)")
def jsonl_rows(spark, sf_dir):
    """A-14, B-05: a log of JSON lines, some blank, broken, or no objects, written and read again."""
    c = table(spark, sf_dir, "conversations")
    n = (F.col("conv_id") + F.col("turn")) % 6
    line = F.when(n == 0, F.to_json(F.struct("conv_id", "turn", "text"))).when(n == 1, "").when(n == 2, "{broken").when(n == 3, "[1, 2]").when(n == 4, F.to_json(F.struct("conv_id", "turn", "text", F.lit(1).alias("more")))).otherwise('"text"')
    folder = Folder(spark, "jsonl")
    c.select(line.alias("value")).write.text(folder.path("log"))
    kinds = c.schema
    rows = payloads.read_jsonl(spark, folder.path("log"), f"conv_id {kinds['conv_id'].dataType.simpleString()}, turn {kinds['turn'].dataType.simpleString()}, text string").filter("conv_id is not null")
    sessions.append_jsonl(rows, folder.path("copy"))
    return spark.read.schema(rows.schema).json(folder.path("copy"))


@R.query("SELECT conv_id, count(*) AS turns, sha256(string_agg(text, chr(10) ORDER BY turn)) AS said FROM conversations GROUP BY conv_id")
def session_documents(spark, sf_dir):
    """A-15, B-01: conversations as session documents, saved by day and read from the tree."""
    folder = Folder(spark, "documents")
    c = table(spark, sf_dir, "conversations")
    made = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns")).withColumn("created", F.make_date(F.lit(2024), F.lit(1), (F.col("conv_id") % 28 + 1).cast("int")))
    sessions.save(made, folder.path("tree"), "created")
    read = sessions.load(spark, folder.path("tree"), made.schema)
    return read.select("conv_id", F.size("turns").cast("long").alias("turns"), F.sha2(F.array_join(F.transform("turns", lambda t: t["text"]), "\n"), 256).alias("said"))
