"""G-30 to G-40: gaps in a session's evidence and whether to go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.stages import Folder

MOST_LOOPS, COST_CAP, LANE_CAP = 3, 1.50, 2
GAP = ["session", "ordinal", "topic", "reason", "severity"]
# Lanes to go on with, by reason; limits of the recursion by protocol and tier (depth, questions a node, leaves, dollars).
LANES_FOR = {
    "single-source claim": ["paid_proxy", "searxng_general"],
    "weak source pool": ["paid_proxy", "searxng_general"],
    "no counter-evidence": ["reddit_failures", "searxng_forums"],
    "stale data": ["x_pulse", "bluesky_jetstream", "searxng_general"],
    "sub-topic missed": ["searxng_general", "paid_proxy"],
    "no 3-lens verification": ["paid_proxy", "searxng_general"],
}
LIMITS = {
    ("research", "deep"): (2, 3, 12, 0.50),
    ("research", "one_llm"): (0, 0, 4, 0.15),
    ("deep_research", "deep"): (3, 4, 25, 1.50),
    ("deep_research", "one_llm"): (1, 2, 6, 0.30),
}
DEEP_MODELS = 3


def _gap(df: DataFrame, ordinal: int, topic: Column, reason: str, severity: str) -> DataFrame:
    return df.select("session", F.lit(ordinal).alias("ordinal"), topic.alias("topic"), F.lit(reason).alias("reason"), F.lit(severity).alias("severity"))


def single_source_claims(chunks: DataFrame) -> DataFrame:
    """G-30: claims that exactly one source supports.  ``chunks(session, claim, source, passed)``."""
    lone = chunks.groupBy("session", "claim").agg(F.min("source").alias("a"), F.max("source").alias("b")).filter("a = b")
    return _gap(lone, 0, F.concat(F.lit("single-source claim about "), text.compact(F.col("claim").cast("string"), 80)), "single-source claim", "high")


def weak_pool(chunks: DataFrame) -> DataFrame:
    """G-31: more failed than passed chunks."""
    weak = chunks.groupBy("session").agg(F.count_if(F.col("passed")).alias("p"), F.count_if(~F.col("passed")).alias("f")).filter("f > p")
    return _gap(weak, 1, F.lit("weak post-rerank source pool"), "weak source pool", "high")


def no_counter_evidence(sessions: DataFrame, sources: DataFrame, disagreements: DataFrame | None = None) -> DataFrame:
    """G-32: sessions with neither a source flagged as counter-evidence nor a disagreement of workers."""
    checked = sources.filter("counter").select("session")
    checked = checked.unionByName(disagreements.select("session")) if disagreements is not None else checked
    return _gap(sessions.join(checked.distinct(), "session", "left_anti"), 2, F.lit("counter-evidence not checked"), "no counter-evidence", "medium")


def stale_sources(sources: DataFrame, now: str, hours: Column) -> DataFrame:
    """G-33: sources(session, domain, title, published as a partial ISO date) published more than ``hours`` before ``now``; null hours set no limit, and what is no date is not stale."""
    published = text.partial_date(F.trim("published")).cast("timestamp_ntz")
    limit = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(hours=hours.cast("int"))
    topic = F.concat(F.lit("stale source "), F.col("domain"), F.lit(": "), text.compact(F.col("title"), 80))
    return _gap(sources.filter(F.coalesce(published < limit, F.lit(False))), 3, topic, "stale data", "medium")


def missed_topics(questions: DataFrame) -> DataFrame:
    """G-34: a gap per open question.  ``questions(session, open array<string>)``."""
    each = questions.select("session", F.explode("open").alias("q"))
    return _gap(each, 4, F.concat(F.lit("sub-topic missed: "), text.compact(F.col("q"), 80)), "sub-topic missed", "low")


def missing_lenses(sessions: DataFrame) -> DataFrame:
    """G-34: deep sessions(session, protocol, verifications) without a verification by other models."""
    return _gap(sessions.filter((F.col("protocol") == "deep_research") & (F.coalesce("verifications", F.lit(0)) == 0)), 5, F.lit("missing 3-lens cross-model verification"), "no 3-lens verification", "medium")


def all_gaps(*gaps: DataFrame) -> DataFrame:
    """G-35: all gaps in their fixed order."""
    out = gaps[0]
    for g in gaps[1:]:
        out = out.unionByName(g)
    return out.select(*GAP)


def lanes_for(reasons: Column, routed: Column, cap: int = LANE_CAP) -> Column:
    """G-36: the lanes of the reasons in order, each followed by the routed ones, without repeats, ``cap`` at most."""
    known = F.create_map(*[x for name, lanes in LANES_FOR.items() for x in (F.lit(name), F.array(*map(F.lit, lanes)))])
    none = F.array().cast("array<string>")
    every = F.flatten(F.transform(reasons, lambda r: F.concat(F.coalesce(F.try_element_at(known, r), none), F.coalesce(routed, none))))
    return F.slice(F.array_distinct(every), 1, cap)


def decide(sessions: DataFrame, gaps: DataFrame, triggers: list[str], loops: int = MOST_LOOPS, cost: float = COST_CAP) -> DataFrame:
    """G-36: per session(session, loops, cost, lanes) whether to go on, why (the first three triggering gaps), on which lanes, and what is left to spend."""
    hit = gaps.filter(F.col("severity").isin(triggers)).groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "topic", "reason"))), lambda g: g["reason"]).alias("_reasons"))
    go = (F.col("loops") < loops) & (F.col("cost") < cost) & F.col("_reasons").isNotNull()
    reason = F.when(F.col("loops") >= loops, "max loops reached").when(F.col("cost") >= cost, "cost cap hit").when(F.col("_reasons").isNull(), "no triggering gaps").otherwise(F.concat(F.lit("triggering gaps detected: "), F.array_join(F.slice("_reasons", 1, 3), ", ")))
    lanes = F.when(go, lanes_for(F.col("_reasons"), F.col("lanes"))).otherwise(F.array().cast("array<string>"))
    return sessions.join(hit, "session", "left").select("session", go.alias("iterate"), reason.alias("reason"), lanes.alias("lanes"), (F.col("loops") + 1).alias("next"), F.greatest(F.lit(0.0), F.lit(cost) - F.col("cost")).alias("cost_left"))


def answering_models(calls: DataFrame, key: str) -> DataFrame:
    """G-37: distinct models that gave results without error, and the tier that follows."""
    n = F.count_distinct(F.when((F.col("results") > 0) & (F.coalesce("error", F.lit("")) == ""), F.col("model")))
    return calls.groupBy(key).agg(n.alias("models")).withColumn("tier", F.when(F.col("models") >= DEEP_MODELS, "deep").otherwise("one_llm"))


def recursion_limits(protocol: Column, models: Column) -> Column:
    """G-38: struct of tier, depth, questions a node, leaves and dollars; a protocol without recursion is flat, all zero."""
    made = lambda tier, d, q, n, b: F.struct(F.lit(tier).alias("tier"), F.lit(d).alias("depth"), F.lit(q).alias("questions"), F.lit(n).alias("leaves"), F.lit(b).alias("budget"))
    tier = F.when(models >= DEEP_MODELS, "deep").otherwise("one_llm")
    out = made("flat", 0, 0, 0, 0.0)
    for (name, kind), limits in LIMITS.items():
        out = F.when((protocol == name) & (tier == kind), made(kind, *limits)).otherwise(out)
    return out


def dedupe_questions(questions: Column, most: int | None = None, least: float = 0.86) -> Column:
    """G-39: of an ordered array of questions those that are not too similar to one kept before, ``most`` at most if it is given.  The tokens of each are made once."""

    def keep(kept: Column, q: Column) -> Column:
        near = F.exists(kept, lambda k: text.similarity(k["t"], q["t"]) >= least)
        full = F.lit(False) if most is None else F.size(kept) >= most
        return F.when(near | full, kept).otherwise(F.concat(kept, F.array(q)))

    with_tokens = F.transform(questions, lambda q: F.struct(q.alias("q"), text.similarity_tokens(q).alias("t")))
    return F.aggregate(with_tokens, F.array().cast("array<struct<q:string,t:array<string>>>"), keep, lambda kept: F.transform(kept, lambda k: k["q"]))


def similar_pairs(questions: DataFrame, key: str, id_col: str, text_col: str, least: float = 0.86) -> DataFrame:
    """G-39: (key, a, b, similarity) of the pairs of a key's questions from ``least`` on.

    Such pairs share that part of the larger one's tokens, so they meet over the
    rarest few tokens of each; what meets are ids and sizes, and only pairs whose
    sizes allow it get their tokens.  The rest of the key's pairs are never formed.
    """
    sets = questions.select(key, F.col(id_col).alias("i"), text.similarity_tokens(F.col(text_col)).alias("t")).filter(F.size("t") > 0)
    sets = sets.filter(F.col(key).isNotNull()).withColumn("n", F.size("t"))
    each = sets.select(key, "i", "n", F.explode("t").alias("w"))
    placed = each.join(each.groupBy("w").agg(F.count("*").alias("_df")), "w").withColumn("_place", F.row_number().over(Window.partitionBy(key, "i").orderBy("_df", "w")))
    head = placed.filter(F.col("_place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    met = head.select(key, "w", F.col("i").alias("a"), F.col("n").alias("x")).join(head.select(key, "w", F.col("i").alias("b"), F.col("n").alias("y")), [key, "w"]).filter("a < b")
    near = met.filter(F.least("x", "y") >= F.greatest("x", "y") * least - 1e-9).select(key, "a", "b").distinct()
    full = near.join(sets.select(key, F.col("i").alias("a"), F.col("t").alias("s")), [key, "a"]).join(sets.select(key, F.col("i").alias("b"), "t"), [key, "b"])
    return full.select(key, "a", "b", text.similarity(F.col("s"), F.col("t")).alias("similarity")).filter(F.col("similarity") >= least).distinct()


def keep_first(questions: DataFrame, key: str, id_col: str, text_col: str, least: float = 0.86) -> DataFrame:
    """G-39 over any number of questions: (key, id) of those that the ordered walk keeps: each that is not similar to one kept before it, in the order of ``id_col``, which tells a key's questions apart.

    What is kept is the first independent set of the graph of similar pairs.  In a round every question without an
    earlier one that is still open is kept and the ones similar to it are dropped; the pairs that touch neither stay for the
    next round.  No task sees a key's questions.  A chain of questions each similar to the next takes a round for every second of them.
    """
    folder = Folder(questions.sparkSession, "kept")
    open_ = folder.save(similar_pairs(questions, key, id_col, text_col, least).select(key, "a", "b"), "0")
    gone, step = [], 0
    while not open_.isEmpty():
        later = open_.select(key, F.col("b").alias("a")).distinct()
        kept = open_.select(key, "a").distinct().join(later, [key, "a"], "left_anti")
        step += 1
        dropped = folder.save(open_.join(kept, [key, "a"], "left_semi").select(key, "b").distinct(), f"dropped{step}")
        gone.append(dropped)
        closed = dropped.withColumnRenamed("b", "a").unionByName(kept)
        open_ = folder.save(open_.join(closed, [key, "a"], "left_anti").join(dropped, [key, "b"], "left_anti"), str(step))
    every = questions.select(key, F.col(id_col).alias("id")).distinct()
    for part in gone:
        every = every.join(part.withColumnRenamed("b", "id"), [key, "id"], "left_anti")
    return every


_ASKED = "array<struct<q:string,t:array<string>>>"
_PLAN = ("nodes", "dropped")
_NODES = "array<struct<node:string,depth:int,question:string,budget:double>>"


def _accepted(asked: Column, proposed: Column, limit: Column, least: float) -> Column:
    """Struct of ``new``, the proposed questions that are taken, and ``dropped``, those too similar to one asked or taken before.  Once ``limit`` are taken, the rest is not looked at."""

    def take(acc: Column, q: Column) -> Column:
        near = F.exists(F.concat(asked, acc["new"]), lambda k: text.similarity(k["t"], q["t"]) >= least)
        full = (F.size(acc["new"]) >= limit) & (F.size(acc["new"]) > 0)
        as_is = F.struct(acc["new"].alias("new"), acc["dropped"].alias("dropped"))
        return F.when(full | (q["q"] == ""), as_is).when(near, F.struct(acc["new"].alias("new"), F.concat(acc["dropped"], F.array(q["q"])).alias("dropped"))).otherwise(F.struct(F.concat(acc["new"], F.array(q)).alias("new"), acc["dropped"].alias("dropped")))

    offered = F.transform(F.coalesce(proposed, F.array().cast("array<string>")), lambda q: F.struct(text.squash(q).alias("q"), text.similarity_tokens(q).alias("t")))
    return F.aggregate(offered, F.struct(F.array().cast(_ASKED).alias("new"), F.array().cast("array<string>").alias("dropped")), take)


def _ordered_questions(df: DataFrame, *keys: str) -> DataFrame:
    """The questions of each key in the order of ``pos``; what one model proposes at one time is a short list."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("question", F.lit("")).alias("q")))), lambda x: x["q"]).alias("_proposed"))


def plan_recursion(sessions: DataFrame, scout: DataFrame, proposals: DataFrame, least: float = 0.86) -> DataFrame:
    """G-40: (session, nodes, leaves, dropped, remaining) of each of sessions(session, protocol, models, cost).

    ``scout(session, pos, question)`` proposes the first level and ``proposals(session, parent, pos, question)`` what
    is asked below a question.  Level by level, parents in their order, a session's plan carries the questions asked so
    far, the number of its nodes and each node's slice of the budget: proposals too similar to
    one asked before are dropped; a parent takes as many as its tier allows and as there is room for below the cap on all
    nodes; its slice is dealt evenly to those that it takes.  Once the cost has reached the tier's budget, or where the tier has no
    depth, nothing is planned.  Nodes are named by their place: 0.2 is the third child of the first.
    """
    limits = sessions.select("session", F.coalesce("cost", F.lit(0.0)).alias("_cost"), recursion_limits(F.col("protocol"), F.col("models")).alias("_l"))
    limits = limits.withColumn("remaining", F.greatest(F.lit(0.0), F.col("_l.budget") - F.col("_cost"))).withColumn("_open", (F.col("_cost") < F.col("_l.budget")) & (F.col("_l.depth") > 0) & (F.col("_l.leaves") > 0))
    plan = limits.join(_ordered_questions(scout, "session"), "session", "left")

    def with_roots(a: Column) -> Column:
        roots = F.transform(a["new"], lambda k, i: F.struct(i.cast("string").alias("node"), F.lit(1).alias("depth"), k["q"].alias("question"), (F.col("remaining") / F.size(a["new"])).alias("budget")))
        return F.struct(a["new"].alias("asked"), roots.cast(_NODES).alias("nodes"), a["dropped"].alias("dropped"))

    # What has been asked is what the nodes hold, so a plan is kept without it, and without its tokens.
    kept = lambda p: F.struct(*[p[f].alias(f) for f in _PLAN])
    none = F.struct(F.array().cast(_NODES).alias("nodes"), F.array().cast("array<string>").alias("dropped"))
    first = text.let(text.let(_accepted(F.array().cast(_ASKED), F.col("_proposed"), F.col("_l.leaves"), least), with_roots), kept)
    # Each level is written once: the next one reads it for its parents and for the plan.
    folder = Folder(sessions.sparkSession, "recursion")
    plan = folder.save(plan.withColumn("_plan", F.when(F.col("_open"), first).otherwise(none)).drop("_proposed"), "level1")

    for depth in range(2, max(d for d, *_ in LIMITS.values()) + 1):
        at = F.filter("_plan.nodes", lambda n: n["depth"] == depth - 1)  # noqa: B023
        # A session's parents, at most as many as the cap on all nodes, meet its proposals by the session alone: proposals that are dealt by session stay where they are, and those of no parent go no further.
        parents = plan.filter((F.col("_l.depth") >= depth) & (F.size(at) > 0)).select("session", F.transform(at, lambda n: F.struct(n["node"].alias("node"), n["question"].alias("question"))).alias("_parents"))
        met = proposals.withColumn("parent", text.squash(F.col("parent"))).join(parents.hint("shuffle_hash"), "session")
        below = _ordered_questions(met.withColumn("n", F.explode(F.filter("_parents", lambda n: n["question"] == F.col("parent")))).select("session", "n.node", "pos", "question"), "session", "node")
        # At most as many lists as the cap on all nodes.
        lists = below.groupBy("session").agg(F.map_from_entries(F.collect_list(F.struct("node", "_proposed"))).alias("_lists"))

        def grow(acc: Column, parent: Column) -> Column:
            room = F.col("_l.leaves") - F.size(acc["nodes"])
            taken = _accepted(acc["asked"], F.try_element_at("_lists", parent["node"]), F.least(F.col("_l.questions"), room), least)

            def added(a: Column) -> Column:
                children = F.transform(a["new"], lambda k, i: F.struct(F.concat(parent["node"], F.lit("."), i.cast("string")).alias("node"), (parent["depth"] + 1).alias("depth"), k["q"].alias("question"), (parent["budget"] / F.size(a["new"])).alias("budget")))
                return F.struct(F.concat(acc["asked"], a["new"]).alias("asked"), F.concat(acc["nodes"], children.cast(_NODES)).alias("nodes"), F.concat(acc["dropped"], a["dropped"]).alias("dropped"))

            return F.when(room <= 0, acc).otherwise(text.let(taken, added))

        asked = F.transform("_plan.nodes", lambda n: F.struct(n["question"].alias("q"), text.similarity_tokens(n["question"]).alias("t"))).cast(_ASKED)
        grown = F.aggregate(at, F.struct(asked.alias("asked"), *[F.col(f"_plan.{f}").alias(f) for f in _PLAN]), grow, kept)
        plan = folder.save(plan.join(lists, "session", "left").withColumn("_plan", F.when(F.col("_lists").isNotNull(), grown).otherwise(F.col("_plan"))).drop("_lists"), f"level{depth}")
    return plan.select("session", F.col("_plan.nodes").alias("nodes"), F.size("_plan.nodes").alias("leaves"), F.col("_plan.dropped").alias("dropped"), "remaining")


def rank_by(df: DataFrame, key: str, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
