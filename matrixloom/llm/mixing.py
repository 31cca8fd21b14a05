"""Problem 7: mixing overlapping sources to target weights by a min-cost flow over membership patterns."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.relational import written
from .flow import Flow
from .select import by_group, positions, random_key


def route(patterns: list[tuple[tuple[str, ...], int]], quotas: dict[str, int], repeats: dict[str, int]) -> dict:
    """Tokens each pattern gives to each source: {(pattern index, source): tokens}.

    The r-th use of a pattern's documents costs r - 1 a token, so that everything is used once before
    anything is used twice. Pattern p gives source s at most repeats[s] times its size and is used at
    most max(repeats of its sources) times in all. As only the first edge of a path costs anything, the least cost
    comes from letting in one use after the other, each with as much flow as there is room for.
    """
    names = sorted(quotas)
    f, at = Flow(2 + len(patterns) + len(names)), {s: 2 + len(patterns) + i for i, s in enumerate(names)}
    ends = [f.edge(at[s], 1, quotas[s]) for s in names]
    starts = [f.edge(0, 2 + i, 0) for i in range(len(patterns))]
    uses = {(i, s): f.edge(2 + i, at[s], size * repeats[s]) for i, (members, size) in enumerate(patterns) for s in members}
    most = [max((repeats[s] for s in members), default=0) for members, _ in patterns]
    for r in range(max(most, default=0)):
        if not any(f.cap[e] for e in ends):
            break
        for i, e in enumerate(starts):
            f.cap[e] += patterns[i][1] if r < most[i] else 0
        f.run(0, 1)
    return {k: f.cap[e ^ 1] for k, e in uses.items() if f.cap[e ^ 1] > 0}


_PLAN = "mix_id int, source string, members string, wanted double, quota long, size long, n_docs long, routed long, low long, high long"


def _solve(rows: list[dict]) -> list[dict]:
    src = sorted((r for r in rows if r["source"] is not None), key=lambda r: r["source"])
    pats = sorted((r for r in rows if r["members"] is not None), key=lambda r: r["members"])
    mix = rows[0]["mix_id"]
    names = [r["source"] for r in src]
    members = [tuple(r["members"].split("\x1f")) for r in pats]
    # T adds a document of several sources once for each, as each may use it
    have = {s: sum(r["size"] for m, r in zip(members, pats, strict=True) if s in m) for s in names}
    total = sum(have.values())
    wanted = {r["source"]: (r["target_share"] or 0.0) * (r["total_ratio"] or 0.0) * total for r in src}
    repeats = {r["source"]: max(r["max_repeats"] or 0, 0) for r in src}
    got = route([(m, r["size"]) for m, r in zip(members, pats, strict=True)], {s: math.ceil(wanted[s]) for s in names}, repeats)
    out = [{"mix_id": mix, "source": s, "wanted": wanted[s], "quota": math.ceil(wanted[s]), "size": have[s], "n_docs": 0, "routed": 0} for s in names]
    for i, r in enumerate(pats):
        mine = [(s, got[i, s]) for s in names if (i, s) in got]
        for (s, v), high in zip(mine, accumulate(v for _, v in mine), strict=True):
            out.append({"mix_id": mix, "source": s, "members": r["members"], "wanted": wanted[s], "quota": 0, "size": r["size"], "n_docs": r["n_docs"], "routed": v, "low": high - v, "high": high})
    return out


def _pattern() -> Column:
    return F.array_join(F.array_sort(F.array_distinct("sources")), "\x1f")


def _patterns(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, pattern, members, size, n_docs): the membership patterns of documents and the sources of a mix among them."""
    pats = docs.where("size > 0 AND size(sources) > 0").groupBy(_pattern().alias("pattern")).agg(
        F.sum("size").cast("long").alias("size"), F.count(F.lit(1)).alias("n_docs")
    )
    one = pats.withColumn("source", F.explode(F.split("pattern", "\x1f"))).join(targets.select("mix_id", "source").distinct(), "source")
    one = one.groupBy("mix_id", "pattern", "size", "n_docs").agg(F.array_join(F.array_sort(F.collect_set("source")), "\x1f").alias("members"))
    return one.select("mix_id", "pattern", "members", "size", "n_docs")


def mix_plan(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """The routed tokens of every mix: one row per (mix, source) with null ``members``, holding
    ``wanted``, ``quota`` and the available ``size``, and one per (mix, source, members) with the
    tokens ``routed`` and the places ``low`` to ``high`` they take in the repeated documents of the pattern.

    ``docs``: ``doc_id``, ``sources`` (array of source names), ``size`` (tokens); ``targets`` as in
    ``mix_targets``. Documents without known source, or of null or zero size, carry no tokens. A
    source without documents has size 0. Null shares, ratios and repeats count as 0; repeated rows of
    a key are one. Documents are aggregated by membership pattern on the map side, and patterns with the same
    sources of a mix are one to it: what is shuffled and solved grows with the patterns, not with the documents.
    """
    targets = targets.select(F.col("mix_id").cast("int").alias("mix_id"), "source", "target_share", "max_repeats", "total_ratio").where("source IS NOT NULL").dropDuplicates(["mix_id", "source"])
    used = _patterns(docs, targets).groupBy("mix_id", "members").agg(F.sum("size").alias("size"), F.sum("n_docs").alias("n_docs"))
    return by_group(targets.unionByName(used, allowMissingColumns=True), "mix_id", _solve, _PLAN)


def mix_report(plan: DataFrame) -> DataFrame:
    """Per (mix, source): tokens wanted, available and routed, the share reached and whether it falls short."""
    got = plan.groupBy("mix_id", "source").agg(
        F.max("wanted").alias("wanted"),
        F.max(F.when(F.col("members").isNull(), F.col("size"))).alias("available"),
        F.sum("routed").alias("routed"),
    )
    per_mix = got.groupBy("mix_id").agg(F.sum("routed").alias("_all"))
    return got.join(per_mix, "mix_id").select(
        "mix_id", "source", "wanted", "available", "routed",
        F.try_divide(F.col("routed").cast("double"), F.col("_all")).alias("share_reached"),
        (F.col("routed") < F.col("wanted")).alias("short"),
    )


def mix_documents(docs: DataFrame, plan: DataFrame, seed: int = 1) -> DataFrame:
    """The documents of every mix with their number of uses: (mix_id, source, doc_id, size, uses).

    The documents of a pattern are laid out in a random order, over and over; each source takes its stretch from
    ``low`` to ``high``, and a document goes to the source that holds the middle of one of its turns. So a document is used
    at most ``max_repeats`` times by a source and at most as often as the largest of its sources' ``max_repeats`` in all,
    none is used twice before all are used once, and a source's total is within half a document at each end of a stretch.
    Rows that repeat a ``doc_id`` are documents of their own.
    """
    plan = written(plan, "plan")  # a few rows for each mix, read several times
    p = plan.where("members IS NOT NULL AND routed > 0")
    cut = F.explode(F.array(F.expr("low % size"), F.expr("high % size")))
    cuts = p.select("mix_id", "members", cut.alias("c")).where("c > 0").groupBy("mix_id", "members").agg(F.array_sort(F.collect_set("c")).alias("cuts"))
    takes = p.groupBy("mix_id", "members").agg(F.first("size").alias("_all"), F.first("n_docs").alias("n_rows"), F.collect_list(F.struct("source", "low", "high")).alias("_takes"))
    takes = takes.join(cuts, ["mix_id", "members"], "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<long>")))
    groups = written(_patterns(docs, plan.where("members IS NULL").select("mix_id", "source")).select("mix_id", "members", "pattern").join(takes, ["mix_id", "members"]), "takes")
    d = docs.where("size > 0 AND size(sources) > 0").select("doc_id", F.col("size").cast("long").alias("_size"), _pattern().alias("pattern"))
    d = positions(d, groups, "pattern", ["mix_id", "members"], random_key(seed, "mix_id", "doc_id"), "doc_id", "_size")
    d = d.select("mix_id", "doc_id", "_size", "_mid", "_all", F.explode("_takes").alias("t"))
    turns = lambda c: F.greatest(F.ceil((F.col(c) - F.col("_mid")) / F.col("_all")), F.lit(0))
    d = d.select("mix_id", "t.source", "doc_id", F.col("_size").alias("size"), (turns("t.high") - turns("t.low")).cast("long").alias("uses"))
    return d.where("uses > 0")
