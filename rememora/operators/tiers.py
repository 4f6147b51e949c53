"""The retrieval ladder over a snapshot: candidates, beam expansion, floor.

All queries of a batch move through each tier together; a query that a tier
resolves leaves the set before the next tier is planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rememora.functions.lifecycle import maturity_boost, recency
from rememora.functions.text import intent
from rememora.operators.bm25 import Index, build_index, score_all, score_pairs, weigh_terms
from rememora.operators.ranking import rounded, top_k
from rememora.operators.scoring import Scorer, default_scorer, entry_prior
from rememora.params import DEFAULTS, EDGE_TYPE_WEIGHTS, Params
from rememora.session import settle

QUERY = ["chat_id", "query_id"]
ATTRIBUTES = ["importance", "maturity", "created_at"]


def long_term(entries: DataFrame) -> DataFrame:
    """The retrievable pool: everything but the working scope."""
    return entries.filter(F.col("scope") != "working")


def candidates(index: Index, weights: DataFrame, entries: DataFrame, now: Column,
               params: Params = DEFAULTS, factors: bool = False) -> DataFrame:
    """BM25 top-k first, then rescored by importance, recency and maturity."""
    best = top_k(score_all(index, weights, params), QUERY, [F.desc("bm25"), F.asc("seq")],
                 params.candidates_k, "bm25_rank")
    attributes = long_term(entries).select("chat_id", "id", *ATTRIBUTES)
    scored = settle(best, "candidates").join(attributes, ["chat_id", "id"])
    scored = scored.withColumn("score", rounded(F.col("bm25") * entry_prior(now, params)))
    if factors:
        scored = (scored
                  .withColumn("importance_factor", 1 + F.col("importance") / 100)
                  .withColumn("recency_factor", recency(now, F.col("created_at"), params.recency_tau_days))
                  .withColumn("maturity_factor", maturity_boost(F.col("maturity"))))
    return top_k(scored.filter(F.col("score") > 0), QUERY,
                 [F.desc("score"), F.asc("bm25_rank")], params.candidates_k)


def floor(entries: DataFrame, now: Column, k: int, params: Params = DEFAULTS) -> DataFrame:
    """Query-independent fallback: the k strongest entries of each chat."""
    pool = long_term(entries).filter(F.col("importance").isNotNull() & F.col("created_at").isNotNull())
    scored = pool.select("chat_id", "id", "seq", rounded(entry_prior(now, params)).alias("score"))
    return top_k(scored.filter(~F.isnan("score")), ["chat_id"], [F.desc("score"), F.asc("seq")], k)


def edge_affinity(edge_type: Column, query_intent: Column) -> Column:
    """How much an edge type matters for an intent; unknown pairs weigh nothing."""
    weight = None
    for kind, row in EDGE_TYPE_WEIGHTS.items():
        for wanted, value in row.items():
            hit = (edge_type == kind) & (query_intent == wanted)
            weight = F.when(hit, F.lit(value)) if weight is None else weight.when(hit, F.lit(value))
    return weight.otherwise(F.lit(0.0))


def expand(seeds: DataFrame, edges: DataFrame, entries: DataFrame, index: Index, weights: DataFrame,
           params: Params = DEFAULTS, beams: bool = False) -> DataFrame:
    """Beam walk from ``seeds(chat_id, query_id, id, pos, intent)`` along edges.

    Candidates are cut to the beam *before* duplicates go, so a node reached
    twice takes two places, and its copies both feed the next hop. Returns each
    discovered node once: ``(chat_id, query_id, id, hop, pos, intent)``; with
    ``beams`` it returns the beams as cut, copies included.
    """
    pool = long_term(entries).select("chat_id", "id")
    links = edges.select("chat_id", F.col("from_id").alias("id"), F.col("to_id").alias("to"),
                         "type", F.col("seq").alias("edge_seq"))
    found = seeds.select(*QUERY, "id", F.lit(0).alias("hop"), "pos", "intent")
    frontier = found
    for hop in range(1, params.max_hops + 1):
        reached = (
            frontier.join(links, ["chat_id", "id"])
            .select(*QUERY, F.col("to").alias("id"), "type", "intent",
                    F.col("pos").alias("from_pos"), "edge_seq")
            .join(found.select(*QUERY, "id"), QUERY + ["id"], "left_anti")
            .join(pool, ["chat_id", "id"], "left_semi")
        )
        reached = settle(reached, f"reached-{hop}")
        lexical = score_pairs(index, weights, reached, params)
        # exp() is monotone: ranking by its exponent avoids overflow ties
        strength = rounded(params.lambda_1 * edge_affinity(F.col("type"), F.col("intent"))
                           + params.lambda_2 * F.coalesce("bm25", F.lit(0.0)))
        beam = top_k(
            reached.join(lexical, QUERY + ["id"], "left").withColumn("strength", strength),
            QUERY, [F.desc("strength"), F.asc("from_pos"), F.asc("edge_seq")], params.beam_width, "pos")
        frontier = settle(beam.select(*QUERY, "id", F.lit(hop).alias("hop"), "pos", "intent"), f"beam-{hop}")
        # within a hop the best-placed copy of a node is the one that counts
        first = frontier.groupBy(*QUERY, "id", "hop", "intent").agg(F.min("pos").alias("pos"))
        found = found.unionByName(frontier if beams else first)
    return found


def graph_tier(seeds: DataFrame, edges: DataFrame, entries: DataFrame, index: Index, weights: DataFrame,
               now: Column, k: int, params: Params = DEFAULTS,
               scorer: Scorer = default_scorer) -> DataFrame:
    """Seeds plus discoveries, rescored; entries without a lexical match drop out."""
    found = settle(expand(seeds, edges, entries, index, weights, params), "found")
    lexical = score_pairs(index, weights, found, params)
    attributes = entries.select("chat_id", "id", *ATTRIBUTES)
    scored = (
        found.join(lexical, QUERY + ["id"], "left")
        .withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
        .join(attributes, ["chat_id", "id"])
        .withColumn("score", scorer(now, params))
        .filter(F.col("score") > 0)
    )
    return top_k(scored, QUERY, [F.desc("score"), F.asc("hop"), F.asc("pos")], k)


def prepend_working(results: DataFrame, working: DataFrame) -> DataFrame:
    """Working-buffer entries first, results after them without repeats.

    ``results(chat_id, query_id, id, rank, bm25, score, tier)`` and
    ``working(chat_id, id, pos)`` with positions from 1; a query that found
    nothing still receives the buffer, so pass its row through ``results`` keys.
    """
    keys = results.select(*QUERY, "tier").distinct()
    buffered = keys.join(working, "chat_id").select(
        *QUERY, "id", F.lit(0).alias("block"), F.col("pos").alias("rank"),
        F.lit(0.0).alias("bm25"), F.lit(float("inf")).alias("score"), "tier")
    rest = (
        results.filter(F.col("id").isNotNull())
        .join(working.select("chat_id", "id"), ["chat_id", "id"], "left_anti")
        .select(*QUERY, "id", F.lit(1).alias("block"), "rank", "bm25", "score", "tier"))
    return top_k(buffered.unionByName(rest), QUERY, [F.asc("block"), F.asc("rank")],
                 2**31 - 1, "position").drop("block", "rank").withColumnRenamed("position", "rank")


def ladder(entries: DataFrame, edges: DataFrame, queries: DataFrame, now: Column, k: int,
           params: Params = DEFAULTS, scorer: Scorer = default_scorer,
           index: Index | None = None, working: DataFrame | None = None,
           caches=None) -> DataFrame:
    """Resolve ``queries(chat_id, query_id, query)`` against one snapshot.

    Caches (see :mod:`rememora.operators.caches`) answer first, then the graph
    tier fed by BM25 candidates, then the floor. Columns:
    ``chat_id, query_id, rank, id, tier, bm25, score``.
    """
    shape = [*QUERY, "id", "rank", "bm25", "score", "tier"]
    resolved = []
    if caches is not None:
        hits = caches.lookup(queries, entries, params)
        resolved.append(hits.select(*shape))
        queries = settle(queries.join(hits.select(*QUERY).distinct(), QUERY, "left_anti"), "misses")
    index = index or build_index(long_term(entries), params)
    weights = weigh_terms(index, queries)
    ranked = candidates(index, weights, entries, now, params)
    intents = queries.select(*QUERY, intent(F.col("query")).alias("intent"))
    seeds = settle(
        ranked.filter(F.col("rank") <= params.seeds_k)
        .select(*QUERY, "id", F.col("rank").alias("pos")).join(intents, QUERY), "seeds")
    graph = settle(graph_tier(seeds, edges, entries, index, weights, now, k, params, scorer), "graph-tier")
    resolved.append(graph.withColumn("tier", F.lit("3")).select(*shape))
    rest = queries.select(*QUERY).join(graph.select(*QUERY).distinct(), QUERY, "left_anti")
    fallback = floor(entries, now, k, params).withColumn("bm25", F.lit(0.0))
    # a chat without a single long-term entry keeps its key row, with a null id
    resolved.append(rest.join(fallback, "chat_id", "left").withColumn("tier", F.lit("floor")).select(*shape))
    out = resolved[0]
    for part in resolved[1:]:
        out = out.unionByName(part)
    if working is not None:
        return prepend_working(out, working).select(*shape)
    return out.filter(F.col("id").isNotNull())
