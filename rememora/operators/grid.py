"""The retrieval ladder at many grid points in one pass.

Index, candidates, edges, lexical scores and priors do not depend on the swept knobs, so they are joined
once. A row of the beam walk carries arrays with one place and one strength per grid point; only the cut
to the beam, which every task makes before the shuffle, looks at the points one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from rememora.functions.text import intent
from rememora.operators.bm25 import Index, build_index, score_pairs, weigh_terms
from rememora.operators.ranking import rounded, top_k
from rememora.operators.scoring import Scorer, default_scorer
from rememora.operators.tiers import ATTRIBUTES, QUERY, candidates, edge_affinity, floor, long_term
from rememora.params import Params
from rememora.session import settle

SWEPT = ("lambda_1", "lambda_2", "seeds_k", "beam_width", "edge_cap", "max_hops")
# the points a row belongs to are the bits of one long; larger grids run as several passes
POINTS_PER_PASS = 60


def _knob(points: list[Params], name: str) -> Column:
    return F.array(*(F.lit(getattr(p, name)) for p in points))


def _each(n: int, value: Callable[[Column], Column]) -> Column:
    """An array with ``value(p)`` for each point p."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), value)


def _bits(n: int) -> Column:
    return F.array(*(F.lit(1 << p).cast("long") for p in range(n)))


def widest(points: list[Params]) -> Params:
    """The parameters whose edges hold those of every point; all other knobs must agree."""
    first = points[0]
    for p in points:
        if replace(first, **{name: getattr(p, name) for name in SWEPT}) != p:
            raise ValueError(f"one pass sweeps {', '.join(SWEPT)} only")
    return replace(first, edge_cap=max(p.edge_cap for p in points))


def walk(seeds: DataFrame, edges: DataFrame, entries: DataFrame, index: Index, weights: DataFrame,
         points: list[Params]) -> DataFrame:
    """Beam walks of all points: ``(chat_id, query_id, id, hop, pos)``, ``pos`` an array of places (null: not in that beam).

    ``seeds(chat_id, query_id, id, rank, intent)``; ``edges`` are those of the largest cap, ``kept`` their place under it.
    """
    n, bits = len(points), _bits(len(points))
    cap, hops, beam = _knob(points, "edge_cap"), _knob(points, "max_hops"), _knob(points, "beam_width")
    lambda_1, lambda_2, seeds_k = _knob(points, "lambda_1"), _knob(points, "lambda_2"), _knob(points, "seeds_k")
    pool = long_term(entries).select("chat_id", "id")
    links = edges.select("chat_id", F.col("from_id").alias("id"), F.col("to_id").alias("to"), "type", F.col("seq").alias("edge_seq"), "kept")

    def member(pos: str) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0).cast("long"), lambda acc, p: acc.bitwiseOR(
            F.when(F.get(F.col(pos), p).isNotNull(), F.get(bits, p)).otherwise(F.lit(0).cast("long"))))

    frontier = seeds.select(*QUERY, "id", "intent", _each(n, lambda p: F.when(F.col("rank") <= F.get(seeds_k, p), F.col("rank").cast("int"))).alias("pos"))
    frontier = settle(frontier, "points-0")
    found = frontier.withColumn("hop", F.lit(0))
    for hop in range(1, max(p.max_hops for p in points) + 1):
        seen = found.select(*QUERY, F.col("id").alias("to"), member("pos").alias("m")).groupBy(*QUERY, "to").agg(F.bit_or("m").alias("seen"))
        reached = (
            frontier.join(links, ["chat_id", "id"]).join(seen, [*QUERY, "to"], "left")
            .withColumn("from_pos", _each(n, lambda p: F.when(
                (F.col("kept") <= F.get(cap, p)) & (F.lit(hop) <= F.get(hops, p))
                & (F.coalesce("seen", F.lit(0)).bitwiseAND(F.get(bits, p)) == 0), F.get("pos", p))))
            .filter(F.exists("from_pos", lambda x: x.isNotNull()))
            .select(*QUERY, F.col("to").alias("id"), "type", "intent", "from_pos", "edge_seq")
            .join(pool, ["chat_id", "id"], "left_semi")
            .withColumn("row", F.monotonically_increasing_id()))
        reached = settle(reached, f"points-reached-{hop}")
        lexical = score_pairs(index, weights, reached, points[0])
        strength = lambda p: rounded(
            F.get(lambda_1, p) * edge_affinity(F.col("type"), F.col("intent")) + F.get(lambda_2, p) * F.coalesce("bm25", F.lit(0.0)))
        rivals = reached.join(lexical, [*QUERY, "id"], "left").select(
            *QUERY, "id", "intent", "row", "edge_seq", F.explode(F.filter(
                _each(n, lambda p: F.struct(p.alias("point"), F.get("from_pos", p).alias("from_pos"), strength(p).alias("strength"))),
                lambda x: x["from_pos"].isNotNull())).alias("at"))
        rivals = rivals.select(*QUERY, "id", "intent", "row", "edge_seq", "at.*")
        best = top_k(rivals, [*QUERY, "point"], [F.desc("strength"), F.asc("from_pos"), F.asc("edge_seq")],
                     max(p.beam_width for p in points), "place").filter(F.col("place") <= F.get(beam, F.col("point")))
        placed = best.groupBy(*QUERY, "id", "intent", "row").agg(
            F.map_from_entries(F.collect_list(F.struct("point", F.col("place").cast("int")))).alias("places"))
        frontier = settle(placed.select(*QUERY, "id", "intent", _each(n, lambda p: F.try_element_at("places", p)).alias("pos")), f"points-{hop}")
        found = found.unionByName(frontier.withColumn("hop", F.lit(hop)))
    return found.select(*QUERY, "id", "hop", "pos")


def _pass(entries: DataFrame, edges: DataFrame, asked: DataFrame, ranked: DataFrame, fallback: DataFrame, index: Index, weights: DataFrame,
          now: Column, k: int, points: list[Params], first: int, scorer: Scorer) -> DataFrame:
    seeds = ranked.filter(F.col("rank") <= max(p.seeds_k for p in points)).join(asked, QUERY)
    found = settle(walk(seeds, edges, entries, index, weights, points), "points-found")
    scored = (
        found.join(score_pairs(index, weights, found, points[0]), [*QUERY, "id"])
        .join(entries.select("chat_id", "id", *ATTRIBUTES), ["chat_id", "id"])
        .withColumn("score", scorer(now, points[0])).filter(F.col("score") > 0)
        .select(*QUERY, "id", "hop", "bm25", "score", F.posexplode("pos").alias("p", "pos")).filter(F.col("pos").isNotNull()))
    # of a node's places in one beam the best one counts
    single = scored.groupBy(*QUERY, "p", "id", "bm25", "score").agg(F.min(F.struct("hop", "pos")).alias("at"))
    point = (F.col("p") + first).alias("point")
    graph = settle(top_k(single, [*QUERY, "p"], [F.desc("score"), F.asc("at")], k).select(*QUERY, point, "rank", "id", F.lit("3").alias("tier"), "bm25", "score"), "points-graph")
    every = asked.select(*QUERY, F.explode(F.sequence(F.lit(first), F.lit(first + len(points) - 1))).alias("point"))
    rest = every.join(graph.select(*QUERY, "point").distinct(), [*QUERY, "point"], "left_anti").join(fallback, "chat_id")
    return graph.unionByName(rest.select(*QUERY, "point", "rank", "id", F.lit("floor").alias("tier"), F.lit(0.0).alias("bm25"), "score"))


def ladder_points(entries: DataFrame, edges: DataFrame, queries: DataFrame, now: Column, k: int, points: list[Params],
                  scorer: Scorer = default_scorer, index: Index | None = None) -> DataFrame:
    """``(chat_id, query_id, point, rank, id, tier, bm25, score)``: the ladder of every point, numbered from 0.

    ``edges`` come from ``build_edges(entries, widest(points), ranked=True)``. Caches hold answers of one
    parameter set, so a sweep has none.
    """
    base = widest(points)
    index = index or build_index(long_term(entries), base)
    weights = weigh_terms(index, queries)
    ranked = settle(candidates(index, weights, entries, now, base), "points-candidates").select(*QUERY, "id", "rank")
    asked = settle(queries.select(*QUERY, intent(F.col("query")).alias("intent")), "points-queries")
    edges, fallback = settle(edges, "points-edges"), floor(entries, now, k, base)
    out = None
    for begin in range(0, len(points), POINTS_PER_PASS):
        part = _pass(entries, edges, asked, ranked, fallback, index, weights, now, k, points[begin:begin + POINTS_PER_PASS], begin, scorer)
        out = part if out is None else out.unionByName(part)
    return out
