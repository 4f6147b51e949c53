"""Parameter sweeps and the decisions drawn from them.

Points of a sweep are few (the grid), so windows over points are small; what
is large, the runs behind the points, is always aggregated by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import product

from pyspark.sql import Column, DataFrame, Window, functions as F

from rememora.operators.positions import Rule, at_floor_n1, order_statistics
from rememora.params import DEFAULTS, Params

# --- fixed values of the decision rules ---
ELBOW_RATIO = 0.1
FLAT_AXIS = 0.005
MIN_MRR_GAIN = 0.02
MAX_COVERAGE_DROP = 0.05
INVARIANT_SLACK = 0.02


def grid(knobs: dict[str, Iterable]) -> list[dict]:
    """Every combination of the knob values, first knob slowest."""
    names = list(knobs)
    return [dict(zip(names, values)) for values in product(*knobs.values())]


def grid_sweep(knobs: dict[str, Iterable], evaluate: Callable[[Params], DataFrame],
               base: Params = DEFAULTS) -> DataFrame:
    """One plan over all grid points: the result of each, labelled with its knobs."""
    out = None
    for point in grid(knobs):
        part = evaluate(base.override(**point))
        for name, value in point.items():
            part = part.withColumn(name, F.lit(value))
        out = part if out is None else out.unionByName(part)
    return out


def slopes(points: DataFrame, primary: str, metric: str, secondary: list[str]) -> DataFrame:
    """Change of the metric per unit of the knob to the next point of the slice."""
    order = Window.partitionBy(*secondary).orderBy(primary)
    step = F.lead(primary).over(order) - F.col(primary)
    rise = F.lead(metric).over(order) - F.col(metric)
    return points.withColumn("slope", F.when(step == 0, 0.0).otherwise(rise / step))


def elbow(points: DataFrame, primary: str, metric: str, secondary: list[str] | None = None,
          defaults: dict | None = None) -> DataFrame:
    """The point where gains flatten: one row with the knobs, metric and rationale.

    Per slice, the first point whose slope to the next is at most a tenth of the
    steepest one; slices that never rise by FLAT_AXIS have none. The best elbow
    over the slices wins, then (flat axis) the defaults, then the best point.
    """
    secondary = secondary or []
    knobs = [primary, *secondary]
    sloped = slopes(points, primary, metric, secondary)
    whole_slice = Window.partitionBy(*secondary)
    steepest = F.max(F.abs("slope")).over(whole_slice)
    flat_enough = F.abs("slope") <= ELBOW_RATIO * F.col("steepest") + 1e-12
    found = (
        sloped.withColumn("steepest", steepest)
        .filter((F.col("steepest") >= FLAT_AXIS) & flat_enough)
        .withColumn("place", F.row_number().over(Window.partitionBy(*secondary).orderBy(primary)))
        .filter("place = 1")
        .select(*knobs, metric, F.lit(1).alias("preference"), F.lit("elbow").alias("rationale")))
    # without an elbow the whole axis decides, all slices in one order
    key = F.struct(F.col(metric), (-F.col(primary)).alias("p"), *secondary)
    axis = slopes(points, primary, metric, []).agg(
        F.max_by(F.struct(*knobs, metric), key).alias("top"),
        (F.coalesce(F.max(F.abs("slope")), F.lit(0.0)) < FLAT_AXIS).alias("flat"))
    fallback = axis.select("top.*", F.lit(2).alias("preference"),
                           F.when(F.col("flat"), "flat axis").otherwise("best point").alias("rationale"))
    if defaults:
        for k in knobs:
            fallback = fallback.withColumn(k, F.when(F.col("rationale") == "flat axis", F.lit(defaults[k])).otherwise(F.col(k)))
    return (found.unionByName(fallback)
            .orderBy("preference", F.desc(metric), *secondary, primary).limit(1).drop("preference"))


def amendment(baseline_mrr: Column, baseline_coverage: Column, mrr: Column, coverage: Column) -> Column:
    """Verdict on a candidate: it must gain MRR without losing coverage."""
    gain, drop = mrr - baseline_mrr, coverage - baseline_coverage
    return (F.when(gain.isNull() | drop.isNull() | F.isnan(gain) | F.isnan(drop), "hold: not comparable")
            .when(gain < MIN_MRR_GAIN, "hold: gain too small")
            .when(drop < -MAX_COVERAGE_DROP, "hold: coverage falls")
            .otherwise("amend"))


def structural_invariant(scores: DataFrame, ours: str = "ladder", lexical: str = "bm25only") -> DataFrame:
    """The ladder must not fall behind its own candidate stage."""
    pivot = scores.agg(
        F.max(F.when(F.col("retriever") == ours, F.col("mrr"))).alias("ours"),
        F.max(F.when(F.col("retriever") == lexical, F.col("mrr"))).alias("lexical"))
    delta = F.col("ours") - F.col("lexical")
    return pivot.select(delta.alias("delta"), F.when(delta.isNull(), "N/A")
                        .when(delta >= -INVARIANT_SLACK, "PASS").otherwise("FAIL").alias("verdict"))


STAT_COLUMNS = ["added", "updated", "drained", "batches", "parse_failures", "entries_skipped"]


def consolidation_rates(runs: DataFrame, by: list[str]) -> DataFrame:
    """Totals over distinct conversations (a run row repeats its conversation's stats), and rates."""
    per_chat = runs.groupBy(*by, "conversation_id").agg(*[F.first(c, True).alias(c) for c in STAT_COLUMNS])
    totals = per_chat.groupBy(*by).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in STAT_COLUMNS])

    def rate(part, whole):
        return F.col(part) / F.greatest(F.lit(1), whole)

    facts = F.col("added") + F.col("updated")
    return (totals.withColumn("update_rate", rate("updated", facts))
            .withColumn("dedup_hit_rate", rate("updated", F.col("drained")))
            .withColumn("parse_fail_rate", rate("parse_failures", F.col("batches")))
            .withColumn("entry_skip_rate", rate("entries_skipped", facts + F.col("entries_skipped"))))


def weighted_rollup(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells to one row per key; MRR weighs by scored questions, unscored cells do not count."""
    usable = (F.col("n_scored") > 0) & F.col("mrr").isNotNull() & ~F.isnan("mrr")
    facts = F.sum("updated") + F.sum("added")
    return cells.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("n_scored").alias("n_scored"), F.sum("n_skipped").alias("n_skipped"),
        F.try_divide(F.sum("n_scored"), F.sum("n")).alias("coverage"),
        F.try_divide(F.sum(F.when(usable, F.col("mrr") * F.col("n_scored"))),
                     F.sum(F.when(usable, F.col("n_scored")))).alias("mrr"),
        F.coalesce(F.try_divide(F.sum("updated"), facts), F.lit(0.0)).alias("update_rate"))


def merge_chunks(runs: DataFrame, cell: list[str], chunk: str) -> DataFrame:
    """A sweep cell from the runs of its chunks: recomputed, never averaged; wall time is the slowest chunk."""
    base = runs.groupBy(*cell).agg(F.count("*").alias("n"), F.count("mrr").alias("n_scored"), F.avg("mrr").alias("mrr"))
    latency = order_statistics(runs, cell, "latency_ms", {"p50": at_floor_n1(0.5), "p95": at_floor_n1(0.95)}).drop("n")
    walls = runs.groupBy(*cell, chunk).agg(F.sum("latency_ms").alias("w")).groupBy(*cell).agg(F.max("w").alias("wall_ms"))
    return base.join(latency, cell).join(walls, cell)


def stratified_sample(items: DataFrame, stratum: str, item: str, n: int, seed: int) -> DataFrame:
    """n items, round-robin over strata, each stratum in a seeded hash order.

    A stratum offers at most n items, so each task passes on n rows per stratum.
    """
    draw = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(stratum), F.col(item).cast("string")), 256)
    order = Window.partitionBy(stratum).orderBy(draw, item)
    turn = items.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= n)
    return turn.orderBy("turn", stratum).limit(n)


def chunk_size(corpus: int, chunks: int = 0) -> tuple[int, int]:
    """Number of chunks and items per chunk for a corpus of that size."""
    n_chunks = chunks if chunks > 0 else max(1, corpus // 80)
    return n_chunks, -(-corpus // n_chunks)


def chunk_plan(items: DataFrame, position: str, corpus: int, cells: int, chunks: int = 0) -> DataFrame:
    """Chunks of the corpus for each grid cell: ``(cell, chunk, first, last, n_items)``."""
    _, size = chunk_size(corpus, chunks)
    cut = items.groupBy(F.floor(F.col(position) / size).alias("chunk")).agg(
        F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n_items"))
    return cut.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell"), "*")


def coordinate_descent(rounds: list[tuple[str, list]], evaluate: Callable[[Params], float],
                       base: Params = DEFAULTS, repeats: int = 1) -> tuple[Params, list[dict]]:
    """Tune knob by knob, keeping the best value of each before the next.

    ``evaluate`` runs one Spark job and returns the metric; only that number
    comes back to the driver.
    """
    history = []
    for _ in range(repeats):
        for knob, values in rounds:
            points = [(value, evaluate(base.override(**{knob: value}))) for value in values]
            best = max(points, key=lambda p: (p[1] == p[1], p[1] if p[1] == p[1] else 0.0))
            base = base.override(**{knob: best[0]})
            history.append({"knob": knob, "points": points, "winner": best[0]})
    return base, history


def elbow_of(points: list[tuple[float, float]]) -> float:
    """The knob value at the elbow of a few ``(value, metric)`` points, else the value of the highest metric."""
    points = sorted(points)
    rises = [(b[1] - a[1]) / (b[0] - a[0]) if b[0] != a[0] else 0.0 for a, b in zip(points, points[1:])]
    limit = ELBOW_RATIO * max(map(abs, rises), default=0.0) + 1e-12
    flat = [p[0] for p, rise in zip(points, rises) if abs(rise) <= limit]
    return flat[0] if flat else max(points, key=lambda p: (p[1], -p[0]))[0]


def pinned_descent(rounds: list[tuple[str, list]], evaluate: Callable[[list[Params]], list[float]],
                   base: Params = DEFAULTS) -> tuple[Params, list[dict]]:
    """Tune knob by knob, pinning each at its elbow before the next.

    ``evaluate`` gets all points of a round at once, so that they share one pass, and returns their metric;
    a point of an earlier round is not asked again.
    """
    known: dict[Params, float] = {}
    history = []
    for knob, values in rounds:
        points = [base.override(**{knob: value}) for value in values]
        new = [p for p in dict.fromkeys(points) if p not in known]
        if new:
            known.update(zip(new, evaluate(new)))
        scored = [(value, known[p]) for value, p in zip(values, points)]
        winner = elbow_of(scored)
        base = base.override(**{knob: winner})
        history.append({"knob": knob, "points": scored, "winner": winner, "asked": len(new)})
    return base, history


def _between(p: float) -> tuple[Rule, Rule]:
    return (lambda n: F.floor((n - 1) * F.lit(p)), lambda n: F.ceil((n - 1) * F.lit(p)))


def quantile(df: DataFrame, keys: list[str], value: str, p: float, name: str) -> DataFrame:
    """Linearly interpolated quantile per key."""
    low, high = _between(p)
    picked = order_statistics(df, keys, value, {"lo": low, "hi": high})
    share = (F.col("n") - 1) * F.lit(p) - F.floor((F.col("n") - 1) * F.lit(p))
    return picked.select(*keys, (F.col("lo") + (F.col("hi") - F.col("lo")) * share).alias(name))


def outliers_above_fence(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Upper fence Q3 + 1.5 IQR per key and how many values exceed it."""
    fences = quantile(df, keys, value, 0.25, "q1").join(quantile(df, keys, value, 0.75, "q3"), keys)
    fences = fences.withColumn("fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    return df.join(fences, keys).groupBy(*keys, "q1", "q3", "fence").agg(
        F.count_if(F.col(value) > F.col("fence")).alias("n_outliers"))


def fact_lengths(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Median, 95th percentile and greatest length of the extracted facts, in characters."""
    return order_statistics(facts.withColumn("__length", F.length("content")), keys, "__length", {
        "p50": at_floor_n1(0.5), "p95": at_floor_n1(0.95), "longest": lambda n: n - 1})
