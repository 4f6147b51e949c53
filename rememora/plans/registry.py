"""Every runnable query by name: ``(spark, folder) -> DataFrame``."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from rememora.functions import lifecycle, text, vectors
from rememora.operators import (
    baselines, bm25, caches, communities, consolidate, dedup, graph, metrics, model_client, neighbors, numbering,
    persona, positions, scoring, tiers, upkeep, viewer,
)
from rememora.params import DEFAULTS
from rememora.plans import evaluation, runs, sweeps, tables
from rememora.session import scratch_path, settle, settle_bucketed
from rememora.sources import corpora, extraction_cache, runs as run_files, state, traces as trace_files
from rememora.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


# --- text and ranking over documents ------------------------------------------

@query
def tokenize_term_freq(spark, folder):
    docs = tables.spread(tables.load(spark, folder, "documents").select("doc_id", "text"))
    counted = docs.select("doc_id", F.explode(text.term_frequencies(text.tokens(F.col("text")))).alias("p"))
    return counted.select("doc_id", "p.term", "p.tf")


@query
def bm25_topk(spark, folder):
    index = bm25.build_index(tiers.long_term(tables.entries(spark, folder)))
    found = bm25.search(index, tables.queries(spark, folder), 10)
    return found.select("chat_id", "query_id", F.col("rank").cast("long").alias("rank"), "id", r6("bm25"))


@query
def baseline_bm25only(spark, folder):
    found = baselines.lexical_only(tables.entries(spark, folder), tables.queries(spark, folder), 5)
    return found.select("chat_id", "query_id", F.col("rank").cast("long").alias("rank"), "id", r6("bm25"))


def _candidates(spark, folder, factors=False):
    entries = tables.entries(spark, folder)
    index = bm25.build_index(tiers.long_term(entries))
    weights = bm25.weigh_terms(index, tables.queries(spark, folder))
    return entries, index, weights, tiers.candidates(index, weights, entries, tables.now(), factors=factors)


@query
def tier2_rescored(spark, folder):
    ranked = _candidates(spark, folder)[3]
    return ranked.select("chat_id", "query_id", F.col("rank").cast("long").alias("rank"), "id",
                         r6("bm25"), r6("score"))


@query
def tier2_factors(spark, folder):
    ranked = _candidates(spark, folder, factors=True)[3]
    return ranked.select("chat_id", "query_id", "id", "importance", r6("importance_factor"),
                         r6("recency_factor"), "maturity_factor")


@query
def floor_topk(spark, folder):
    best = tiers.floor(tables.entries(spark, folder), tables.now(), 5)
    return best.select("chat_id", F.col("rank").cast("long").alias("rank"), "id", r6("score"))


@query
def baseline_recency(spark, folder):
    entries = tables.entries(spark, folder)
    found = baselines.most_recent(entries, tables.queries(spark, folder), 5, updated="created_at")
    return found.select("chat_id", "query_id", F.col("rank").cast("long").alias("rank"), "id")


@query
def baseline_random(spark, folder):
    return baselines.seeded_random(tables.entries(spark, folder), tables.queries(spark, folder), 5)


@query
def intent_classify(spark, folder):
    turns = tables.load(spark, folder, "conversations")
    return turns.select("conv_id", "turn", text.intent(F.col("text")).alias("intent"))


@query
def entity_extract(spark, folder):
    docs = tables.spread(tables.load(spark, folder, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.explode(text.entities(F.col("text"))).alias("entity"))


# --- graph and ladder -----------------------------------------------------------

@query
def cooccurrence_edges_capped(spark, folder):
    return graph.build_edges(tables.entries(spark, folder))


@query
def graph_degree(spark, folder):
    degree = graph.out_degree(graph.build_edges(tables.entries(spark, folder)))
    return degree.select("chat_id", "from_id", "degree", r6("total_weight"))


def _edges(entries):
    """The stored edge table: written once, read by every hop."""
    return settle(graph.build_edges(entries), "edges")


def _expanded(spark, folder):
    entries, index, weights, ranked = _candidates(spark, folder)
    intents = tables.queries(spark, folder).select(
        "chat_id", "query_id", text.intent(F.col("query")).alias("intent"))
    seeds = ranked.filter(F.col("rank") <= 3).select(
        "chat_id", "query_id", "id", F.col("rank").alias("pos")).join(intents, ["chat_id", "query_id"])
    return entries, seeds, index, weights


@query
def tier3_hop1(spark, folder):
    entries, seeds, index, weights = _expanded(spark, folder)
    one = tiers.expand(seeds, _edges(entries), entries, index, weights,
                       tiers.DEFAULTS.override(max_hops=1), beams=True)
    return one.filter(F.col("hop") == 1).select(
        "chat_id", "query_id", "id", F.col("pos").cast("long").alias("pos"))


@query
def tier3_hop2(spark, folder):
    entries, seeds, index, weights = _expanded(spark, folder)
    found = tiers.expand(seeds, _edges(entries), entries, index, weights)
    return found.select("chat_id", "query_id", "id", "hop", F.col("pos").cast("long").alias("pos"))


@query
def ladder_snapshot(spark, folder):
    entries = tables.entries(spark, folder)
    found = tiers.ladder(entries, _edges(entries), tables.queries(spark, folder), tables.now(), 5)
    return found.select("chat_id", "query_id", F.col("rank").cast("long").alias("rank"), "id", "tier",
                        r6("bm25"), r6("score"))


# --- write path -------------------------------------------------------------------

@query
def batch_chunks(spark, folder):
    cut = consolidate.batches(tables.turns(spark, folder))
    return cut.select("chat_id", "batch", F.size("messages").cast("long").alias("n_messages"), "fired_at",
                      F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"))


@query
def rule_extract_facts(spark, folder):
    facts = consolidate.fact_entries(
        consolidate.extract_by_rules(consolidate.batches(tables.turns(spark, folder))), tables.now())
    return facts.select("chat_id", "batch", "id", "seq", "content", "subject",
                        F.array_join("tags", ",").alias("tags"),
                        F.array_join(F.col("source_messages").cast("array<string>"), ",").alias("sources"))


@query
def consolidated_entries(spark, folder):
    entries = consolidate.remember(tables.turns(spark, folder), tables.now())[0]
    return entries.select("chat_id", "id", "seq", "content", "subject", "importance", "update_count")


@query
def consolidate_incremental(spark, folder):
    """The first batches of each chat, then the others against the stored entries."""
    batched = consolidate.extract_by_rules(consolidate.batches(tables.turns(spark, folder)))
    extracted = settle(batched, "extracted")
    stored = settle(consolidate.consolidate(extracted.filter("batch < 3"), tables.now())[0], "stored")
    entries = consolidate.consolidate(extracted.filter("batch >= 3"), tables.now(), stored=stored)[0]
    return entries.select("chat_id", "id", "seq", "content", "subject", "importance", "update_count")


@query
def consolidation_report(spark, folder):
    _, _, fates, extracted = consolidate.remember(tables.turns(spark, folder), tables.now())
    return consolidate.batch_report(extracted, fates)


@query
def dedup_fold(spark, folder):
    facts = tables.entries(spark, folder).select("chat_id", "subject", "seq", "content")
    return dedup.fold_duplicates(facts).select("chat_id", "seq", "target_seq")


@query
def find_duplicate(spark, folder):
    facts = settle(tables.entries(spark, folder).select("chat_id", "subject", "seq", "content"), "facts")
    kept = settle(dedup.fold_duplicates(facts).filter("target_seq = seq AND subject IS NOT NULL").select(
        "chat_id", "subject", F.col("seq").alias("b")).distinct(), "kept")
    toks = F.sort_array(text.token_set(F.col("content"))).alias("toks")
    sets = settle_bucketed(facts.filter(F.col("subject").isNotNull()).select("chat_id", "subject", F.col("seq").alias("a"), toks),
                           "token_sets", ["chat_id", "subject", "a"])
    found = dedup.find_duplicates(
        sets, sets.withColumnRenamed("a", "b").join(kept, ["chat_id", "subject", "b"], "left_semi"), 0.7)
    return found.select("chat_id", "subject", "a", "b", r6("similarity"))


# --- evaluation over conversations ------------------------------------------------

def _run(spark, folder, *retrievers):
    turns = tables.turns(spark, folder)
    memory = evaluation.seed(turns, tables.now())
    qa = settle(evaluation.questions(turns), "questions")
    return memory, qa, [evaluation.run(memory, qa, r, tables.now()) for r in retrievers]


def _scores(spark, folder):
    memory, qa, (found,) = _run(spark, folder, "ladder")
    return metrics.per_query(settle(evaluation.with_sources(found, memory), "retrieved"), qa)


@query
def conversation_ladder(spark, folder):
    _, _, (found,) = _run(spark, folder, "ladder")
    return found.select("chat_id", "query_id", "rank", "id", "tier", r6("bm25"), r6("score"))


@query
def gold_match(spark, folder):
    memory, qa, (found,) = _run(spark, folder, "ladder")
    marked = metrics.match_gold(evaluation.with_sources(found, memory), qa)
    return marked.select("chat_id", "query_id", "rank", "id", "matched")


@query
def gold_match_legacy(spark, folder):
    memory, qa, (found,) = _run(spark, folder, "bm25only")
    turns = tables.turns(spark, folder).select("chat_id", F.col("turn").cast("long").alias("turn"), "text")
    gold = qa.select("chat_id", "query_id", F.explode("evidence").alias("turn")).join(turns, ["chat_id", "turn"])
    texts = found.join(memory.entries.select("chat_id", "id", "content"), ["chat_id", "id"])
    return metrics.match_gold_by_text(texts, gold)


METRIC_COLUMNS = ["coverage", "mrr", *[f"{m}_{k}" for m in ("precision", "recall") for k in (1, 3, 5, 10)]]


@query
def ir_metrics(spark, folder):
    total = metrics.summarize(_scores(spark, folder))
    return total.select("n", "n_scored", "n_skipped", "abstentions", *[r6(c) for c in METRIC_COLUMNS])


@query
def ir_metrics_by_type(spark, folder):
    sliced = metrics.by_task_type(_scores(spark, folder))
    return sliced.select("task_type", "n_scored", "n_skipped", r6("mrr"), r6("coverage"))


@query
def baseline_comparison(spark, folder):
    memory, qa, found = _run(spark, folder, "ladder", "bm25only", "recency")
    parts = []
    for name, rows in zip(("ladder", "bm25only", "recency"), found):
        scores = metrics.per_query(settle(evaluation.with_sources(rows, memory), name), qa)
        parts.append(metrics.summarize(scores.withColumn("retriever", F.lit(name)), ["retriever"]))
    joined = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return joined.select("retriever", "n", "n_scored", r6("coverage"), r6("mrr"), r6("recall_5"))


@query
def rank_alignment_full_join(spark, folder):
    _, _, (ours, lexical) = _run(spark, folder, "ladder", "bm25only")
    return runs.align_ranks(ours, lexical)


# --- caches and upkeep --------------------------------------------------------------

@query
def exact_cache_key(spark, folder):
    turns = tables.load(spark, folder, "conversations")
    return turns.select("conv_id", "turn", text.exact_key(F.col("text")).alias("key"))


@query
def token_set_key(spark, folder):
    docs = tables.spread(tables.load(spark, folder, "documents").select("doc_id", "text"))
    return docs.select("doc_id", text.token_key(F.col("text")).alias("key"))


def _asked_documents(spark, folder):
    docs = tables.spread(tables.load(spark, folder, "documents").select("doc_id", "lang", "text"))
    return docs.select(F.col("lang").alias("chat_id"), F.col("doc_id").alias("query_id"), F.col("text").alias("query"))


def _document_cache(asked, writes):
    answers = asked.select("chat_id", "query", F.array(F.col("query_id").cast("string")).alias("ids"),
                           F.col("query_id").alias("written"))
    rows = writes(answers)
    return caches.record(rows.limit(0), rows)


@query
def fuzzy_cache_match(spark, folder):
    asked = _asked_documents(spark, folder)
    hits = caches.fuzzy_hits(_document_cache(asked, caches.fuzzy_writes), asked)
    return hits.select("chat_id", "query_id", F.get("ids", F.lit(0)).alias("cached_id"), r6("similarity"))


@query
def exact_cache_match(spark, folder):
    asked = _asked_documents(spark, folder)
    hits = caches.exact_hits(_document_cache(asked, caches.exact_writes), asked)
    return hits.select("chat_id", "query_id", F.get("ids", F.lit(0)).alias("cached_id"))


def _event_writes(spark, folder):
    return tables.load(spark, folder, "events").select(
        F.col("event_type").alias("chat_id"),
        F.concat_ws("-", F.col("user_id"), F.get_json_object("props", "$.k")).alias("key"),
        F.array(F.col("event_id").cast("string")).alias("ids"), F.col("event_id").alias("written"))


@query
def cache_evict_topn(spark, folder):
    writes = _event_writes(spark, folder)
    kept = caches.record(writes.limit(0), writes)
    return kept.select("chat_id", "key", "written")


@query
def ladder_with_caches(spark, folder):
    entries = tables.entries(spark, folder)
    asked = tables.queries(spark, folder).withColumn("written", F.col("query_id"))
    edges = _edges(entries)
    first = settle(tiers.ladder(entries, edges, asked, tables.now(), 5), "first-pass")
    empty = asked.select("chat_id", F.lit("").alias("key"), F.array("chat_id").alias("ids"), "written").limit(0)
    warm = caches.Caches(empty, empty).updated(asked, first)
    again = tiers.ladder(entries, edges, asked.drop("written"), tables.now(), 5, caches=warm)
    return again.select("chat_id", "query_id", F.col("rank").cast("long").alias("rank"), "id", "tier")


@query
def working_prepend(spark, folder):
    entries = tables.entries(spark, folder)
    buffer = entries.filter("scope = 'working'").select(
        "chat_id", "id", F.lit(1).alias("one"), F.col("seq"))
    buffer = tiers.top_k(buffer, ["chat_id"], [F.desc("seq")], 5, "pos").select("chat_id", "id", "pos")
    best = tiers.floor(entries, tables.now(), 5)
    asked = tables.queries(spark, folder).select("chat_id", "query_id")
    found = asked.join(best, "chat_id").select(
        "chat_id", "query_id", "id", "rank", F.lit(0.0).alias("bm25"), "score", F.lit("floor").alias("tier"))
    return tiers.prepend_working(found, buffer).select(
        "chat_id", "query_id", F.col("rank").cast("long").alias("rank"), "id")


def _user_entries(spark, folder):
    """One entry per event user, the earliest event giving its birth."""
    events = tables.load(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.groupBy("user_id").agg(F.min("ts").alias("created_at")).select(
        F.lit("users").alias("chat_id"), F.col("user_id").cast("string").alias("id"),
        F.lit(20.0).alias("importance"), "created_at", F.col("created_at").alias("updated_at"),
        F.lit(0).cast("long").alias("access_count"), F.lit(0).cast("long").alias("update_count"))


def _lifecycle_events(spark, folder, kinds):
    events = tables.load(spark, folder, "events").filter(F.col("event_type").isin(*kinds))
    return events.select(F.lit("users").alias("chat_id"), F.col("user_id").cast("string").alias("id"),
                         F.when(F.col("event_type") == "purchase", "update").otherwise("access").alias("kind"),
                         F.col("ts").cast("timestamp").alias("at"))


@query
def access_bump(spark, folder):
    out = upkeep.apply_events(_user_entries(spark, folder), _lifecycle_events(spark, folder, ["view"]))
    return out.select("id", "importance", "access_count")


@query
def update_bump(spark, folder):
    out = upkeep.apply_events(_user_entries(spark, folder), _lifecycle_events(spark, folder, ["purchase", "click"]))
    return out.select("id", "importance", "access_count", "update_count",
                      F.unix_micros("updated_at").alias("updated_us"))


@query
def lifecycle_bump_all(spark, folder):
    """Every event of every user: purchases update, all others are accesses."""
    kinds = ["view", "click", "purchase", "signup", "error"]
    out = upkeep.apply_events(_user_entries(spark, folder), _lifecycle_events(spark, folder, kinds))
    return out.select("id", "importance", "access_count", "update_count", F.unix_micros("updated_at").alias("updated_us"))


@query
def daily_decay(spark, folder):
    entries = tables.entries(spark, folder)
    days = (F.unix_timestamp(tables.now()) - F.unix_timestamp("created_at")) / 86400
    return entries.select("chat_id", "id", F.round(
        lifecycle.decayed(F.col("importance"), days), 6).alias("importance"))


@query
def maturity_transition(spark, folder):
    entries = tables.entries(spark, folder)
    gained = F.least(F.lit(100.0), F.col("importance") + F.length("content") % 40)
    return entries.select("chat_id", "id", "maturity",
                          lifecycle.next_maturity(gained, F.col("maturity")).alias("next"))


@query
def trace_ring(spark, folder):
    traces = tables.load(spark, folder, "events").select(
        F.col("event_type").alias("chat_id"), F.col("event_id").alias("seq"), F.col("value"))
    return upkeep.ring(traces)


@query
def scrub_deleted(spark, folder):
    turns = tables.load(spark, folder, "conversations")
    buffer = turns.select(F.col("conv_id").alias("chat_id"), F.concat_ws(":", "conv_id", "turn").alias("id"),
                          F.array(F.col("turn").cast("long")).alias("source_messages"))
    errors = tables.load(spark, folder, "events").filter(F.col("event_type") == "error").select(
        F.col("user_id").alias("chat_id"), F.get_json_object("props", "$.k").cast("long").alias("message"))
    return upkeep.scrub(buffer, errors.distinct()).select("chat_id", "id")


@query
def last_user_query(spark, folder):
    return upkeep.last_user_query(tables.turns(spark, folder)).select("chat_id", "turn", "query")


@query
def memory_block(spark, folder):
    entries = tables.entries(spark, folder)
    best = tiers.floor(entries, tables.now(), 3)
    asked = tables.queries(spark, folder).select("chat_id", "query_id")
    return upkeep.memory_block(asked.join(best, "chat_id"), entries)


@query
def entry_validate(spark, folder):
    docs = tables.spread(tables.load(spark, folder, "documents"))
    stamp = tables.now()
    raw = docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("source") == "src0", "elsewhere").otherwise("episodic").alias("scope"),
        F.col("text").alias("content"), F.array("source").alias("tags"),
        F.array(F.struct(F.when(F.col("lang") == "es", "unknown").otherwise("supports").alias("type"),
                         F.col("source").alias("target"))).alias("relations"),
        (F.col("n_chars") / 50).alias("importance"), F.lit("draft").alias("maturity"),
        stamp.alias("created_at"), stamp.alias("updated_at"), F.lit(0).alias("access_count"),
        F.lit(0).alias("update_count"), F.array("doc_id").alias("source_messages"), F.lit("x").alias("extractor"))
    return raw.select("id", upkeep.valid_entry().alias("valid"))


@query
def tags_populated(spark, folder):
    facts = consolidate.fact_entries(
        consolidate.extract_by_rules(consolidate.batches(tables.turns(spark, folder))), tables.now())
    return upkeep.tagged_share(facts).select("chat_id", r6("tagged"))


# --- viewer --------------------------------------------------------------------------

@query
def viewer_grouped_limit(spark, folder):
    page = viewer.grouped_page(tables.entries(spark, folder))
    return page.select("label", "chat_id", "id", "importance")


@query
def viewer_subject_counts(spark, folder):
    return viewer.subject_counts(tables.entries(spark, folder))


@query
def viewer_graph_page(spark, folder):
    page = viewer.graph_page(_edges(tables.entries(spark, folder)))
    return page.select("chat_id", "from_id", "to_id", "degree", F.col("place").cast("long").alias("place"))


@query
def viewer_subject_filter(spark, folder):
    entries = tables.entries(spark, folder)
    return entries.filter(viewer.subject_contains("an")).select("chat_id", "id", "subject")


@query
def trace_labels(spark, folder):
    events = tables.load(spark, folder, "events")
    tier = (F.when(F.col("event_type") == "view", "0").when(F.col("event_type") == "click", "2")
            .when(F.col("event_type") == "signup", "floor").otherwise(F.col("event_type")))
    return events.select("event_id", viewer.tier_label(tier).alias("label"),
                         viewer.shown_time(F.col("ts")).alias("shown"),
                         viewer.clipped(F.col("props"), 8).alias("props"))


# --- run, trace and sweep analytics ----------------------------------------------------

def _calls(spark, folder):
    """Events as traced calls."""
    return tables.load(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("tier"), F.col("value").alias("lat_ms"),
        F.get_json_object("props", "$.k").cast("long").alias("query_len"), "user_id")


@query
def latency_percentiles_floor(spark, folder):
    rules = {"p50_n1": positions.at_floor_n1(0.5), "p95_n1": positions.at_floor_n1(0.95),
             "p50_n": positions.at_floor_n(0.5), "p95_n": positions.at_floor_n(0.95)}
    return positions.order_statistics(_calls(spark, folder), ["tier"], "lat_ms", rules)


@query
def trace_latency_stats(spark, folder):
    stats = runs.latency_stats(_calls(spark, folder), ["tier"])
    return stats.select("tier", "n", "p50", "p95", "p99", "min", "max", r6("mean"), r6("std"))


@query
def tier_distribution(spark, folder):
    return runs.tier_distribution(_calls(spark, folder)).select("tier", "count", r6("pct"))


@query
def pearson_len_latency(spark, folder):
    return runs.length_latency_correlation(_calls(spark, folder), ["tier"]).select("tier", "n", r6("r"), "reading")


@query
def slowest_calls(spark, folder):
    return runs.extremes(_calls(spark, folder), 20).select("id", "tier", "lat_ms")


@query
def fastest_calls(spark, folder):
    return runs.extremes(_calls(spark, folder), 20, slowest=False).select("id", "tier", "lat_ms")


@query
def trace_enrichment(spark, folder):
    calls = _calls(spark, folder).select("id", F.concat_ws(" ", "tier", "query_len").alias("query"), "lat_ms")
    purchases = tables.load(spark, folder, "events").filter("event_type = 'purchase'")
    answers = purchases.groupBy(F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k")).alias("query")).agg(
        F.max("value").alias("answer"))
    return runs.enrich(calls, answers).select("id", "query", "lat_ms", "answer")


@query
def trace_enrichment_all(spark, folder):
    """Answers from the events of every type."""
    calls = _calls(spark, folder).select("id", F.concat_ws(" ", "tier", "query_len").alias("query"), "lat_ms")
    answers = tables.load(spark, folder, "events").groupBy(
        F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k")).alias("query")).agg(F.max("value").alias("answer"))
    return runs.enrich(calls, answers).select("id", "query", "lat_ms", "answer")


@query
def run_mode_summary(spark, folder):
    rows = _calls(spark, folder).select(
        F.col("user_id").alias("run"), F.col("lat_ms").alias("top_score"), F.col("tier").alias("top_tier"),
        F.lit("default").alias("scorer_id"), F.lit("unknown").alias("git_sha"))
    return runs.run_summary(rows).select("run", "n_calls", r6("top_score_mean"), "top_tier_mode", "scorer_id")


def _points(spark, folder, *keys):
    items = tables.load(spark, folder, "lineitem")
    return items.groupBy(*keys).agg(
        (F.avg("l_quantity") / 50).alias("mrr"), (F.avg("l_tax") * 10).alias("coverage"), F.count("*").alias("n"))


@query
def sweep_summary(spark, folder):
    rows = _points(spark, folder, "l_returnflag", "l_linestatus", "l_discount").select(
        F.col("l_returnflag").alias("sweep_name"), F.col("l_linestatus").alias("knob"), "mrr", "coverage")
    return runs.sweep_summary(rows).select(
        "sweep_name", "knob", "n_points", r6("mrr_min"), r6("mrr_max"), r6("mrr_span"), r6("coverage_mean"))


@query
def sweep_diff(spark, folder):
    rows = _points(spark, folder, "l_returnflag", "l_linenumber", "l_discount").select(
        "l_linenumber", F.col("l_returnflag").alias("knob"), F.col("l_discount").alias("value"), "mrr", "coverage")
    diff = runs.sweep_diff(rows.filter("l_linenumber = 1"), rows.filter("l_linenumber = 2"))
    return diff.select("knob", "value", r6("delta_mrr"), r6("delta_coverage"))


@query
def sweep_diff_all(spark, folder):
    """Every line number against the next one."""
    rows = _points(spark, folder, "l_returnflag", "l_linenumber", "l_discount")

    def as_file(shift):
        pair = (F.col("l_linenumber") - shift).cast("string")
        return rows.select(F.concat_ws("/", "l_returnflag", pair).alias("knob"), F.col("l_discount").alias("value"), "mrr", "coverage")

    return runs.sweep_diff(as_file(0), as_file(1)).select("knob", "value", r6("delta_mrr"), r6("delta_coverage"))


@query
def elbow(spark, folder):
    points = _points(spark, folder, "l_returnflag", "l_discount").select("l_returnflag", "l_discount", "mrr")
    chosen = sweeps.elbow(points, "l_discount", "mrr", ["l_returnflag"], {"l_discount": 0.0, "l_returnflag": "A"})
    return chosen.select("l_discount", "l_returnflag", r6("mrr"), "rationale")


@query
def amendment_gate(spark, folder):
    points = _points(spark, folder, "l_returnflag", "l_linenumber", "l_discount")
    base = points.filter("l_discount = 0").select(
        "l_returnflag", "l_linenumber", F.col("mrr").alias("mrr0"), F.col("coverage").alias("coverage0"))
    verdict = sweeps.amendment(F.col("mrr0"), F.col("coverage0"), F.col("mrr"), F.col("coverage"))
    return points.join(base, ["l_returnflag", "l_linenumber"]).select(
        "l_returnflag", "l_linenumber", "l_discount", verdict.alias("verdict"))


@query
def structural_invariant(spark, folder):
    scores = _points(spark, folder, "l_returnflag").select(
        F.when(F.col("l_returnflag") == "R", "ladder").when(F.col("l_returnflag") == "A", "bm25only")
        .otherwise("random").alias("retriever"), "mrr")
    return sweeps.structural_invariant(scores).select(r6("delta"), "verdict")


@query
def consolidation_rates(spark, folder):
    orders = tables.load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("conversation_id"), F.col("o_orderstatus").alias("sweep"),
        F.floor(F.col("o_totalprice") / 1000).alias("added"), (F.col("o_custkey") % 7).alias("updated"),
        F.floor(F.col("o_totalprice") / 500).alias("drained"), (F.col("o_custkey") % 11).alias("batches"),
        (F.col("o_custkey") % 2).alias("parse_failures"), (F.col("o_custkey") % 3).alias("entries_skipped"))
    items = tables.load(spark, folder, "lineitem").select(F.col("l_orderkey").alias("conversation_id"))
    rates = sweeps.consolidation_rates(items.join(orders, "conversation_id"), ["sweep"])
    return rates.select("sweep", *sweeps.STAT_COLUMNS, r6("update_rate"), r6("dedup_hit_rate"),
                        r6("parse_fail_rate"), r6("entry_skip_rate"))


@query
def consolidation_rates_all(spark, folder):
    """All orders as conversations, those without items as runs that repeat nothing."""
    orders = tables.load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("conversation_id"), F.col("o_orderstatus").alias("sweep"),
        F.floor(F.col("o_totalprice") / 1000).alias("added"), (F.col("o_custkey") % 7).alias("updated"),
        F.floor(F.col("o_totalprice") / 500).alias("drained"), (F.col("o_custkey") % 11).alias("batches"),
        (F.col("o_custkey") % 2).alias("parse_failures"), (F.col("o_custkey") % 3).alias("entries_skipped"))
    items = tables.load(spark, folder, "lineitem").select(F.col("l_orderkey").alias("conversation_id"))
    rates = sweeps.consolidation_rates(orders.join(items, "conversation_id", "left"), ["sweep"])
    return rates.select("sweep", *sweeps.STAT_COLUMNS, r6("update_rate"), r6("dedup_hit_rate"),
                        r6("parse_fail_rate"), r6("entry_skip_rate"))


@query
def weighted_mrr_rollup(spark, folder):
    scored = F.when(F.col("l_linestatus") == "F", F.col("l_discount"))
    cells = tables.load(spark, folder, "lineitem").groupBy("l_linenumber", "l_returnflag").agg(
        F.count("*").alias("n"), F.count(scored).alias("n_scored"),
        (F.count("*") - F.count(scored)).alias("n_skipped"), F.avg(scored).alias("mrr"),
        F.count_if(F.col("l_tax") > 0.04).alias("updated"), F.count_if(F.col("l_tax") <= 0.04).alias("added"))
    rolled = sweeps.weighted_rollup(cells, ["l_linenumber"])
    return rolled.select("l_linenumber", "n", "n_scored", "n_skipped", r6("coverage"), r6("mrr"), r6("update_rate"))


@query
def chunk_merge(spark, folder):
    rows = tables.load(spark, folder, "lineitem").select(
        "l_returnflag", "l_linenumber", F.when(F.col("l_linestatus") == "F", F.col("l_discount")).alias("mrr"),
        F.col("l_extendedprice").alias("latency_ms"))
    merged = sweeps.merge_chunks(rows, ["l_returnflag"], "l_linenumber")
    return merged.select("l_returnflag", "n", "n_scored", r6("mrr"), "p50", "p95",
                         F.round("wall_ms", 2).alias("wall_ms"))


@query
def stratified_sample(spark, folder):
    docs = tables.load(spark, folder, "documents").select("doc_id", "lang")
    return sweeps.stratified_sample(docs, "lang", "doc_id", 100, 7).select("lang", "doc_id")


@query
def chunk_plan(spark, folder):
    docs = tables.load(spark, folder, "documents").select("doc_id", F.lit("corpus").alias("corpus"))
    placed = numbering.number_rows(docs, "corpus", "doc_id", "place")
    return sweeps.chunk_plan(placed, "place", docs.count(), cells=3)


@query
def grid_sweep(spark, folder):
    entries = tables.entries(spark, folder)
    postings = settle(entries.select("chat_id", "id", "seq", "scope", "content"), "grid-entries")

    def evaluate(params):
        return graph.build_edges(postings, params).groupBy("chat_id").agg(
            F.count("*").alias("n_edges"), F.countDistinct("from_id").alias("n_sources"))

    return sweeps.grid_sweep({"edge_cap": [5, 10, 20]}, evaluate)


SWEEP_KNOBS = {"lambda_1": [0.5, 1.0, 2.0], "seeds_k": [1, 3], "beam_width": [2, 5], "edge_cap": [2, 20]}
DESCENT = [("lambda_1", [0.5, 1.0, 1.5]), ("beam_width", [1, 3, 5]), ("edge_cap", [2, 5, 20])]


def _sweep(spark, folder):
    """Metrics of any grid points over one memory of all conversations."""
    turns = tables.turns(spark, folder)
    memory = evaluation.seed(turns, tables.now())
    qa = settle(evaluation.questions(turns), "questions")
    return lambda points: evaluation.sweep(memory, qa, points, tables.now())


def _grid_points():
    return [DEFAULTS.override(**p) for p in sweeps.grid(SWEEP_KNOBS)]


@query
def ladder_sweep(spark, folder):
    """The whole ladder on conversations at every grid point, in one pass over shared candidates."""
    swept = _sweep(spark, folder)(_grid_points())
    return swept.select(*SWEEP_KNOBS, "n", "n_scored", *[r6(c) for c in METRIC_COLUMNS])


@query
def ladder_elbow(spark, folder):
    """The elbow of the intent weight over the slices of the other knobs."""
    swept = settle(_sweep(spark, folder)(_grid_points()).select(*SWEEP_KNOBS, r6("mrr")), "swept-points")
    others = [k for k in SWEEP_KNOBS if k != "lambda_1"]
    chosen = sweeps.elbow(swept, "lambda_1", "mrr", others, {k: getattr(DEFAULTS, k) for k in SWEEP_KNOBS})
    return chosen.select(*SWEEP_KNOBS, r6("mrr"), "rationale")


@query
def ladder_descent(spark, folder):
    """Coordinate descent: every round is one pass, its knob is pinned at the elbow."""
    swept = _sweep(spark, folder)

    def evaluate(points):
        found = {r["point"]: r["mrr"] for r in swept(points).select("point", r6("mrr")).collect()}  # one row per point
        return [found[i] if found[i] is not None else 0.0 for i in range(len(points))]

    _, history = sweeps.pinned_descent(DESCENT, evaluate)
    rows = [(i, h["knob"], float(value), metric, value == h["winner"]) for i, h in enumerate(history) for value, metric in h["points"]]
    return spark.createDataFrame(rows, "round int, knob string, value double, mrr double, pinned boolean")


@query
def spearman_price_key(spark, folder):
    orders = tables.load(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("grp"), "o_totalprice", F.col("o_custkey").cast("double").alias("c"))
    ranked = positions.average_ranks(orders, ["grp"], "o_totalprice", "ra")
    ranked = positions.average_ranks(ranked, ["grp"], "c", "rb")
    return ranked.groupBy("grp").agg(F.round(F.corr("ra", "rb"), 6).alias("rho"))


@query
def outlier_fence(spark, folder):
    fenced = sweeps.outliers_above_fence(_calls(spark, folder), ["tier"], "lat_ms")
    return fenced.select("tier", r6("q1"), r6("q3"), r6("fence"), "n_outliers")


@query
def half_means(spark, folder):
    calls = numbering.number_rows(_calls(spark, folder), "tier", "id", "place")
    sizes = calls.groupBy("tier").agg(F.count("*").alias("n"))
    first = F.col("place") < F.floor(F.col("n") / 2)
    return calls.join(sizes, "tier").groupBy("tier").agg(
        F.round(F.avg(F.when(first, F.col("lat_ms"))), 6).alias("first_half"),
        F.round(F.avg(F.when(~first, F.col("lat_ms"))), 6).alias("second_half"))


@query
def state_digest(spark, folder):
    facts = consolidate.fact_entries(
        consolidate.extract_by_rules(consolidate.batches(tables.turns(spark, folder))), tables.now())
    return evaluation.digest(facts)


# --- vectors, communities, persona ----------------------------------------------------

def _vectors(spark, folder, per_label=True):
    """Embeddings, unit length, keyed by label or all under one key."""
    raw = tables.load(spark, folder, "embeddings")
    key = F.col("label").cast("string") if per_label else F.lit("all")
    vec = vectors.unit(F.col("embedding").cast("array<double>"))
    return raw.select(key.alias("key"), F.col("vec_id").alias("id"), F.col("vec_id").alias("seq"), vec.alias("vec"))


@query
def knn_topk(spark, folder):
    near = neighbors.nearest(_vectors(spark, folder), 15)
    return near.select("key", "qid", "id", F.col("rank").cast("long").alias("rank"), r6("similarity"))


@query
def knn_global(spark, folder):
    near = neighbors.nearest(_vectors(spark, folder, per_label=False), 5, block=128)
    return near.select("qid", "id", F.col("rank").cast("long").alias("rank"), r6("similarity"))


def _graph(spark, folder):
    near = neighbors.nearest(_vectors(spark, folder, per_label=False), 15)
    return settle(neighbors.symmetric(near), "knn-graph")


@query
def knn_symmetric(spark, folder):
    return _graph(spark, folder).select("a", "b", r6("w"))


@query
def knn_degree(spark, folder):
    return neighbors.node_degree(_graph(spark, folder)).select("node", r6("degree"))


def _labelled_nodes(spark, folder, edges):
    labels = tables.load(spark, folder, "embeddings").select(F.col("vec_id").alias("node"), F.col("label").alias("given"))
    nodes = labels.withColumn("key", F.lit("all"))
    return communities.start(edges, nodes).drop("comm").join(labels, "node").withColumnRenamed("given", "comm")


@query
def modularity(spark, folder):
    edges = _graph(spark, folder)
    return communities.modularity(edges, _labelled_nodes(spark, folder, edges), 1.0).select("key", r6("q"))


@query
def community_stats(spark, folder):
    edges = _graph(spark, folder)
    stats = communities.community_stats(edges, _labelled_nodes(spark, folder, edges))
    return stats.select("comm", r6("inside"), r6("total"))


@query
def leiden(spark, folder):
    edges = _graph(spark, folder)
    nodes = tables.load(spark, folder, "embeddings").select(F.lit("all").alias("key"), F.col("vec_id").alias("node"))
    return communities.leiden(edges, nodes, 1.0).select("node", "community")


@query
def leiden_invariants(spark, folder):
    """The communities of all vectors as the counts of what a sound partition has none of."""
    edges = _graph(spark, folder)
    nodes = tables.load(spark, folder, "embeddings").select(F.lit("all").alias("key"), F.col("vec_id").alias("node"))
    seats = settle(communities.leiden(edges, nodes, 1.0), "communities")
    return communities.partition_faults(edges, nodes, seats, 1.0).select(
        "nodes", (F.col("communities") > 1).alias("several"), "unplaced", "repeated", "misnamed", "split", "worse")


@query
def cosine_to_label_mean(spark, folder):
    vecs = _vectors(spark, folder)
    mean = vecs.select("key", F.posexplode("vec").alias("i", "x")).groupBy("key", "i").agg(F.avg("x").alias("m"))
    # one value per dimension: 64 per label
    centre = mean.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("c"))
    centre = centre.select("key", vectors.unit(F.col("c")).alias("c"))
    return vecs.join(centre, "key").select("id", F.round(vectors.cosine(F.col("vec"), F.col("c")), 6).alias("cosine"))


@query
def hashed_embeddings(spark, folder):
    turns = tables.load(spark, folder, "conversations")
    vec = turns.select("conv_id", "turn", vectors.hashed_embedding(F.col("text")).alias("v"))
    return vec.select("conv_id", "turn", F.posexplode("v").alias("dim", "x")).select(
        "conv_id", "turn", "dim", F.round("x", 6).alias("x"))


@query
def persona_rebuild(spark, folder):
    summaries, origins = persona.rebuild(tables.entries(spark, folder).filter("scope = 'episodic'"))
    counted = origins.groupBy("chat_id", "subject", "depth", "leaf").agg(F.count("*").alias("n_facts"))
    return summaries.join(counted, ["chat_id", "subject", "depth", "leaf"]).select(
        "chat_id", "subject", "depth", "leaf", "text", "n_facts")


@query
def persona_invariants(spark, folder):
    """Per subject: facts that the rebuild's highest layer leaves out or holds twice, and summaries without facts."""
    entries = tables.entries(spark, folder)
    return persona.rebuild_faults(entries, *persona.rebuild(entries.filter("scope = 'episodic'")))


@query
def persona_replace(spark, folder):
    entries = tables.entries(spark, folder)
    facts = entries.filter("scope = 'episodic' AND subject IS NOT NULL").withColumn("text", F.col("content"))
    texts = facts.groupBy("chat_id", "subject").agg(persona.longest_text().alias("content"), F.min("seq").alias("seq"))
    fresh = texts.select("chat_id", "subject", "content", "seq", F.lit("persona").alias("scope"),
                         F.concat(F.lit("p"), "seq").alias("id"))
    swapped = persona.replace_persona(entries, fresh)
    return swapped.filter("scope = 'persona'").select("chat_id", "subject", "id", "content")


# --- sources over files that Spark derives from the tables -----------------------------

def _blocks(spark, folder):
    """Conversations cut into samples of 64 turns with sessions of two turns."""
    turns = tables.turns(spark, folder)
    session = (F.floor(F.col("turn") % 64 / 2) + 1).cast("string")
    return turns.select(
        F.concat_ws("-", "chat_id", F.floor(F.col("turn") / 64)).alias("sample_id"), session.alias("session"),
        "turn", "role", "text")


def _written_json(df, label):
    path = scratch_path(df.sparkSession, label)
    df.write.json(path)
    return path


def _locomo(spark, folder):
    rows = _blocks(spark, folder)
    ref = (F.when(F.col("turn") % 3 == 0, F.concat(F.lit("D"), "session", F.lit(":"), F.col("turn") % 2 + 1))
           .when(F.col("turn") % 3 == 1, F.concat(F.lit("x S"), "session", F.lit(":T"), F.col("turn") % 2)).otherwise("D"))
    sessions = rows.groupBy("sample_id", "session").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))),
                    lambda t: F.struct(t["role"].alias("speaker"), t["text"].alias("text"))).alias("turns"))
    talks = sessions.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(
        F.struct(F.concat(F.lit("session_"), "session"), "turns"))).alias("conversation"))
    asked = rows.filter("role = 'user'").groupBy("sample_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("turn", "text", ref.alias("ref")))),
        lambda q: F.struct(q["text"].alias("question"), F.lit("?").alias("answer"),
                           F.array(q["ref"]).alias("evidence"), F.lit("1").alias("category"))).alias("qa"))
    path = _written_json(talks.join(asked, "sample_id", "left"), "locomo")
    return corpora.get_adapter("locomo")(spark, path, lines=True)


@query
def locomo_turns(spark, folder):
    return _locomo(spark, folder)[0]


@query
def locomo_evidence(spark, folder):
    qa = _locomo(spark, folder)[1]
    return qa.select("chat_id", "query_id", "query",
                     F.array_join(F.col("evidence").cast("array<string>"), ",").alias("evidence"))


def _longmem(spark, folder):
    rows = _blocks(spark, folder)
    marked = (F.col("role") == "assistant") & (F.length("text") % 2 == 0)
    sessions = rows.groupBy("sample_id", "session").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text", marked.alias("m")))),
                    lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"),
                                       F.when(t["m"], F.lit(True)).alias("has_answer"))).alias("turns"))
    items = sessions.groupBy("sample_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("session").cast("int").alias("n"), "session", "turns"))).alias("s"))
    out = items.select(
        F.concat("sample_id", F.when(F.size("s") == 1, "_abs").otherwise("")).alias("question_id"),
        F.lit("what?").alias("question"), F.lit("that").alias("answer"), F.lit("multi-session").alias("question_type"),
        F.transform("s", lambda x: x["session"]).alias("haystack_session_ids"),
        F.array(F.lit("1")).alias("answer_session_ids"), F.transform("s", lambda x: x["turns"]).alias("haystack_sessions"))
    return corpora.get_adapter("longmemeval")(spark, _written_json(out, "longmem"), lines=True)


@query
def longmemeval_turns(spark, folder):
    return _longmem(spark, folder)[0]


@query
def longmemeval_evidence(spark, folder):
    qa = _longmem(spark, folder)[1]
    return qa.select("chat_id", "task_type", "abstention",
                     F.array_join(F.col("evidence").cast("array<string>"), ",").alias("evidence"))


@query
def run_source(spark, folder):
    events = tables.load(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("conversationId"),
        F.struct(F.col("props").alias("question"), F.lit("").alias("answer"), F.col("event_type").alias("category")).alias("qa"),
        F.when(F.col("event_type") == "error", F.array().cast("array<struct<id:string,score:double,tier:string>>")).otherwise(
            F.array(F.struct(F.col("event_id").cast("string").alias("id"), F.col("value").alias("score"),
                             F.col("event_type").alias("tier")))).alias("retrieved"))
    rows = run_files.load_runs(spark, _written_json(events, "runs"), pattern="*.json")
    return rows.select("conversation_id", "question", "category", "n_retrieved", "top_id", "top_score", "top_tier")


@query
def batch_result_ingest(spark, folder):
    turns = tables.load(spark, folder, "conversations")
    name = F.concat_ws("-", "conv_id", "turn")
    line = F.to_json(F.struct(
        F.when(F.col("turn") % 5 == 4, F.concat(F.lit("../"), name)).otherwise(name).alias("custom_id"),
        F.struct(F.when(F.col("role") == "system", 500).otherwise(200).alias("status_code"),
                 F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"),
                                  F.when(F.length("text") % 7 == 0, "length").otherwise("stop").alias("finish_reason"))
                         ).alias("choices")).alias("response")))
    lines = turns.select(F.when(F.col("turn") == 3, F.substring(line, 1, 9)).otherwise(line).alias("value"))
    path = scratch_path(spark, "batch-results")
    lines.write.text(path)
    return extraction_cache.load_results(spark, path).select("key", "reason", F.length("answer").alias("n_chars"))


@query
def warmup_batches(spark, folder):
    return extraction_cache.enumerate_batches(tables.turns(spark, folder), "model-a").select("chat_id", "batch", "key")


@query
def extraction_cache_split(spark, folder):
    requests = extraction_cache.enumerate_batches(tables.turns(spark, folder), "model-a")
    cache = requests.filter(F.col("batch") == 0).select("key", F.lit("{}").alias("answer"))
    known, missing = extraction_cache.split_by_cache(requests, cache)
    return known.select("chat_id", "batch", F.lit(True).alias("cached")).unionByName(
        missing.select("chat_id", "batch", F.lit(False).alias("cached")))


@query
def extraction_validate(spark, folder):
    cut = settle(consolidate.batches(tables.turns(spark, folder)), "batches")
    first = F.get("messages", F.lit(0))["content"]
    item = F.struct(first.alias("content"), F.when(F.col("batch") == 0, "someone").alias("subject"),
                    F.array(F.lit("tag")).alias("tags"))
    bad = F.struct(F.lit("").alias("content"), F.lit("x").alias("subject"), F.array(F.lit("tag")).alias("tags"))
    body = F.to_json(F.struct(F.array(item, bad).alias("entries")))
    answer = (F.when(F.col("chat_id") % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
              .when(F.col("chat_id") % 4 == 1, F.substring(body, 1, 12)).when(F.col("chat_id") % 4 == 2, "[1]").otherwise(body))
    judged = consolidate.extract_by_answers(cut, cut.select("chat_id", "batch", answer.alias("answer")))
    return judged.select("chat_id", "batch", "status", F.size("facts").cast("long").alias("n_facts"), "skipped",
                         F.get("facts", F.lit(0))["content"].alias("content"))


@query
def extraction_validate_all(spark, folder):
    """Every message of a batch as an item of the answer, with an unusable item between any two."""
    cut = settle(consolidate.batches(tables.turns(spark, folder)), "batches")
    bad = F.struct(F.lit("").alias("content"), F.lit("x").alias("subject"), F.array(F.lit("tag")).alias("tags"))
    items = F.flatten(F.transform("messages", lambda m: F.array(
        F.struct(m["content"].alias("content"), F.lit("someone").alias("subject"), F.array(F.lit("tag")).alias("tags")), bad)))
    answers = cut.select("chat_id", "batch", F.to_json(F.struct(items.alias("entries"))).alias("answer"))
    judged = consolidate.extract_by_answers(cut, answers)
    return judged.select("chat_id", "batch", "status", F.size("facts").cast("long").alias("n_facts"), "skipped",
                         F.aggregate("facts", F.lit(0).cast("long"), lambda n, f: n + F.length(f["content"])).alias("n_chars"))


def fake_model(system: str, user: str) -> str:
    """A deterministic client: by a digit of the prompt's digest it answers, fails once or twice, always or for good."""
    digit = hashlib.sha256(user.encode()).hexdigest()[0]
    failures = fake_model.calls.get(user, 0)
    if digit in "01" or (digit == "2" and failures < 1) or (digit == "3" and failures < 2):
        fake_model.calls[user] = failures + 1
        raise model_client.CallFailed("busy", 503) if digit in "02" else ConnectionError("reset")
    fake_model.calls.pop(user, None)
    if digit == "4":
        raise model_client.CallFailed("quota", 429)
    if digit == "5":
        return None
    if digit == "6":
        return "not json"
    content = user.split("\n")[1]
    return json.dumps({"entries": [{"content": content, "subject": digit, "tags": []}, {"content": ""}]})


fake_model.calls = {}
NO_WAIT = model_client.CallPolicy(sleep=lambda s: None)


@query
def model_answers(spark, folder):
    """Every batch of the conversations through a client that fails by the prompt's digest."""
    asked = model_client.ask(consolidate.batches(tables.turns(spark, folder)), fake_model, NO_WAIT)
    return asked.select("chat_id", "batch", F.col("answer").isNotNull().alias("answered"), "error", "attempts", "waited_ms")


@query
def model_write_path(spark, folder):
    """Facts, drained and returned batches per chat when calls fail: what lies behind a failed batch waits."""
    cut = settle(consolidate.batches(tables.turns(spark, folder)), "batches")
    extracted, returned = model_client.extract_by_model(cut, fake_model, NO_WAIT)
    drained = extracted.groupBy("chat_id").agg(
        F.count("*").alias("drained"), F.sum(F.size("facts")).alias("facts"), F.sum("skipped").alias("skipped"),
        F.count_if(F.col("status") == "parse_failure").alias("parse_failures"))
    back = model_client.back_to_buffer(returned).groupBy("chat_id").agg(
        F.count("*").alias("returned_turns"), F.sum(F.length("text")).alias("returned_chars"))
    errors = returned.groupBy("chat_id").agg(F.count("error").alias("failed_calls"), F.min("batch").alias("first_returned"))
    names = ["drained", "facts", "skipped", "parse_failures", "returned_turns", "returned_chars", "failed_calls"]
    whole = cut.select("chat_id").distinct().join(drained, "chat_id", "left").join(back, "chat_id", "left").join(errors, "chat_id", "left")
    return whole.select("chat_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names], "first_returned")


@query
def traced_calls(spark, folder):
    events = tables.load(spark, folder, "events")
    ts = F.col("ts").cast("timestamp")
    inputs = (F.when(F.col("event_type") == "view", F.to_json(F.struct(F.col("props").alias("queryStr"))))
              .when(F.col("event_type") == "click", F.to_json(F.struct(F.array(F.lit("s"), F.col("props")).alias("args"))))
              .when(F.col("event_type") == "error", F.to_json(F.struct(F.lit("").alias("arg1"), F.col("props").alias("q"))))
              .otherwise(F.to_json(F.struct(F.concat("props", F.lit("long")).alias("x"), F.col("props").alias("y")))))
    raw = events.select(
        F.col("event_id").alias("id"), F.lit("svc:///a/op/retrieve:1").alias("op_name"), ts.alias("started_at"),
        F.when(F.col("event_type") != "signup", F.timestamp_micros(
            F.unix_micros(ts) + F.round(F.col("value") * 1000).cast("long"))).alias("ended_at"),
        inputs.alias("inputs"), F.to_json(F.struct(F.col("event_type").alias("tierResolved"))).alias("output"))
    return trace_files.calls(raw, "retrieve").select("id", r6("lat_ms"), "tier", "query", "query_len")


@query
def state_roundtrip(spark, folder):
    stamp = tables.now()
    rows = tables.entries(spark, folder).withColumns({
        "relations": F.array().cast("array<struct<type:string,target:string>>"), "updated_at": stamp,
        "access_count": F.lit(0).cast("long"), "update_count": F.lit(0).cast("long"),
        "source_messages": F.array(F.col("seq")), "extractor": F.lit("x")})
    store = state.Store(state.ParquetBackend(spark, scratch_path(spark, "state")))
    store.persist("entries", rows)
    # a second write of one chat replaces that chat only
    store.persist("entries", settle(store.load("entries", ["fr"]).withColumn("importance", F.lit(1.0)), "one-chat"))
    return store.load("entries").select("chat_id", "id", "seq", "scope", "importance",
                                        F.unix_timestamp("created_at").alias("created_s"))


@query
def state_deltas(spark, folder):
    """Entries of many chats through deltas, a refused write from an old version, emptied chats and a compaction."""
    stamp, n = tables.now(), F.floor(F.col("seq") / 5)
    rows = tables.entries(spark, folder).withColumns({
        "chat_id": F.concat(F.lit("c"), n.cast("string")),
        "relations": F.array().cast("array<struct<type:string,target:string>>"), "updated_at": stamp,
        "access_count": F.lit(0).cast("long"), "update_count": F.lit(0).cast("long"),
        "source_messages": F.array(F.col("seq")), "extractor": F.lit("x")})
    backend = state.BucketBackend(spark, scratch_path(spark, "deltas"), buckets=16)
    marked = lambda every, value: backend.read("entries").filter(n % every == 0).withColumn("importance", F.lit(value))
    first = backend.write("entries", rows)
    backend.write("entries", marked(3, 1.0), at=first)
    try:
        backend.write("entries", marked(1, 2.0), at=first)
        refused = 0
    except state.Conflict:
        refused = 1
    kept = marked(9, 3.0)  # as stored before the next write empties some of these chats
    backend.write("entries", rows.filter("false"), chats=rows.filter(n % 6 == 0))
    backend.compact("entries")
    backend.write("entries", kept)
    return state.Store(backend).load("entries").select("chat_id", "id", "seq", "importance", F.lit(refused).alias("refused"))


# --- live path -------------------------------------------------------------------------

@query
def stream_buffer(spark, folder):
    stream = tables.stream(spark, folder, "conversations").select(
        F.col("conv_id").alias("chat_id"), F.col("turn").cast("long").alias("seq"), F.lit("message").alias("op"),
        F.col("turn").cast("long").alias("turn"), "role", "text")
    fired = live.drain(live.fired_batches(stream, tiers.DEFAULTS.override(buffer_threshold=4, batch_size=2)), "fired")
    return fired.select("chat_id", "fire", "reason", F.array_join(F.col("turns").cast("array<string>"), ",").alias("turns"))


@query
def stream_cache_routing(spark, folder):
    stream = tables.stream(spark, folder, "events").select(
        F.col("user_id").alias("chat_id"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "write").otherwise("query").alias("op"),
        F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k")).alias("query"), F.lit("3").alias("tier"),
        F.array(F.col("event_id").cast("string")).alias("ids"))
    routed = live.drain(live.routed_queries(stream, tiers.DEFAULTS.override(cache_cap=1000)), "routed")
    return routed.select("chat_id", "seq", "tier", F.get("ids", F.lit(0)).alias("first_id"))


@query
def stream_cache_evict(spark, folder):
    """Caches at the default cap: about a thousand events a chat and up to 500 keys, so the oldest fall out."""
    k = F.get_json_object("props", "$.k")
    stream = tables.stream(spark, folder, "events").select(
        F.floor(F.col("user_id") / 15).alias("chat_id"), F.col("event_id").alias("seq"),
        F.when((F.col("event_type") == "error") & (k == "0"), "write").otherwise("query").alias("op"),
        F.concat_ws(" k", "event_type", k).alias("query"), F.lit("3").alias("tier"),
        F.array(F.col("event_id").cast("string")).alias("ids"))
    routed = live.drain(live.routed_queries(stream), "evicted")
    return routed.select("chat_id", "seq", "tier", F.get("ids", F.lit(0)).alias("first_id"))


@query
def stream_lifecycle(spark, folder):
    """Every event of every user as an operation on its chat, on top of what customers have stored."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    op = (F.when(kind.isin("click", "signup"), "message").when(kind == "view", "access")
          .when(kind == "purchase", F.when(k >= 90, "rebuilt").when(k % 2 == 0, "fact").otherwise("update"))
          .otherwise(F.when(k % 10 == 9, "switch").when(k % 2 == 0, "delete").otherwise("swipe")))
    stream = tables.stream(spark, folder, "events").select(
        F.col("user_id").alias("chat_id"), F.col("event_id").alias("seq"), op.alias("op"), (k % 8).alias("turn"),
        kind.alias("role"), F.col("props").alias("text"), F.concat(F.lit("f"), (k % 16).cast("string")).alias("id"))
    chats = tables.load(spark, folder, "customer").select(F.col("c_custkey").alias("chat_id"))
    places = F.explode(F.sequence(F.lit(0), F.lit(9)))
    entries = chats.select("chat_id", places.alias("j")).select(
        "chat_id", F.concat(F.lit("f"), F.col("j").cast("string")).alias("id"),
        ((F.col("chat_id") * 37 + F.col("j") * 13) % 101).alias("importance"))
    turns = chats.filter("chat_id % 2 = 0").select(
        "chat_id", F.explode(F.array(F.lit(1), F.lit(3))).alias("turn"), F.lit("user").alias("role"), F.lit("kept").alias("text"))
    stored = live.stored_state(entries, turns.withColumn("seq", F.col("turn")),
                               chats.withColumn("added", F.col("chat_id") % 4))
    knobs = replace(tiers.DEFAULTS, buffer_threshold=4, batch_size=2, rebuild_suggestion=5)
    rows = live.drain(live.lived(stream, stored, knobs), "lived")
    return rows.select(
        "chat_id", "seq", "kind", F.array_join(F.col("turns").cast("array<string>"), ",").alias("turns"), "id", "importance",
        *[F.coalesce(n, F.lit(-1)).alias(n) for n in ("fire", "access_count", "update_count", "updated_seq", "added")],
        F.coalesce("rebuild_due", F.lit(False)).alias("rebuild_due"))


# --- edges with types, upserts and caps --------------------------------------------------

def _related_entries(spark, folder):
    """Documents as entries; every fifth asserts relations of all types, every tenth more than the cap holds."""
    kinds = F.array(*[F.lit(t) for t in ("mentions", "supports", "same_topic", "temporal_next", "contradicts")])
    seq = F.col("seq")
    n = F.when(seq % 10 == 0, 25).when(seq % 5 == 0, 3).otherwise(0)
    listed = F.transform(F.filter(F.sequence(F.lit(0), F.lit(24)), lambda j: j < n), lambda j: F.struct(
        F.element_at(kinds, ((seq + j) % 5 + 1).cast("int")).alias("type"),
        F.concat(F.lit("d"), ((seq * 13 + j * 29) % 500).cast("string")).alias("target")))
    return tables.entries(spark, folder).withColumn("relations", listed)


@query
def typed_edges_capped(spark, folder):
    edges = graph.build_edges(_related_entries(spark, folder))
    return edges.select("chat_id", "from_id", "to_id", "type", "weight", "seq")


@query
def typed_ladder(spark, folder):
    """The ladder over edges of all five types."""
    entries = _related_entries(spark, folder)
    found = tiers.ladder(entries, _edges(entries), tables.queries(spark, folder), tables.now(), 5)
    return found.select("chat_id", "query_id", F.col("rank").cast("long").alias("rank"), "id", "tier", r6("score"))


def _event_edges(spark, folder, remainder=None):
    """Events as edges from users to the subjects of their properties; all of them unless a remainder is given."""
    events = tables.load(spark, folder, "events")
    if remainder is not None:
        events = events.filter(F.col("event_id") % 2 == remainder)
    kind = F.when(F.col("event_type") == "purchase", "supports").when(F.col("event_type") == "click", "mentions").otherwise("same_topic")
    return events.select(
        (F.col("user_id") % 10).cast("string").alias("chat_id"), F.col("user_id").cast("string").alias("from_id"),
        F.get_json_object("props", "$.k").alias("to_id"), kind.alias("type"), F.col("value").alias("weight"),
        F.col("event_id").alias("seq")).groupBy(*graph.EDGE_KEY).agg(F.max("weight").alias("weight"), F.min("seq").alias("seq"))


@query
def edges_cap_fates(spark, folder):
    judged = graph.cap_edges(_event_edges(spark, folder, 0), _event_edges(spark, folder, 1))
    return judged.select(*graph.EDGE_KEY, "weight", "fate")


@query
def edge_upsert(spark, folder):
    return graph.upsert_edges(_event_edges(spark, folder, 0), _event_edges(spark, folder, 1)).select(
        *graph.EDGE_KEY, "weight", "seq")


@query
def edge_neighbours(spark, folder):
    """Adjacency of the users with an even id, once the edges of all odd chats are removed."""
    edges = _event_edges(spark, folder, 0)
    left = graph.remove_edges(edges, edges.filter(F.col("chat_id").cast("int") % 2 == 1))
    nodes = edges.filter(F.col("from_id").cast("long") % 4 == 0).select("chat_id", F.col("from_id").alias("id")).distinct()
    return graph.neighbours(left, nodes).select("chat_id", "from_id", "to_id", "type", F.col("place").cast("long").alias("place"))


@query
def edge_neighbours_all(spark, folder):
    """Adjacency of every user over the edges of all events, once those heavier than the mean are removed."""
    edges = _event_edges(spark, folder)
    heavy = edges.join(edges.agg(F.avg("weight").alias("mean")), F.col("weight") > F.col("mean"))
    nodes = edges.select("chat_id", F.col("from_id").alias("id")).distinct()
    return graph.neighbours(graph.remove_edges(edges, heavy), nodes).select(
        "chat_id", "from_id", "to_id", "type", F.col("place").cast("long").alias("place"))


# --- upkeep, viewer and write path, second part ------------------------------------------

@query
def cache_invalidate(spark, folder):
    """Chats with a purchase of more than the mean value lose their cached keys."""
    events = tables.load(spark, folder, "events").withColumn("chat_id", F.col("user_id").cast("string"))
    writes = events.select("chat_id", F.concat_ws("-", "event_type", F.get_json_object("props", "$.k")).alias("key"),
                           F.array(F.col("event_id").cast("string")).alias("ids"), F.col("event_id").alias("written"))
    mean = events.agg(F.avg("value").alias("mean"))
    written_to = events.join(mean, F.col("value") > F.col("mean")).filter("event_type = 'purchase'").select("chat_id").distinct()
    return caches.invalidate(caches.record(writes.limit(0), writes), written_to).select("chat_id", "key", "written")


@query
def traces_cleared(spark, folder):
    """The newest three traces of each chat; chats with an error of more than twice the mean value are cleared."""
    traces = tables.load(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("chat_id"), F.col("event_id").alias("seq"), "event_type", "value")
    mean = traces.agg(F.avg("value").alias("mean"))
    closed = traces.filter("event_type = 'error'").join(mean, F.col("value") > 2 * F.col("mean")).select("chat_id").distinct()
    return upkeep.clear_traces(upkeep.ring(traces, 3), closed).select("chat_id", "seq")


@query
def entry_construct(spark, folder):
    entries = tables.entries(spark, folder).filter(F.length("content") > 0)
    raw = entries.select(
        "chat_id", "scope", "content", "subject", "tags", F.array("seq").alias("source_messages"), F.lit("x").alias("extractor"))
    made = upkeep.new_entries(raw, tables.now())
    return made.select("chat_id", "id", "importance", "maturity", "access_count", "update_count",
                       F.unix_timestamp("updated_at").alias("updated_s"))


@query
def messages_accepted(spark, folder):
    turns = tables.turns(spark, folder).withColumn("is_first", F.col("turn") <= 1)
    return upkeep.accepted_messages(turns).select("chat_id", "turn", "text")


@query
def reasoning_stripped(spark, folder):
    answer = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" <think>first\nthen</think>\n"), "text")).otherwise(F.col("text"))
    return tables.turns(spark, folder).select("chat_id", "turn", text.strip_reasoning(answer).alias("text"))


@query
def rebuild_due(spark, folder):
    _, _, fates, extracted = consolidate.remember(tables.turns(spark, folder), tables.now())
    return consolidate.chat_status(consolidate.batch_report(extracted, fates))


@query
def viewer_by_recency(spark, folder):
    entries = tables.entries(spark, folder).withColumn("updated_at", F.col("created_at"))
    return viewer.grouped_page(entries, "recency").select("label", "chat_id", "id")


@query
def viewer_by_added(spark, folder):
    return viewer.grouped_page(tables.entries(spark, folder), "added", 300).select("label", "chat_id", "id")


@query
def viewer_unnamed_filter(spark, folder):
    entries = tables.entries(spark, folder)
    return entries.filter(viewer.subject_contains("NO SUB", include_unnamed=True)).select("chat_id", "id")


@query
def trace_badges(spark, folder):
    """Cause badge and top score of the resolving tier; views stand for tier 2."""
    events = tables.load(spark, folder, "events")
    cause = F.when(F.col("event_type") == "click", "swipe").when(F.col("event_type") == "purchase", "regenerate").otherwise("fresh")
    per_tier = F.create_map(F.lit("2"), F.array(F.struct(F.col("value").alias("score"))))
    tier = F.when(F.col("event_type") == "view", "2").otherwise("floor")
    return events.select("event_id", viewer.cause_label(cause).alias("badge"), viewer.top_score(tier, per_tier).alias("top"))


@query
def scorer_custom(spark, folder):
    """A registered scorer ranks what the beam found instead of the default one."""
    scorers = scoring.ScorerRegistry()
    scorers.register("plain", lambda now, params: F.col("bm25") * (1 + F.col("importance") / 100))
    scorers.use("plain")
    entries = tables.entries(spark, folder)
    found = tiers.ladder(entries, _edges(entries), tables.queries(spark, folder), tables.now(), 5, scorer=scorers.get())
    return found.filter("tier = '3'").select("chat_id", "query_id", "id", r6("bm25"), r6("score"))


# --- distributions and sweep files ---------------------------------------------------------

@query
def baseline_by_type(spark, folder):
    memory, qa, found = _run(spark, folder, "ladder", "bm25only", "recency")
    parts = []
    for name, rows in zip(("ladder", "bm25only", "recency"), found):
        scores = metrics.per_query(settle(evaluation.with_sources(rows, memory), name), qa)
        parts.append(metrics.by_task_type(scores.withColumn("retriever", F.lit(name)), keys=["retriever"]))
    joined = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return joined.select("retriever", "task_type", "n", "n_scored", r6("coverage"), r6("mrr"), r6("recall_5"))


@query
def fact_lengths(spark, folder):
    facts = consolidate.fact_entries(
        consolidate.extract_by_rules(consolidate.batches(tables.turns(spark, folder))), tables.now())
    return sweeps.fact_lengths(facts, ["extractor"])


@query
def factor_distribution(spark, folder):
    ranked = _candidates(spark, folder, factors=True)[3].select(
        F.lit("t2").alias("tier"), (1 + F.col("importance") / 100).alias("importance_factor"),
        r6("recency_factor"), "maturity_factor")
    return runs.factor_distribution(ranked, ["importance_factor", "recency_factor", "maturity_factor"])


def _sweep_points(spark, folder):
    """Averages over line items as measured points of a sweep."""
    lines = tables.load(spark, folder, "lineitem")
    return lines.groupBy("l_returnflag", "l_linenumber").agg(
        F.round(F.avg("l_discount"), 6).alias("mrr"), F.count("*").alias("n"),
        F.count_if(F.col("l_quantity") > 10).alias("n_scored"), F.round(F.avg("l_quantity"), 4).alias("p50"))


@query
def sweep_files(spark, folder):
    """Sweep files of three shapes, written and read back as one row per point and knob."""
    measured = F.struct("mrr", "n", "n_scored", (F.col("n") - F.col("n_scored")).alias("n_skipped"))
    points = _sweep_points(spark, folder).withColumn("latency", F.to_json(F.struct("p50", (F.col("p50") * 2).alias("p95"))))
    value = F.col("l_linenumber").cast("string")

    def collected(extra, latency):
        # a file's points are its grid of at most seven line numbers
        point = F.struct(*extra, measured.alias("metrics"), latency.alias("latencyMs"))
        return points.groupBy("l_returnflag").agg(F.collect_list(point).alias("points"))

    swept = [F.create_map(F.lit("edge_cap"), value, F.lit("k"), F.lit("5")).alias("overrides")]
    named = F.concat(F.lit("sweep-"), "l_returnflag").alias("sweep_name")
    rounds = collected(swept, F.col("p50").cast("string")).select(named, F.lit("t").alias("timestamp"), F.array(F.struct(
        F.lit("first").alias("name"), F.lit("edge_cap").alias("knob"), F.struct(F.lit("3").alias("value")).alias("winner"), "points")).alias("rounds"))
    flat = collected(swept, F.col("latency")).select(F.concat(F.lit("flat-"), "l_returnflag").alias("name"), "points")
    keyed = collected([F.concat(F.lit("r"), value).alias("retrieverId")], F.col("latency")).select(named, "points")
    path = scratch_path(spark, "sweep-files")
    for rows in (rounds, flat, keyed):
        rows.write.mode("append").option("maxRecordsPerFile", 1).json(path)
    return run_files.load_sweeps(spark, path).select(
        "timestamp", "sweep_name", "round", "knob", "value", "mrr", r6("coverage"), "n", "n_scored", "n_skipped",
        "latency_p50", "latency_p95", "is_winner")
