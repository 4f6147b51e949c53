"""Entity graph: edge construction, capping, upsert, removal, adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rememora.functions.text import entities
from rememora.operators.ranking import top_k
from rememora.params import DEFAULTS, Params
from rememora.session import settle

EDGE_KEY = ["chat_id", "from_id", "to_id", "type"]


def entity_postings(entries: DataFrame) -> DataFrame:
    """``(chat_id, entity, id, seq)`` over the long-term entries."""
    return entries.filter(F.col("scope") != "working").select(
        "chat_id", "id", "seq", F.explode(entities(F.col("content"))).alias("entity"))


def cooccurrence(entries: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Edges from each entry to the earliest ``edge_cap`` earlier entries that share an entity.

    Equal-weight edges survive the per-source cap in insertion order. So, of the
    entries that hold an entity, only the first ``edge_cap`` can ever be kept as
    targets: any later one has that many better-placed rivals through the same
    entity. Cutting the target side first is therefore exact, and the join grows
    linearly even when one entity occurs in a third of all entries.
    """
    # read twice below, and far smaller than the texts it comes from
    postings = settle(entity_postings(entries), "entities")
    targets = top_k(postings, ["chat_id", "entity"], [F.asc("seq"), F.asc("id")], params.edge_cap, "place")
    # one bounded list per entity: all later holders carry the same one, which compresses well beside its copies
    seq = F.col("seq")
    lists = targets.groupBy("chat_id", "entity").agg(
        F.collect_set(F.struct(F.col("id").alias("to_id"), seq.alias("to_seq"))).alias("targets"),
        F.min(seq).alias("first_seq"), F.when(F.bool_and(seq.isNotNull()), F.max(seq)).alias("last_seq"))
    # a whole list of earlier entries fills the cap, so nothing behind its last one is kept
    full = (F.size("targets") >= params.edge_cap) & (F.col("last_seq") < seq)
    # dealt by source once, as lists; pairs are made, told apart and cut where their source lies
    partitions = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    linked = (
        postings.join(lists, ["chat_id", "entity"]).filter(seq > F.col("first_seq"))
        .select("chat_id", F.col("id").alias("from_id"), seq.alias("from_seq"), "targets", F.when(full, F.col("last_seq")).alias("full_at"))
        .repartition(partitions, "chat_id", "from_id")
        .withColumn("cut", F.min("full_at").over(Window.partitionBy("chat_id", "from_id"))))
    pairs = (
        linked.select("chat_id", "from_id", "from_seq", "cut", F.inline("targets"))
        .filter((F.col("from_seq") > F.col("to_seq")) & (F.col("cut").isNull() | (F.col("to_seq") <= F.col("cut"))))
        .drop("cut").distinct()
    )
    return top_k(pairs, ["chat_id", "from_id"], [F.asc("to_seq")], params.edge_cap, "place").select(
        *EDGE_KEY[:3], F.lit("mentions").alias("type"), F.lit(params.cooccurrence_weight).alias("weight"),
        "from_seq", F.col("to_seq").alias("place"))


def explicit_relations(entries: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Edges asserted by the extractor, in the order they were listed."""
    listed = entries.select("chat_id", "id", "seq", F.posexplode("relations").alias("pos", "r"))
    return listed.select(
        "chat_id", F.col("id").alias("from_id"), F.col("r.target").alias("to_id"),
        F.col("r.type").alias("type"), F.lit(params.explicit_weight).alias("weight"),
        F.col("seq").alias("from_seq"), F.col("pos").cast("long").alias("place"))


def build_edges(entries: DataFrame, params: Params = DEFAULTS, ranked: bool = False) -> DataFrame:
    """Explicit and co-occurrence edges, one per key, capped per source.

    ``(chat_id, from_id, to_id, type, weight, seq)``; ``seq`` is the order in
    which a source's edges enter the graph. With ``ranked`` the column ``kept``
    is the edge's place under the cap: the edges of a smaller cap are those with
    ``kept`` up to it, in the same order.
    """
    linked = cooccurrence(entries, params).withColumn("block", F.lit(1))
    if "relations" in entries.columns:
        asserted = explicit_relations(entries, params)
        if params.cooccurrence_weight > params.explicit_weight:
            asserted = _raise_shared(asserted, entries, params)
        linked = linked.unionByName(asserted.withColumn("block", F.lit(0)))
    merged = linked.groupBy(*EDGE_KEY).agg(
        F.max("weight").alias("weight"), F.min("from_seq").alias("from_seq"),
        F.min(F.struct("block", "place")).alias("at"))
    kept = top_k(merged, ["chat_id", "from_id"],
                 [F.desc("weight"), F.asc("at"), F.asc("to_id"), F.asc("type")], params.edge_cap, "kept")
    # back in candidate order, which is the order the graph stores them in
    order = Window.partitionBy("chat_id", "from_id").orderBy("at", "to_id", "type")
    place = ["kept"] if ranked else []
    return kept.select(*EDGE_KEY, "weight", F.row_number().over(order).cast("long").alias("seq"), *place)


def _raise_shared(asserted: DataFrame, entries: DataFrame, params: Params) -> DataFrame:
    """Asserted ``mentions`` whose ends share an entity take the larger weight.

    Only needed when co-occurrence outweighs assertion, since such a target may
    lie beyond the targets that :func:`cooccurrence` keeps.
    """
    names = entries.filter(F.col("scope") != "working").select(
        "chat_id", "id", "seq", entities(F.col("content")).alias("names"))
    ends = (
        asserted.join(names.select("chat_id", F.col("id").alias("from_id"), F.col("names").alias("a")),
                      ["chat_id", "from_id"], "left")
        .join(names.select("chat_id", F.col("id").alias("to_id"), F.col("names").alias("b"),
                           F.col("seq").alias("to_seq")), ["chat_id", "to_id"], "left"))
    shared = ((F.col("type") == "mentions") & (F.col("to_seq") < F.col("from_seq"))
              & F.arrays_overlap("a", "b"))
    return ends.withColumn(
        "weight", F.when(shared, F.lit(params.cooccurrence_weight)).otherwise(F.col("weight"))
    ).drop("a", "b", "to_seq")


def cap_edges(existing: DataFrame, new: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Merge new edges of a source into its stored ones under the cap.

    Both sides are ``(chat_id, from_id, to_id, type, weight, seq)``. New edges
    win equal weights. The column ``fate`` is kept, evicted (was stored) or
    dropped (was new); a new edge that is already stored changes nothing.
    """
    fresh = new.join(existing.select(*EDGE_KEY), EDGE_KEY, "left_anti")
    touched = existing.join(new.select("chat_id", "from_id").distinct(), ["chat_id", "from_id"], "left_semi")
    both = touched.withColumn("is_existing", F.lit(1)).unionByName(fresh.withColumn("is_existing", F.lit(0)))
    order = Window.partitionBy("chat_id", "from_id").orderBy(F.desc("weight"), F.asc("is_existing"), F.asc("seq"))
    place = F.row_number().over(order)
    fate = (F.when(F.col("place") <= params.edge_cap, "kept")
            .when(F.col("is_existing") == 1, "evicted").otherwise("dropped"))
    return both.withColumn("place", place).withColumn("fate", fate).drop("place")


def upsert_edges(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or replace by key; the later row of a key sets the weight, the first its place."""
    both = stored.withColumn("src", F.lit(0)).unionByName(incoming.withColumn("src", F.lit(1)))
    return both.groupBy(*EDGE_KEY).agg(
        F.max_by("weight", F.struct("src", "seq")).alias("weight"),
        F.min_by("seq", F.struct("src", "seq")).alias("seq"))


def remove_edges(stored: DataFrame, doomed: DataFrame) -> DataFrame:
    return stored.join(doomed.select(*EDGE_KEY), EDGE_KEY, "left_anti")


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Out-edges of ``nodes(chat_id, id)`` in insertion order (column ``place``)."""
    out = edges.join(nodes.select("chat_id", F.col("id").alias("from_id")), ["chat_id", "from_id"])
    order = Window.partitionBy("chat_id", "from_id").orderBy("seq")
    return out.withColumn("place", F.row_number().over(order))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("chat_id", "from_id").agg(
        F.count("*").alias("degree"), F.sum("weight").alias("total_weight"))
