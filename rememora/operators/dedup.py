"""Order-dependent de-duplication of facts, as a distributed fixpoint.

A fact is kept unless an *earlier kept* fact of the same chat and subject has a
token overlap at or above the threshold. That rule is a fold over arrival
order. It is replayed set-wise: leader rounds first take out whole crowds of
near-copies at linear cost, then the pairs among what is left are settled round
by round. No group is ever gathered in one task, and near-copies are never
paired with one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rememora.functions.text import bind, token_set
from rememora.params import DEFAULTS, Params
from rememora.session import settle, settle_bucketed

GROUP = ["chat_id", "subject"]
# at most this many tokens are treated as frequent, whatever the corpus size
FREQUENT_SLOTS = 20_000
# rounds that clear crowds of near-copies before pairs are formed
LEADER_ROUNDS = 2
# 64-bit words of a set's signature
SIGNATURE_WORDS = 8


def _frequent_tokens(exploded: DataFrame) -> DataFrame:
    """Tokens that make up more than 1/FREQUENT_SLOTS of all occurrences.

    By counting, there are at most FREQUENT_SLOTS of them: a bounded table.
    """
    least = exploded.count() / FREQUENT_SLOTS
    return exploded.groupBy("token").agg(F.count("*").alias("df")).filter(F.col("df") > least)


def prefix_rows(sets: DataFrame, keys: list[str], name: str, threshold: float,
                frequent: DataFrame) -> DataFrame:
    """The first ``n - ceil(t n) + 1`` tokens of each set, rare tokens first.

    Two sets can only reach Jaccard ``t`` if such prefixes, taken in one common
    token order, share a token. With the frequent tokens last the prefixes hold
    rare tokens and joining on them stays small.
    """
    exploded = sets.filter(F.size("toks") > 0).select(
        *keys, name, F.size("toks").alias("n"), F.explode("toks").alias("token"))
    order = Window.partitionBy(*keys, name).orderBy(F.coalesce("df", F.lit(0)), "token")
    prefix_len = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    return (exploded.join(frequent, "token", "left")
            .withColumn("at", F.row_number().over(order))
            .filter(F.col("at") <= prefix_len)
            .select(*keys, "token", name, "n", "at"))


def signature(toks: Column) -> Column:
    """Parity bitmap of a token set: each token flips one of its bits.

    A token that two sets share flips the same bit in both, so their bitmaps differ in at
    most as many bits as the sets have tokens of their own.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def word(hashes, i):
        mine = F.filter(hashes, lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(SIGNATURE_WORDS - 1)) == i)
        return F.aggregate(mine, none, lambda acc, h: acc.bitwiseXOR(
            F.call_function("shiftleft", one, h.bitwiseAND(F.lit(63)).cast("int"))))

    def words(hashes):
        return F.array(*[word(hashes, i) for i in range(SIGNATURE_WORDS)])

    return bind(F.transform(toks, lambda t: F.xxhash64(t)), words)


def _may_reach(threshold: float) -> Column:
    """Whether ``(na, sa)`` and ``(nb, sb)``, sizes and signatures, leave room for Jaccard ``threshold``; never false for such a pair."""
    differ = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(SIGNATURE_WORDS)), F.lit(0))
    return differ <= F.lit((1 - threshold) / (1 + threshold)) * (F.col("na") + F.col("nb")) + 1e-9


def _signed(sets: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Sizes and signatures of ``sets(keys, name, toks)``, a narrow table beside the tokens."""
    return sets.select(*keys, name, F.size("toks").alias(f"n{name}"), signature(F.col("toks")).alias(f"s{name}"))


def similar_sets(left: DataFrame, right: DataFrame, keys: list[str], threshold: float,
                 ordered: bool = False) -> DataFrame:
    """Pairs of ``left(keys, a, toks)`` and ``right(keys, b, toks)`` with Jaccard >= threshold.

    ``ordered`` keeps only ``a < b``, for a table matched with itself.
    """
    tokens_of_all = left.select(F.explode("toks").alias("token"))
    frequent = settle(_frequent_tokens(tokens_of_all), "frequent-tokens")
    lp = settle(prefix_rows(left, keys, "a", threshold, frequent), "prefixes")
    rp = lp if ordered else settle(prefix_rows(right, keys, "b", threshold, frequent), "prefixes")
    x = lp.select(*keys, "token", "a", F.col("n").alias("na"), F.col("at").alias("pa"))
    y = rp.select(*keys, "token", F.col("a" if ordered else "b").alias("b"),
                  F.col("n").alias("nb"), F.col("at").alias("pb"))
    # what two sets can still share from these positions on, against what they need;
    # the first shared token gives the valid bound, so one shared token that meets it is enough
    reachable = 1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    needed = F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-9
    fits = (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9) & (reachable >= needed)
    candidates = (
        x.join(y, [*keys, "token"]).filter(fits & (F.col("a") < F.col("b")) if ordered else fits)
        .select(*keys, "a", "b").distinct())
    marks = settle(_signed(left, keys, "a"), "signatures")
    others = (marks.select(*keys, F.col("a").alias("b"), F.col("na").alias("nb"), F.col("sa").alias("sb")) if ordered
              else settle(_signed(right, keys, "b"), "signatures"))
    # token arrays meet only where sizes and signatures leave room; this table is written, so that its size is known
    candidates = settle(
        candidates.join(marks, [*keys, "a"]).join(others, [*keys, "b"]).filter(_may_reach(threshold))
        .select(*keys, "a", "b").distinct(), "candidates")
    return _verified(candidates, left, right, keys, threshold)


def _verified(pairs: DataFrame, left: DataFrame, right: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """The pairs ``(keys, a, b)`` of Jaccard >= threshold, with it, by ``left(keys, a, toks)`` and ``right(keys, b, toks)``."""
    similarity = bind(F.size(F.array_intersect("ta", "tb")), lambda overlap: overlap / (F.size("ta") + F.size("tb") - overlap))
    return (
        pairs.join(left.select(*keys, "a", F.col("toks").alias("ta")), [*keys, "a"])
        .join(right.select(*keys, "b", F.col("toks").alias("tb")), [*keys, "b"])
        .select(*keys, "a", "b", similarity.alias("similarity"))
        .filter(F.col("similarity") >= threshold))


def leader_round(rows: DataFrame, sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Facts that are certainly kept, and those that certainly repeat one of them.

    ``rows`` are the prefix rows of the undecided facts. A fact that comes first
    under every one of its prefix tokens has no earlier undecided neighbour, so
    it is kept. Each token has at most one such leader: comparing all facts with
    the leaders of their tokens is linear, however many copies there are.
    """
    leaders = rows.groupBy(*GROUP, "token").agg(F.min("a").alias("lead"))
    led = settle(rows.join(leaders, [*GROUP, "token"]).select(*GROUP, "a", "lead", "n"), "led")
    kept = settle(led.groupBy(*GROUP, "a").agg(F.min((F.col("a") == F.col("lead")).cast("int")).alias("first"))
                  .filter("first = 1").select(*GROUP, "a"), "leaders")
    pairs = settle(
        led.filter("a <> lead").select(*GROUP, "a", F.col("lead").alias("b")).distinct()
        .join(kept.withColumnRenamed("a", "b"), [*GROUP, "b"], "left_semi"), "led-pairs")
    near = _verified(pairs, sets, sets.withColumnRenamed("a", "b"), GROUP, threshold)
    return kept, settle(near.select(*GROUP, "a").distinct(), "led-away")


def _distinct_sets(facts: DataFrame) -> DataFrame:
    """Facts with their token set and a digest of it."""
    keyed = facts.withColumn("toks", F.sort_array(token_set(F.col("content"))))
    return keyed.withColumn("set_key", F.sha2(F.array_join("toks", " "), 256))


def find_duplicates(facts: DataFrame, kept: DataFrame, threshold: float) -> DataFrame:
    """First kept fact that each fact repeats: ``(chat_id, subject, a, b, similarity)``.

    ``facts(chat_id, subject, a, toks)``, ``kept(chat_id, subject, b, toks)``. Kept
    facts are unlike one another, so a crowd of copies meets few of them.
    """
    near = similar_sets(facts, kept, GROUP, threshold).filter(F.col("b") < F.col("a"))
    return near.groupBy(*GROUP, "a").agg(
        F.min("b").alias("b"), F.min_by("similarity", "b").alias("similarity"))


def fold_duplicates(facts: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Add ``target_seq`` to ``facts(chat_id, subject, seq, content, ...)``.

    ``target_seq`` equals ``seq`` for a kept fact, else it names the earliest
    kept fact it repeats. Facts without a subject or without tokens are kept.
    An optional boolean column ``stored`` marks facts already accepted earlier.
    """
    limit = params.dedup_threshold
    stored = F.coalesce(F.col("stored"), F.lit(False)) if "stored" in facts.columns else F.lit(False)
    # dealt by fact once: what is asked of a fact's tokens below needs no shuffle of them
    keyed = settle_bucketed(
        _distinct_sets(facts.filter(F.col("subject").isNotNull())).select(
            *GROUP, "seq", "set_key", "toks", stored.alias("stored")), "fact_sets", [*GROUP, "seq"])
    # equal token sets share one fate: they meet the same earliest kept fact
    firsts = settle(keyed.filter(F.size("toks") > 0).groupBy(*GROUP, "set_key").agg(
        F.min("seq").alias("first_seq")), "first-copies")
    # an id that comes with several texts may be the first copy of some of them only
    first_here = settle(firsts.groupBy(*GROUP, F.col("first_seq").alias("seq")).agg(F.collect_set("set_key").alias("firsts")), "first-here")
    sets = (keyed.join(first_here, [*GROUP, "seq"]).filter(F.array_contains("firsts", F.col("set_key")))
            .select(*GROUP, F.col("seq").alias("a"), "toks", "stored"))
    here = [*GROUP, "a"]
    old = sets.filter("stored").select(*here, "toks")
    fresh = sets.filter(~F.col("stored")).select(*here, "toks")
    if "stored" in facts.columns:
        repeats = find_duplicates(fresh, old.withColumnRenamed("a", "b"), limit)
        fresh = settle(fresh.join(repeats, here, "left_anti"), "fresh")
    frequent = settle(_frequent_tokens(fresh.select(F.explode("toks").alias("token"))), "frequent-tokens")
    rows = settle_bucketed(prefix_rows(fresh, GROUP, "a", limit, frequent), "prefixes", [*GROUP, "token"])
    kept = old.select(*here)
    for _ in range(LEADER_ROUNDS):
        leaders, gone = leader_round(rows, fresh, limit)
        kept = kept.unionByName(leaders)
        rows = rows.join(leaders.unionByName(gone), here, "left_anti")
    undecided = settle(rows.select(*here).distinct(), "undecided")
    open_sets = fresh.join(undecided, here, "left_semi")
    pairs = settle(similar_sets(open_sets, open_sets.withColumnRenamed("a", "b"), GROUP, limit, ordered=True), "near-pairs")
    repeated = repeated_facts(pairs)
    kept = settle(kept.unionByName(open_sets.select(*here).join(repeated, here, "left_anti")), "kept")
    kept_sets = sets.join(kept, here, "left_semi").select(*GROUP, F.col("a").alias("b"), "toks")
    lost = sets.join(kept, here, "left_anti").select(*here, "toks")
    fates = find_duplicates(lost, kept_sets, limit).select(
        *GROUP, F.col("a").alias("first_seq"), F.col("b").alias("target"))
    first_fate = firsts.join(fates, [*GROUP, "first_seq"], "left").select(
        *GROUP, "set_key", F.coalesce("target", "first_seq").alias("target"))
    targets = keyed.join(first_fate, [*GROUP, "set_key"]).select(
        *GROUP, "seq", F.when(F.col("stored"), F.col("seq")).otherwise(F.col("target")).alias("target_seq"))
    return facts.join(targets, [*GROUP, "seq"], "left").withColumn(
        "target_seq", F.coalesce("target_seq", "seq"))


def repeated_facts(pairs: DataFrame) -> DataFrame:
    """Replay the fold on near pairs ``(chat_id, subject, a, b)``, ``a`` earlier than ``b``.

    Returns the facts ``(chat_id, subject, a)`` that repeat an earlier kept one.
    Each round decides every fact whose earlier neighbours are all decided, so
    the number of rounds is the longest chain of near-duplicates, not the number
    of facts.
    """
    open_pairs = pairs.select(*GROUP, "a", "b")
    dropped = open_pairs.select(*GROUP, "a").limit(0)
    while True:
        # a fact that is nobody's later neighbour any more is kept
        undecided = open_pairs.select(*GROUP, F.col("b").alias("a")).distinct()
        hit = settle(open_pairs.join(undecided, [*GROUP, "a"], "left_anti").select(
            *GROUP, F.col("b").alias("a")).distinct(), "fold-round")
        if hit.isEmpty():
            return dropped
        dropped = dropped.unionByName(hit)
        # a repeated fact neither needs a decision nor can absorb later ones
        open_pairs = settle(
            open_pairs.join(hit.withColumnRenamed("a", "b"), [*GROUP, "b"], "left_anti")
            .join(hit, [*GROUP, "a"], "left_anti"), "fold-open")
