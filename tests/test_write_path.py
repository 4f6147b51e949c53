import random

import pytest
from pyspark.sql import functions as F

from rememora.operators import consolidate, dedup, numbering, persona, upkeep
from rememora.params import DEFAULTS
from rememora.plans import evaluation


def at():
    return F.lit("2026-04-20T10:00:00Z").cast("timestamp")


def turns(spark, texts, chat="c"):
    return spark.createDataFrame([(chat, i, "user", t) for i, t in enumerate(texts)],
                                 "chat_id string, turn long, role string, text string")


def fold(facts, threshold=0.7):
    """The rule, one fact at a time."""
    kept, out = {}, {}
    for seq, subject, content in facts:
        words = set(content.split())
        target = seq
        if subject is not None:
            for other, bag in kept.setdefault(subject, []):
                if words and len(words & bag) / len(words | bag) >= threshold:
                    target = other
                    break
            else:
                kept[subject].append((seq, words))
        out[seq] = target
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(14)]
    facts = []
    for seq in range(250):
        subject = rng.choice([None, "hot", "hot", "hot", "cold"])
        size = rng.randint(0, 9)
        base = rng.sample(vocabulary, size)
        facts.append((seq, subject, " ".join(base)))
        if facts and rng.random() < .3:  # near copies make chains
            source = rng.choice(facts)[2].split()
            if source:
                source[rng.randrange(len(source))] = rng.choice(vocabulary)
                facts[-1] = (seq, subject, " ".join(source))
    df = spark.createDataFrame([("c", s, q, t) for q, s, t in facts], "chat_id string, subject string, seq long, content string")
    got = {r["seq"]: r["target_seq"] for r in dedup.fold_duplicates(df).collect()}
    assert got == fold(facts)


def test_stored_facts_absorb_new_ones(spark):
    rows = [("c", "s", 1, "aa bb cc dd", True), ("c", "s", 2, "aa bb cc dd ee", True), ("c", "s", 3, "aa bb cc dd", False),
            ("c", "s", 4, "xx yy", False)]
    df = spark.createDataFrame(rows, "chat_id string, subject string, seq long, content string, stored boolean")
    assert {r["seq"]: r["target_seq"] for r in dedup.fold_duplicates(df).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}


def test_twelve_turns_fire_once_and_the_rest_drains(spark):
    twelve = turns(spark, [f"Alice saw the number{i} tower" for i in range(12)])
    cut = consolidate.batches(twelve).orderBy("batch").collect()
    assert [(r["batch"], list(r["sources"]), r["fired_at"]) for r in cut] == [
        (0, [0, 1, 2, 3, 4], 9), (1, [5, 6, 7, 8, 9], 11), (2, [10, 11], 11)]


def feed(n, threshold, batch):
    """Buffer fed turn by turn, drained at the end."""
    buffer, out = [], []
    for i in range(n):
        buffer.append(i)
        if len(buffer) >= threshold:
            out.append(buffer[:batch])
            buffer = buffer[batch:]
    while buffer:
        out.append(buffer[:min(batch, threshold)])
        buffer = buffer[min(batch, threshold):]
    return out


@pytest.mark.parametrize("n,threshold,batch", [(23, 10, 5), (9, 4, 2), (17, 3, 7)])
def test_batches_equal_the_buffer(spark, n, threshold, batch):
    params = DEFAULTS.override(buffer_threshold=threshold, batch_size=batch)
    cut = consolidate.batches(turns(spark, ["x y"] * n), params).orderBy("batch").collect()
    assert [list(r["sources"]) for r in cut] == feed(n, threshold, batch)


def test_consolidation_updates_and_is_repeatable(spark):
    talk = turns(spark, ["Alice likes green tea very much.  Bob rides a red bike.", "", "   "]
                 + ["Alice likes green tea very much. " for _ in range(6)])
    entries, edges, fates, extracted = consolidate.remember(talk, at())
    rows = {r["content"]: r for r in entries.collect()}
    tea = rows["Alice likes green tea very much"]
    report = {r["batch"]: r for r in consolidate.batch_report(extracted, fates).collect()}
    updates = sum(r["updated"] for r in report.values())
    assert tea["update_count"] == updates > 0 and tea["importance"] == 50 + 5 * updates
    assert sum(r["drained"] for r in report.values()) == 7
    again = consolidate.remember(talk, at())[0]
    digest = [r["fingerprint"] for r in evaluation.digest(entries).collect()]
    assert digest == [r["fingerprint"] for r in evaluation.digest(again).collect()]
    due = consolidate.chat_status(consolidate.batch_report(extracted, fates), DEFAULTS).first()
    assert due["rebuild_due"] is False and due["facts_since_rebuild"] == len(rows)


def test_answers_drive_extraction(spark):
    cut = consolidate.batches(turns(spark, ["hello there"] * 3))
    answers = consolidate.answer_with(cut, lambda system, user: '{"entries": [{"content": "Fact one", "subject": "S"}, {}]}')
    row = consolidate.extract_by_answers(cut, answers).first()
    assert row["status"] == "ok" and row["skipped"] == 1 and row["facts"][0]["content"] == "Fact one"


def test_numbering_is_exact_across_ranges(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < .8 else "cold", n) for n in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "k string, n long")
    got = {(r["k"], r["n"]): r["at"] for r in numbering.number_rows(df, "k", "n", "at", width=16).collect()}
    for key in ("hot", "cold"):
        for i, n in enumerate(sorted(n for k, n in rows if k == key)):
            assert got[key, n] == i


def test_scrub_and_new_entries(spark):
    buffer = spark.createDataFrame([("c", "a", [1, 2]), ("c", "b", [3])], "chat_id string, id string, source_messages array<long>")
    gone = spark.createDataFrame([("c", 2)], "chat_id string, message long")
    assert [r["id"] for r in upkeep.scrub(buffer, gone).collect()] == ["b"]
    raw = spark.createDataFrame([("c", "episodic", "text", None, ["t"], [1], "x")],
                                "chat_id string, scope string, content string, subject string, tags array<string>, "
                                "source_messages array<long>, extractor string")
    born = upkeep.new_entries(raw, at()).first()
    assert born["importance"] == 50 and born["maturity"] == "draft" and born["id"].startswith("ep_2026-04-20T10:00:00_")
    with pytest.raises(Exception, match="invalid entry"):
        upkeep.new_entries(raw.withColumn("content", F.lit("")), at()).collect()


def test_persona_rebuild_covers_every_fact(spark):
    rows = [("c", f"e{i}", i, "episodic", f"fact number {i} about {'tea' if i % 2 else 'bikes'}", "Alice", [i]) for i in range(20)]
    rows += [("c", "z", 99, "episodic", "lonely fact", "Bob", [7]), ("c", "p", 100, "persona", "old", "Alice", [0])]
    entries = spark.createDataFrame(rows, "chat_id string, id string, seq long, scope string, content string, subject string, "
                                          "source_messages array<long>")
    summaries, origins = persona.rebuild(entries, DEFAULTS)
    summaries, origins = summaries.cache(), origins.cache()
    per = {(r["subject"], r["depth"]): set() for r in summaries.collect()}
    for r in origins.collect():
        per[r["subject"], r["depth"]].add(r["id"])
    assert per["Bob", 1] == {"z"}
    assert per["Alice", 1] == {f"e{i}" for i in range(20)}
    messages = persona.message_origins(origins, entries)
    fresh = persona.persona_entries(summaries, messages, at(), "x").cache()
    swapped = persona.replace_persona(entries, fresh)
    names = [r["id"] for r in swapped.filter("scope = 'persona'").collect()]
    # the old row is gone, each new one is there once, and no text was lost
    assert "p" not in names and len(names) == len(set(names)) == fresh.count()
    assert {r["content"] for r in fresh.collect()} == {r["text"] for r in summaries.collect()}
    assert swapped.filter("scope = 'episodic'").count() == 21


def test_stored_entries_keep_their_lifecycle(spark):
    from pyspark.sql import functions as F

    from rememora.operators import consolidate

    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select(
        F.col("conv_id").alias("chat_id"), "turn", "role", "text")
    now = F.lit("2025-01-01T00:00:00Z").cast("timestamp")
    later = F.lit("2025-02-01T00:00:00Z").cast("timestamp")
    extracted = consolidate.extract_by_rules(consolidate.batches(turns)).cache()
    stored = consolidate.consolidate(extracted.filter("batch = 0"), now)[0].withColumn("maturity", F.lit("core")).withColumn(
        "access_count", F.lit(7).cast("long")).withColumn("importance", F.lit(90.0)).cache()
    both = consolidate.consolidate(extracted.filter("batch > 0"), later, stored=stored)[0].join(
        stored.select("chat_id", "seq", F.col("update_count").alias("was")), ["chat_id", "seq"], "left").collect()
    old = [r for r in both if r["was"] is not None]
    assert len(old) == stored.count() and {r["maturity"] for r in old} == {"core"} and {r["access_count"] for r in old} == {7}
    for r in old:
        updated = r["update_count"] > r["was"]
        assert (r["updated_at"].month == 2) == updated and (r["importance"] > 90) == updated
    assert {(r["maturity"], r["access_count"]) for r in both if r["was"] is None} <= {("draft", 0)}


def test_new_edges_join_stored_ones(spark):
    from pyspark.sql import functions as F

    from rememora.operators import consolidate

    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select(
        F.col("conv_id").alias("chat_id"), "turn", "role", "text")
    now = F.lit("2025-01-01T00:00:00Z").cast("timestamp")
    entries, edges = consolidate.remember(turns.filter("turn < 8"), now)[:2]
    more, kept, evicted = consolidate.remember_more(turns.filter("turn >= 8"), now, entries, edges)
    assert more.count() >= entries.count()
    key = ["chat_id", "from_id", "to_id", "type"]
    assert kept.count() == kept.select(*key).distinct().count()
    assert edges.join(kept, key, "left_anti").count() == evicted.count()
    assert kept.groupBy("chat_id", "from_id").count().agg(F.max("count")).first()[0] <= 20


def test_cached_queries_may_share_a_stamp(spark):
    from rememora.operators import caches

    held = spark.createDataFrame([("c", "alpha beta", ["1"], 5), ("c", "gamma delta", ["2"], 5)],
                                 "chat_id string, key string, ids array<string>, written long")
    asked = spark.createDataFrame([("c", 1, "gamma delta")], "chat_id string, query_id long, query string")
    assert [(r["key"], r["similarity"], r["ids"]) for r in caches.fuzzy_hits(held, asked).collect()] == [("gamma delta", 1.0, ["2"])]


def test_rule_limits_are_parameters_and_counted(spark):
    said = " ".join(f"Alice keeps box number {'abcdefgh'[i]} there." for i in range(7)) + "\nBob waits below the old bridge."
    turns = spark.createDataFrame([("c", 0, "user", said)], "chat_id string, turn long, role string, text string")
    batched = consolidate.batches(turns)
    row = consolidate.extract_by_rules(batched).first()
    assert len(row["facts"]) == 5 and row["cut"] == 2
    whole = consolidate.extract_by_rules(batched, DEFAULTS.override(max_facts=None, join_lines=True)).first()
    assert [f["subject"] for f in whole["facts"]] == ["Alice"] * 7 + ["Bob"] and whole["cut"] == 0
