import math

import pytest
from pyspark.sql import functions as F

from rememora.functions import extraction, identity, lifecycle, text, vectors
from rememora.params import DEFAULTS, Params, Settings


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"]) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


def texts(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["v"] for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_tokens_keep_ascii_runs_of_two(spark):
    got = texts(spark, ["Hello, World! a b2", "café 12 x", "", None], text.tokens)
    assert got == [["hello", "world", "b2"], ["caf", "12"], [], []]


def test_keys(spark):
    assert texts(spark, ["b a bb aa bb", "!"], text.token_key) == ["aa bb", ""]
    # the offset basis is the hash of the empty text; inner spaces count, outer ones do not
    empty, padded, plain, inner = texts(spark, ["", "  Where? ", "where?", "whe re?"], text.exact_key)
    assert empty == "811c9dc5" and padded == plain != inner


def test_hash_works_on_utf16_units(spark):
    def fnv(s):
        raw, h = s.encode("utf-16-be"), 0x811C9DC5
        for i in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[i:i + 2], "big")) * 0x01000193) & 0xFFFFFFFF
        return h

    samples = ["alice", "élan", "😀 smile", ""]
    assert texts(spark, samples, text.fnv1a32) == [fnv(s) for s in samples]


def test_entities_use_ascii_word_edges(spark):
    got = texts(spark, ["The Alicé met Bobby and Bobby", "Al Bob3 xCarl Dan_"], text.entities)
    assert got == [["Alic", "Bobby"], []]


@pytest.mark.parametrize("query,intent", [
    ("When did Alice move?", "temporal"), ("what happened last week", "temporal"), ("in 2021", "temporal"),
    ("two years ago", "temporal"), ("before lunch", "temporal"),
    ("Who is she?", "relational"), ("Alice and Bob", "relational"), ("are they related", "relational"),
    ("between cats and dogs", "relational"), ("with whom", "relational"),
    ("favourite food", "factual"), ("   ", "factual"), ("whenever", "factual"), ("who was here yesterday", "temporal")])
def test_intent(spark, query, intent):
    assert texts(spark, [query], text.intent) == [intent]


def test_jaccard(spark):
    def j(a, b, empty=0.0):
        df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
        return df.select(text.jaccard(F.col("a"), F.col("b"), empty)).first()[0]

    assert j(["a", "b"], ["b", "a"]) == 1 and j(["a"], ["b"]) == 0 and j(["a", "a", "b"], ["b", "c"]) == pytest.approx(1 / 3)
    assert j([], []) == 0 and j([], [], 1.0) == 1


def test_term_frequencies(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],)], "t array<string>")
    got = [[tuple(p) for p in r["v"]] for r in df.select(text.term_frequencies(F.col("t")).alias("v")).collect()]
    assert got == [[("a", 1), ("b", 2)], []]


def test_recency(spark):
    def at(days):
        df = spark.sql(f"SELECT timestamp'2026-04-20 00:00:00' n, timestamp'2026-04-20 00:00:00' - make_dt_interval({days}) c")
        return df.select(lifecycle.recency(F.col("n"), F.col("c"))).first()[0]

    assert at(0) == 1 and at(30) == pytest.approx(math.exp(-1)) and at(21) == pytest.approx(0.4966, abs=1e-3) and at(-3) == 1
    with pytest.raises(ValueError):
        lifecycle.recency(F.lit(None), F.lit(None), 0)


def test_importance_events(spark):
    def value(c):
        return spark.range(1).select(c.alias("v")).first()["v"]

    assert value(lifecycle.bumped(F.lit(50.0), F.lit(7), 3)) == 71
    assert value(lifecycle.bumped(F.lit(98.0), F.lit(1), 5)) == 100
    assert value(lifecycle.decayed(F.lit(50.0), F.lit(1))) == pytest.approx(49.75)
    assert value(lifecycle.decayed(F.lit(50.0), F.lit(365))) == pytest.approx(8, abs=0.1)


@pytest.mark.parametrize("importance,tier,expected", [
    (64.9, "draft", "draft"), (65, "draft", "validated"), (99, "draft", "validated"), (85, "validated", "core"),
    (34, "validated", "draft"), (35, "validated", "validated"), (60, "core", "core"), (59, "core", "validated")])
def test_maturity_steps(spark, importance, tier, expected):
    got = spark.range(1).select(lifecycle.next_maturity(F.lit(float(importance)), F.lit(tier))).first()[0]
    assert got == expected


def test_entry_id_ignores_tag_order_and_empty_subject(spark):
    def make(subject, tags):
        return spark.range(1).select(identity.entry_id(
            F.lit("episodic"), F.lit("2026-04-20T14:12:33.123Z").cast("timestamp"), F.lit("c"),
            F.lit(subject).cast("string"), F.array(*map(F.lit, tags)), F.array(F.lit(1)), F.lit("x"))).first()[0]

    assert make(None, ["b", "a"]) == make("", ["a", "b"]) != make("s", ["a", "b"])
    assert make(None, ["a"]).startswith("ep_2026-04-20T14:12:33_") and len(make(None, ["a"])) == 23 + 12


def test_hashed_embedding_matches_a_plain_loop(spark):
    def plain(s):
        raw, h = s.encode("utf-16-be"), 0x811C9DC5
        for i in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[i:i + 2], "big")) * 0x01000193) & 0xFFFFFFFF
        h, v = h or 0xDEADBEEF, []
        for _ in range(16):
            h ^= (h << 13) & 0xFFFFFFFF
            h ^= h >> 17
            h ^= (h << 5) & 0xFFFFFFFF
            v.append(h / 0xFFFFFFFF * 2 - 1)
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v]

    for sample, got in zip(["alice", "ü", ""], texts(spark, ["alice", "ü", ""], vectors.hashed_embedding)):
        assert got == pytest.approx(plain(sample))


def test_rule_facts(spark):
    df = spark.createDataFrame([([("user", "The Alice moved to Paris today. Nobody. \nBob line is not read at all"),
                                  ("user", "nothing named in here at all. We saw Carla singing loudly!  ")],)],
                               "m array<struct<role:string,content:string>>")
    facts = df.select(extraction.rule_facts(F.col("m")).alias("f")).first()["f"]
    assert [(f["content"], f["subject"], f["tags"]) for f in facts] == [
        ("The Alice moved to Paris today", "Alice", ["moved", "paris", "today"]),
        ("We saw Carla singing loudly", "Carla", ["singing", "loudly"])]


@pytest.mark.parametrize("answer,status,reasons", [
    ("not json", "parse_failure", None), ("[1]", "not_object", None), ('{"x": 1}', "no_entries", None),
    ('```json\n{"entries": [{"content": "a", "subject": null}]}\n```', "ok", [None]),
    ('{"entries": [{"content": ""}, 7, {"content": "a", "subject": 3}, {"content": "a", "tags": [1]}, '
     '{"content": "a", "relations": [{"type": "supports"}]}, {"content": "a", "relations": [{"type": "odd", "target": "t"}]}, '
     '{"content": "a", "relations": [{"type": "supports", "target": "__proto__"}]}, '
     '{"content": "ok", "tags": ["t"], "relations": [{"type": "contradicts", "target": "x"}, {"type": "mentions", "target": "y"}]}]}',
     "ok", ["content", "not_object", "subject", "tags", "relation_shape", "relation_type", "relation_target", None])])
def test_model_answers(spark, answer, status, reasons):
    df = spark.createDataFrame([(answer,)], "a string").select(extraction.parse_answer(F.col("a")).alias("p"))
    assert df.select(extraction.answer_status(F.col("p"))).first()[0] == status
    if reasons is not None:
        items = df.select(F.explode(F.try_variant_get("p", "$.entries", "array<variant>")).alias("i"))
        assert [r[0] for r in items.select(extraction.skip_reason(F.col("i"))).collect()] == reasons
        last = items.filter(extraction.skip_reason(F.col("i")).isNull()).select(extraction.item_fields(F.col("i")).alias("f"))
        assert all(r["type"] != "contradicts" for row in last.collect() for r in row["f"]["relations"])


def test_strip_reasoning(spark):
    assert texts(spark, ["<think>a\nb</think>\n answer", "plain"], text.strip_reasoning) == ["answer", "plain"]


def test_params_and_settings():
    assert DEFAULTS.override(lambda_1=0.5).lambda_1 == 0.5 and DEFAULTS.lambda_1 == 1.0
    with pytest.raises(ValueError):
        DEFAULTS.override(recency_tau_days=3)
    assert Params().knn_k(2) == 25 and Params().gamma(2) == pytest.approx(0.6) and Params().gamma(9) == 0.01
    s = Settings(buffer_size=500, idle_ms=1, trace_cap=float("nan"), injection_mode="odd")
    assert (s.buffer_size, s.idle_ms, s.trace_cap, s.injection_mode) == (50, 5000, 128, "automatic")
