"""Grid points in one pass, descent, model calls that fail, and the faults that invariants report."""

import random

import pytest
from pyspark.sql import functions as F

from rememora.operators import communities, consolidate, graph, grid, model_client, persona, tiers
from rememora.params import DEFAULTS
from rememora.plans import sweeps

AT = "2026-04-20T10:00:00Z"
NAMES = ["Alice", "Berta", "Chloe", "Dario", "Emil", "Fritz"]


@pytest.fixture(scope="module")
def entries(spark):
    rng = random.Random(5)
    rows = [("c", f"e{i}", i, "working" if i % 11 == 10 else "episodic",
             " ".join(rng.sample(NAMES, 2)) + " " + " ".join(rng.choices(["tea", "bikes", "paris", "music", "rain"], k=4)),
             None, [], float(rng.randint(0, 100)), "draft") for i in range(40)]
    made = spark.createDataFrame(rows, "chat_id string, id string, seq long, scope string, content string, subject string, "
                                       "tags array<string>, importance double, maturity string")
    return made.withColumn("created_at", F.lit(AT).cast("timestamp"))


def test_points_equal_single_ladders(spark, entries):
    asked = spark.createDataFrame([("c", 0, "Alice tea"), ("c", 1, "who went with Emil in rain"), ("c", 2, "nothing known"), ("d", 0, "tea")],
                                  "chat_id string, query_id long, query string")
    now = F.lit(AT).cast("timestamp")
    points = [DEFAULTS.override(**p) for p in (
        {"lambda_1": 0.1, "beam_width": 1, "seeds_k": 1, "edge_cap": 2}, {"lambda_2": 2.0, "max_hops": 1, "edge_cap": 3}, {"beam_width": 2}, {})]
    edges = graph.build_edges(entries, grid.widest(points), ranked=True)
    got = grid.ladder_points(entries, edges, asked, now, 6, points).collect()
    for i, p in enumerate(points):
        want = tiers.ladder(entries, graph.build_edges(entries, p), asked, now, 6, p).collect()
        shape = lambda rows: sorted((r.chat_id, r.query_id, r["rank"], r.id, r.tier, r.bm25, r.score) for r in rows)
        assert shape(r for r in got if r.point == i) == shape(want), i


def test_a_smaller_cap_keeps_the_first_edges(entries):
    wide = graph.build_edges(entries, DEFAULTS.override(edge_cap=9), ranked=True).collect()
    for cap in (1, 4):
        want = graph.build_edges(entries, DEFAULTS.override(edge_cap=cap)).collect()
        kept = {(r.from_id, r.to_id) for r in wide if r.kept <= cap}
        assert kept == {(r.from_id, r.to_id) for r in want} and kept


def test_one_pass_sweeps_walk_knobs_only():
    with pytest.raises(ValueError, match="one pass"):
        grid.widest([DEFAULTS, DEFAULTS.override(subject_boost=9)])
    assert grid.widest([DEFAULTS.override(edge_cap=7), DEFAULTS]).edge_cap == 20


def test_elbow_of_few_points():
    assert sweeps.elbow_of([(1, .1), (2, .5), (3, .51), (4, .9)]) == 2
    assert sweeps.elbow_of([(3, .9), (1, .1), (2, .5)]) == 3  # no elbow: the highest metric
    assert sweeps.elbow_of([(1, .5), (2, .5)]) == 1 and sweeps.elbow_of([(7, 0.0)]) == 7


def test_descent_pins_and_remembers():
    asked = []

    def evaluate(points):
        asked.extend(points)
        return [1 / (1 + abs(p.lambda_1 - 2)) + p.beam_width / 100 for p in points]

    base, history = sweeps.pinned_descent([("lambda_1", [0.5, 1.0, 2.0]), ("beam_width", [5, 9]), ("lambda_1", [2.0, 3.0])], evaluate)
    assert base.lambda_1 == history[2]["winner"] and base.beam_width == history[1]["winner"] == 9
    assert len(asked) == len(set(asked)) and [h["asked"] for h in history] == [3, 1, 1]


def policy(waits, **limits):
    return model_client.CallPolicy(sleep=waits.append, **limits)


def failing(*faults):
    left = list(faults)

    def client(system, user):
        if left:
            raise left.pop(0)
        return "{}"

    return client


def test_calls_are_tried_again():
    busy, lost = model_client.CallFailed("busy", 503), ConnectionError("reset")
    waits = []
    assert model_client.call(failing(busy, lost), "", "", policy(waits)) == ("{}", None, 3, 600) and waits == [0.2, 0.4]
    answer, error, attempts, waited = model_client.call(failing(busy, lost, busy), "", "", policy([]))
    assert answer is None and error == "failed after 3 attempts: 503 busy" and attempts == 3 and waited == 600
    for status in (400, 401, 429, 499):
        assert model_client.call(failing(model_client.CallFailed("no", status)), "", "", policy([])) == (None, f"{status} no", 1, 0)
    assert model_client.call(lambda s, u: None, "", "", policy([]))[1:3] == ("response missing string content", 1)
    assert model_client.call(failing(lost), "", "", policy([], max_retries=0))[1] == "failed after 1 attempts: reset"
    waits = []
    model_client.call(failing(*[lost] * 9), "", "", policy(waits, max_retries=8))
    assert waits == [.2, .4, .8, 1.6, 3.2, 5, 5, 5]


def test_a_failed_batch_and_what_follows_go_back(spark):
    def remembered(system, user):
        if "b3" in user and "again" not in user:
            raise model_client.CallFailed("down", 401)
        return '{"entries": [{"content": "%s", "subject": "S"}]}' % user.split("\n")[1]

    params = DEFAULTS.override(batch_size=2, buffer_threshold=2)
    rows = [("x", t, "user", f"b{t // 2} word{t}") for t in range(10)] + [("y", t, "user", f"c{t}") for t in range(3)]
    turns = spark.createDataFrame(rows, "chat_id string, turn long, role string, text string").repartition(3)
    cut = consolidate.batches(turns, params)
    extracted, returned = model_client.extract_by_model(cut, remembered)
    assert sorted((r.chat_id, r.batch) for r in extracted.collect()) == [("x", 0), ("x", 1), ("x", 2), ("y", 0), ("y", 1)]
    assert sorted((r.batch, r.error) for r in returned.collect()) == [(3, "401 down"), (4, None)]
    back = model_client.back_to_buffer(returned)
    assert sorted((r.chat_id, r.turn, r.role, r.text) for r in back.collect()) == [r for r in rows if r[0] == "x" and r[1] >= 6]
    # the next run takes them up where the first stopped
    later, waiting = model_client.extract_by_model(
        consolidate.batches(back.withColumn("text", F.concat("text", F.lit(" again"))), params), remembered)
    assert later.count() == 2 and waiting.count() == 0
    none = model_client.extract_by_model(consolidate.batches(turns.limit(0), params), remembered)
    assert none[0].count() == none[1].count() == 0


def test_faults_of_partitions_are_found(spark):
    edges = spark.createDataFrame([("g", a, b, 1.0) for a, b in [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)]]
                                  + [("h", 1, 2, 1.0)], "key string, a int, b int, w double")
    nodes = spark.createDataFrame([("g", n) for n in range(1, 7)] + [("h", 1), ("h", 2)], "key string, node int")

    def faults(seats):
        df = spark.createDataFrame(seats, "key string, node int, community int")
        return {r.key: r.asDict() for r in communities.partition_faults(edges, nodes, df, 1.0).collect()}

    rest = [("h", 1, 1), ("h", 2, 1)]
    good = faults([("g", n, 1 if n < 4 else 4) for n in range(1, 7)] + rest)
    for row in good.values():
        assert not any(row[c] for c in ("unplaced", "repeated", "misnamed", "split", "worse"))
    assert good["g"]["communities"] == 2 and good["g"]["nodes"] == 6
    bad = faults([("g", 1, 1), ("g", 6, 1), ("g", 2, 9), ("g", 3, 9), ("g", 4, 9), ("g", 4, 9)] + rest)["g"]
    assert bad["unplaced"] == 1 and bad["repeated"] == 1 and bad["misnamed"] == 1 and bad["split"] == 1
    assert faults([("g", n, n) for n in range(1, 7)] + rest)["g"]["worse"] == 1


def test_parts_of_a_long_chain(spark):
    edges = spark.createDataFrame([("k", n, n + 1) for n in range(300) if n != 150], "key string, a int, b int")
    nodes = spark.createDataFrame([("k", n) for n in range(302)], "key string, node int")
    got = {r.node: r.part for r in communities.connected_parts(edges, nodes).collect()}
    assert got == {n: 0 if n <= 150 else 301 if n == 301 else 151 for n in range(302)}


def test_faults_of_rebuilds_are_found(spark):
    rows = [("c", f"e{i}", i, "episodic", f"fact {i}", "Alice") for i in range(4)] + [("c", "z", 9, "episodic", "lonely", "Bob")]
    entries = spark.createDataFrame(rows, "chat_id string, id string, seq long, scope string, content string, subject string")
    summaries = spark.createDataFrame([("c", "Alice", 1, "l1"), ("c", "Alice", 1, "l2"), ("c", "Bob", 1, "r")],
                                      "chat_id string, subject string, depth int, leaf string")

    def faults(origins):
        df = spark.createDataFrame(origins, "chat_id string, subject string, depth int, leaf string, id string")
        return {r.subject: (r.n_facts, r.uncovered, r.doubled, r.adrift) for r in persona.rebuild_faults(entries, summaries, df).collect()}

    a = ("c", "Alice", 1)
    whole = [(*a, "l1", "e0"), (*a, "l1", "e1"), (*a, "l2", "e2"), (*a, "l2", "e3"), ("c", "Bob", 1, "r", "z")]
    assert faults(whole) == {"Alice": (4, 0, 0, 0), "Bob": (1, 0, 0, 0)}
    assert faults([*whole[:3], (*a, "l2", "e0"), (*a, "l9", "e1"), whole[4]]) == {"Alice": (4, 1, 2, 1), "Bob": (1, 0, 0, 0)}
