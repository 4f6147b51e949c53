import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rememora.operators import metrics
from rememora.params import DEFAULTS
from rememora.plans import sweeps
from rememora.sources import corpora, extraction_cache, runs, state, traces
from rememora.streaming import live


def write(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def test_locomo(spark, tmp_path):
    write(tmp_path / "l.json", [{
        "sample_id": "s1",
        "conversation": {
            "speaker_a": "Ann", "session_1_date_time": "1 May", "session_10": [{"speaker": "Ann", "text": "ten"}],
            "session_2": [{"speaker": "Bob", "content": "two"}, {"text": "three", "dia_id": "X9"}], "session_1": [{"speaker": "Ann", "text": "one"}]},
        "qa": [{"question": "q0", "answer": 5, "evidence": ["D2:1", "X9", "D", "see S10:T0"], "category": 2}, {"question": "q1"}]}])
    turns, qa = corpora.get_adapter("locomo")(spark, str(tmp_path / "l.json"))
    assert [(r["turn"], r["session"], r["speaker"], r["text"]) for r in turns.orderBy("turn").collect()] == [
        (0, 1, "Ann", "one"), (1, 2, "Bob", "two"), (2, 2, "unknown", "three"), (3, 10, "Ann", "ten")]
    rows = qa.orderBy("query_id").collect()
    assert list(rows[0]["evidence"]) == [1, 2, 3] and rows[0]["answer"] == "5" and rows[0]["category"] == "2"
    assert list(rows[1]["evidence"]) == [] and rows[1]["category"] == "unknown"


def test_longmemeval(spark, tmp_path):
    write(tmp_path / "m.json", [{
        "question_id": "q_abs", "question": "w", "answer": "a", "question_type": "multi", "haystack_session_ids": ["a", "b", "c"],
        "answer_session_ids": ["a", "b"], "haystack_sessions": [
            [{"role": "user", "content": "0"}, {"role": "assistant", "content": "1"}],
            [{"role": "user", "content": "2", "has_answer": True}, {"role": "user", "content": "3", "has_answer": False}],
            [{"role": "user", "content": "4"}]]}])
    turns, qa = corpora.get_adapter("longmemeval")(spark, str(tmp_path / "m.json"))
    row = qa.first()
    assert turns.count() == 5 and list(row["evidence"]) == [0, 1, 2] and row["abstention"] is True and row["task_type"] == "multi"
    with pytest.raises(KeyError):
        corpora.get_adapter("nope")


def test_sweep_files_of_all_shapes(spark, tmp_path):
    def point(**kw):
        return {"overrides": kw, "metrics": {"mrr": .5, "n": 4, "n_scored": 2}, "latencyMs": {"p50": 1, "p95": 2}}

    rounds = [{"name": "r", "knob": "k", "winner": {"value": 2}, "points": [point(k=1), point(k=2)]}]
    write(tmp_path / "a.json", {"timestamp": "t", "sweep_name": "graph", "rounds": rounds})
    write(tmp_path / "b.json", {"name": "wrapped", "result": {"rounds": rounds}})
    write(tmp_path / "c.json", {"result": {"name": "tau", "points": [point(x=1, y=1, z=0), point(x=2, y=3, z=0)]}})
    write(tmp_path / "d.json", {"points": [{"retrieverId": "ladder", "metrics": {"mrr": .8, "coverage": .6}, "latencyMs": 3.5}]})
    write(tmp_path / "e.json", {"points": [point(only=1)]})
    write(tmp_path / "broken.json", "{nope")
    write(tmp_path / "x.metrics.json", {"points": [point(q=1)]})
    rows = {(r["file"], r["knob"], r["value"]): r for r in runs.load_sweeps(spark, str(tmp_path)).collect()}
    assert set(rows) == {("a.json", "k", "1"), ("a.json", "k", "2"), ("b.json", "k", "1"), ("b.json", "k", "2"),
                         ("c.json", "x", "1"), ("c.json", "x", "2"), ("c.json", "y", "1"), ("c.json", "y", "3"),
                         ("d.json", "retriever", "ladder"), ("e.json", "only", "1")}
    a = rows["a.json", "k", "2"]
    assert a["is_winner"] and a["coverage"] == .5 and a["latency_p95"] == 2 and a["sweep_name"] == "graph" and a["round"] == "r"
    assert not rows["a.json", "k", "1"]["is_winner"] and rows["b.json", "k", "1"]["sweep_name"] == "wrapped"
    assert rows["c.json", "x", "1"]["sweep_name"] == "tau"
    d = rows["d.json", "retriever", "ladder"]
    assert d["latency_p50"] == 3.5 and d["latency_p95"] is None and d["sweep_name"] == "baselines"


def test_run_lines(spark, tmp_path):
    good = {"conversationId": "c1", "qa": {"question": "q", "answer": "a", "category": "1"}, "retrieved": [{"id": "e", "score": .5, "tier": 3}]}
    write(tmp_path / "one.jsonl", json.dumps(good) + "\n\n{broken\n" + json.dumps({"conversationId": "c2"}) + "\n")
    write(tmp_path / "one.metrics.json", {"envSnapshot": {"scorerId": "default", "gitSha": "abc"}})
    write(tmp_path / "two.jsonl", json.dumps(good))
    rows = runs.load_runs(spark, str(tmp_path)).orderBy("run", "conversation_id").collect()
    assert [(r["run"], r["n_retrieved"], r["top_id"], r["top_tier"], r["scorer_id"]) for r in rows] == [
        ("one", 1, "e", "3", "default"), ("one", 0, None, None, "default"), ("two", 1, "e", "3", None)]
    assert runs.load_runs(spark, str(tmp_path), run_id="two").count() == 1


def test_store(spark, tmp_path):
    store = state.Store()
    with pytest.raises(RuntimeError):
        store.load("entries")
    with pytest.raises(TypeError):
        store.set_backend(object())
    store.set_backend(state.ParquetBackend(spark, str(tmp_path / "s")))
    assert store.load("buffer").count() == 0
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "chat_id string, pos long, id string")
    store.persist("buffer", rows)
    store.persist("buffer", rows.filter("chat_id = 'a'").withColumn("id", F.lit("z")))
    assert {(r["chat_id"], r["id"]) for r in store.load("buffer").collect()} == {("a", "z"), ("b", "y")}
    with pytest.raises(ValueError):
        store.persist("buffer", rows.drop("pos"))
    for bad in ("", "__proto__", "a/b", ".."):
        with pytest.raises(ValueError):
            state.safe_chat_id(bad)


def test_read_through_asks_only_for_misses(spark):
    turns = spark.createDataFrame([("c", i, "user", f"text {i}") for i in range(7)], "chat_id string, turn long, role string, text string")
    requests = extraction_cache.enumerate_batches(turns, "m")
    known = requests.filter("batch = 0").select("key", F.lit("old").alias("answer"))
    answers, cache = extraction_cache.read_through(requests, known, lambda system, user: "new")
    assert {(r["batch"], r["answer"]) for r in answers.collect()} == {(0, "old"), (1, "new")} and cache.count() == 2
    thought = spark.createDataFrame([("a", "<think>x</think> yes"), ("b", "<think>only</think>  ")], "key string, answer string")
    assert [tuple(r) for r in extraction_cache.without_reasoning(thought).collect()] == [("a", "yes")]


@pytest.mark.parametrize("inputs,expected", [
    ({"state": {}, "queryStr": "hi"}, "hi"), ({"0": {}, "1": "one"}, "one"), ({"args": [{}, "two"]}, "two"),
    ({"arg0": {}, "arg1": "three"}, "three"), ({"arg1": "", "q": "four"}, "four"), ({"x": "longer text", "y": "short"}, "short"), ({"n": 1}, None),
    ({"query": 5}, None), ({"query": {"a": 1}, "q": "real"}, "real"), ({"arg1": None, "note": "x"}, None), ({"n": 1, "note": "x"}, "x")])
def test_query_text(spark, inputs, expected):
    df = spark.createDataFrame([(json.dumps(inputs),)], "i string")
    assert df.select(traces.query_text(F.col("i"))).first()[0] == expected


def test_metric_rules(spark):
    retrieved = spark.createDataFrame(
        [("c", 0, 1, "a", [1]), ("c", 0, 2, "b", [5]), ("c", 0, 3, "d", [2, 5]), ("c", 1, 1, "a", [1]), ("c", 3, 1, "a", [9])],
        "chat_id string, query_id long, rank long, id string, source_messages array<long>")
    qa = spark.createDataFrame([("c", 0, [5], "t", False), ("c", 1, [7], "t", False), ("c", 2, [7], None, False), ("c", 3, [9], "t", True)],
                               "chat_id string, query_id long, evidence array<long>, task_type string, abstention boolean")
    scores = metrics.per_query(retrieved, qa)
    first = scores.filter("query_id = 0").first()
    assert first["mrr"] == .5 and first["precision_1"] == 0 and first["precision_3"] == pytest.approx(2 / 3)
    assert first["precision_10"] == pytest.approx(2 / 3) and first["recall_1"] == 0 and first["recall_3"] == 1
    total = metrics.summarize(scores).first()
    assert (total["n"], total["n_scored"], total["n_skipped"], total["abstentions"]) == (3, 1, 2, 1)
    assert total["coverage"] == pytest.approx(1 / 3) and total["mrr"] == .5
    typed = metrics.by_task_type(scores).collect()
    assert [(r["task_type"], r["n_scored"], r["n_skipped"]) for r in typed] == [("t", 1, 1)]


def test_elbow_amendment_descent(spark):
    def chosen(values):
        df = spark.createDataFrame([(float(x), float(y)) for x, y in values], "k double, mrr double")
        return sweeps.elbow(df, "k", "mrr", defaults={"k": 7.0}).first()

    bend = chosen([(1, .5), (2, .7), (3, .701), (4, .702)])
    assert bend["k"] == 2 and bend["rationale"] == "elbow"
    flat = chosen([(1, .5), (2, .501), (3, .5)])
    assert flat["k"] == 7 and flat["rationale"] == "flat axis"
    steep = chosen([(1, .1), (2, .3), (3, .5)])
    assert steep["k"] == 3 and steep["rationale"] == "best point"
    gate = spark.createDataFrame([(.5, .6, .53, .6), (.5, .6, .51, .6), (.5, .6, .6, .5), (.5, .6, None, .6)],
                                 "a double, b double, c double, d double")
    assert [r[0] for r in gate.select(sweeps.amendment(*map(F.col, "abcd"))).collect()] == [
        "amend", "hold: gain too small", "hold: coverage falls", "hold: not comparable"]
    best, history = sweeps.coordinate_descent([("beam_width", [3, 5, 8]), ("seeds_k", [1, 3])],
                                              lambda p: -abs(p.beam_width - 5) - p.seeds_k)
    assert (best.beam_width, best.seeds_k) == (5, 1) and [h["winner"] for h in history] == [5, 1]
    assert len(sweeps.grid({"a": [1, 2], "b": [3, 4, 5]})) == 6


def stream_of(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    return spark.readStream.schema(schema).json(str(tmp_path / "in"))


OPS = "chat_id string, seq long, op string, turn long, role string, text string"


def test_buffer_stream_retracts_and_fires(spark, tmp_path):
    rows = [("c", i, "message", i, "user", f"t{i}") for i in range(5)]
    rows += [("c", 5, "delete", 2, None, None), ("c", 6, "message", 6, "user", " "), ("c", 7, "message", 7, "user", "t7"),
             ("d", 8, "message", 0, "user", "other")]
    stream = stream_of(spark, tmp_path, rows, OPS)
    fired = live.drain(live.fired_batches(stream, DEFAULTS.override(buffer_threshold=4, batch_size=2)), "test")
    got = [(r["chat_id"], r["fire"], r["reason"], list(r["turns"])) for r in fired.orderBy("fire").collect()]
    # 0..3 fire and drain 0, 1; then 2 is retracted, so 3, 4, 7 stay below the threshold
    assert got == [("c", 0, "buffer", [0, 1])]


def test_idle_timer_drains_what_is_left(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [("c", 0, "message", 0, "user", "alone")], OPS)
    import dataclasses
    quick = dataclasses.replace(DEFAULTS, idle_seconds=1)
    with live.keyed_state(spark):
        running = (live.fired_batches(stream, quick, idle=True).writeStream.format("memory").queryName("idle_out")
                   .option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start())
        try:
            for _ in range(60):
                time.sleep(.5)
                rows = spark.sql("SELECT * FROM idle_out").collect()
                if rows:
                    break
        finally:
            running.stop()
    assert [(r["reason"], list(r["turns"])) for r in rows] == [("idle", [0])]


def test_cache_stream_routes_and_forgets(spark, tmp_path):
    schema = "chat_id string, seq long, op string, query string, tier string, ids array<string>"
    rows = [("c", 1, "query", "alice in paris", "3", ["a"]), ("c", 2, "query", " Alice in Paris", "3", ["b"]),
            ("c", 3, "query", "alice in paris now", "3", ["x"]), ("c", 4, "write", None, None, None),
            ("c", 5, "query", "alice in paris", "3", ["y"]), ("c", 6, "query", "zebra", "floor", ["f"]), ("c", 7, "query", "zebra", "floor", ["f"])]
    routed = live.drain(live.routed_queries(stream_of(spark, tmp_path, rows, schema)), "test")
    assert [(r["seq"], r["tier"], list(r["ids"])) for r in routed.orderBy("seq").collect()] == [
        (1, "3", ["a"]), (2, "0", ["a"]), (3, "1", ["a"]), (5, "1", ["a"]), (6, "floor", ["f"]), (7, "floor", ["f"])]


def test_cache_stream_equals_a_plain_fold(spark, tmp_path):
    """Evictions, rewrites, writes and near queries at a small cap, over several micro-batches, against one scan a query."""
    import random
    draw, cap, t = random.Random(5), 4, DEFAULTS.fuzzy_threshold
    words = ["ann", "bob", "cat", "dog", "eel", "fox"]
    asked = [(c, i, "write" if draw.random() < .05 else "query", " ".join(draw.sample(words, draw.randint(1, 4))),
              draw.choice(["3", "3", "3", "floor"]), [f"n{i}"] if i % 9 else []) for i in range(300) for c in ("p", "q")]
    want = []
    for chat in ("p", "q"):
        exact, fuzzy = {}, {}  # key: ids, in order of writes

        def put(cache, key, ids):
            cache.pop(key, None)
            cache[key] = ids
            if len(cache) > cap:
                del cache[next(iter(cache))]
        for _, seq, op, query, tier, ids in [r for r in asked if r[0] == chat]:
            if op == "write":
                exact = {}
                continue
            key, tokens = query, set(query.split())
            scored = [(-len(tokens & set(k.split())) / len(tokens | set(k.split())), n, v) for n, (k, v) in enumerate(fuzzy.items())]
            near = min(scored, key=lambda r: r[:2], default=None)
            if exact.get(key):
                tier, ids = "0", exact[key]
            elif near and -near[0] >= t:
                tier, ids = "1", near[2]
                put(exact, key, ids)
            elif tier == "3":
                put(exact, key, ids)
                put(fuzzy, " ".join(sorted(tokens)), ids)
            want.append((chat, seq, tier, ids))
    schema = "chat_id string, seq long, op string, query string, tier string, ids array<string>"
    for n in range(3):
        part = [r for r in asked if n * 100 <= r[1] < n * 100 + 100]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken by their time
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    routed = live.drain(live.routed_queries(stream, DEFAULTS.override(cache_cap=cap)), "folded")
    got = [(r["chat_id"], r["seq"], r["tier"], list(r["ids"])) for r in routed.orderBy("chat_id", "seq").collect()]
    assert got == want and {r[2] for r in want} == {"0", "1", "3", "floor"}


def test_stored_entries_are_seeded_and_read_in_parts():
    class Map(dict):
        def updateValue(self, key, value):
            self[key] = value

        def getValue(self, key):
            return self.get(key)

    chat = live.ChatProcessor(DEFAULTS, False)
    chat.lives, chat.stored, chat.seeded = Map(), Map(), None
    frame = lambda low, high: pd.DataFrame([("entry", f"e{k}", float(k), k, 0) for k in range(low, high)],
                                           columns=["part", "id", "importance", "access_count", "update_count"]).assign(
        seq=None, turn=-1, role=None, text=None, added=0, rebuild_due=False)
    chat.handleInitialState(("c",), frame(0, 1000), None)
    assert len(chat.stored) == 16 and not chat.lives
    # a later frame of the same chat wins
    chat.handleInitialState(("c",), frame(999, 1002).assign(update_count=7), None)
    read = {}
    assert [chat._life(f"e{k}", read) for k in (0, 500, 998)] == [(float(k), k, 0, None) for k in (0, 500, 998)]
    assert [chat._life(f"e{k}", read) for k in (999, 1001)] == [(float(k), k, 7, None) for k in (999, 1001)]
    assert chat._life("e1002", read) is None and len(read) <= 5


class _Fake(dict):
    """A keyed state in plain Python; ``calls`` counts what went to it."""
    calls = 0

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def getValue(self, key):
        self.calls += 1
        return self.get(key)


class _FakeValue:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    update = put = lambda self, value: setattr(self, "value", value)

    def clear(self):
        self.value = None

    def appendList(self, rows):
        self.value = (self.value or []) + rows


def test_a_shard_of_chats_equals_its_chats_one_by_one(monkeypatch):
    monkeypatch.setattr(live, "PART_ENTRIES", 2)
    import dataclasses
    import random
    knobs = dataclasses.replace(DEFAULTS, buffer_threshold=4, batch_size=2, rebuild_suggestion=3)
    rng, names = random.Random(3), [f"c{n}" for n in range(9)] + [None, ""]
    entries = {c: [(f"e{k}", float(k), k, 0) for k in range(rng.choice([0, 1, 5, 30]))] for c in names[:8]}
    turns = {c: [(k, "user", f"t{k}") for k in range(rng.randrange(4))] for c in names[:8]}
    shard = live.ShardProcessor(knobs)
    shard.chats, shard.parts, shard.now, shard.shard, shard.begun = _Fake(), _Fake(), None, None, set()

    def pieces(size):
        for c, found in entries.items():
            for begin in range(0, max(1, len(found)), size):
                part = list(zip(*found[begin:begin + size], strict=True)) or [()] * 4
                first = begin == 0
                yield (c, *part, *([*zip(*turns[c], strict=True)] if first and turns[c] else [()] * 3), (1,) if first else (), (False,) if first else ())

    columns = ["chat_id", "ids", "importance", "accesses", "updates", "turns", "roles", "contents", "added", "due"]
    shard.handleInitialState((1,), pd.DataFrame(list(pieces(1_000)), columns=columns), None)
    # a chat is written without being read, in one call if its entries fit one part
    assert shard.chats.calls == len(entries) and 0 < shard.parts.calls <= sum(max(0, -(-len(e) // 2) - 1) for e in entries.values() if e)
    seeded = dict(shard.chats), dict(shard.parts)
    for size in (1_000, 7):  # a large chat may come in pieces, and not all at once
        shard.chats, shard.parts, shard.shard = _Fake(), _Fake(), None
        split = pd.DataFrame(list(pieces(size)), columns=columns)
        shard.handleInitialState((1,), split.iloc[:4], None)
        shard.handleInitialState((1,), split.iloc[4:], None)
        assert size < 1_000 or (dict(shard.chats), dict(shard.parts)) == seeded

        alone = {}
        for c in names:
            chat = alone[c] = live.ChatProcessor(knobs, False)
            chat.lives, chat.stored, chat.buffer, chat.fires, chat.rebuild = _Fake(), _Fake(), _FakeValue(), _FakeValue(), _FakeValue()
            chat.buffer.value, chat.seeded = [], None
            chat.buffer.clear = lambda chat=chat: setattr(chat.buffer, "value", [])
            if c in entries:
                rows = [("entry", None, *e, -1, None, None, 0, False) for e in entries[c]]
                rows += [("turn", k, None, 0.0, 0, 0, *t, 0, False) for k, t in enumerate(turns[c])] + [("chat", None, None, 0.0, 0, 0, -1, None, None, 1, False)]
                chat.handleInitialState((c,), pd.DataFrame(rows, columns=["part", "seq", "id", "importance", "access_count", "update_count",
                                                                          "turn", "role", "text", "added", "rebuild_due"]), None)
        kinds = ["message", "message", "access", "update", "fact", "rebuilt", "switch", "delete", "swipe", "odd"]
        for batch in range(3):
            rows = [(rng.choice(names), 1_000 * batch + k, rng.choice(kinds), rng.choice([None, *range(8)]), "user", rng.choice(["x", " ", None]),
                     rng.choice([None, *(f"e{n}" for n in range(40))])) for k in range(400)]
            rng.shuffle(rows)
            frame = pd.DataFrame(rows, columns=["chat_id", "seq", "op", "turn", "role", "text", "id"])
            got = [r for f in shard.handleInputRows((1,), iter([frame.iloc[:150], frame.iloc[150:]]), None) for r in f.itertuples(index=False, name=None)]
            want = [r for c, chat in alone.items() if len(mine := frame[frame["chat_id"].map(lambda x: x == c)]) for f in chat.handleInputRows(
                (c,), iter([mine]), None) for r in f.itertuples(index=False, name=None)]
            order = lambda r: (str(r[0]), r[1], r[2])
            assert sorted(got, key=order) == sorted(want, key=order) and len(got) > 50
        assert max(len(json.loads(v[0])) for v in shard.parts.values()) <= 16 and len(shard.parts) > 30


def test_chat_stream_starts_from_stored_state(spark, tmp_path):
    ops = OPS + ", id string"
    rows = [("c", 1, "message", 7, "user", "new", None), ("c", 2, "swipe", 5, None, None, None), ("c", 3, "message", 8, "user", "more", None),
            ("c", 4, "access", None, None, None, "a"), ("c", 5, "fact", None, None, None, "a"), ("c", 6, "fact", None, None, None, "n"),
            ("c", 7, "update", None, None, None, "gone"), ("c", 8, "access", None, None, None, None),
            ("c", 9, "delete", None, None, None, None), ("c", 10, "rebuilt", None, None, None, None),
            ("c", 11, "fact", None, None, None, "n"), ("c", 12, "message", None, "user", "no turn", None), ("c", 13, "odd", None, None, None, None),
            ("d", 1, "switch", None, None, None, None)]
    entries = spark.createDataFrame([("c", "a", 96.0, 1), ("c", None, 1.0, 0), (None, "x", 1.0, 0), ("e", "a", None, None)],
                                    "chat_id string, id string, importance double, access_count long")
    turns = spark.createDataFrame([("c", 1, 4, "user", "t4"), ("c", 2, 5, "user", "t5"), ("d", 0, 1, "user", "x"), ("d", 1, 2, "user", "y"),
                                   ("d", 2, 3, "user", "z")], "chat_id string, seq long, turn long, role string, text string")
    chats = spark.createDataFrame([("c", 2, False)], "chat_id string, added long, rebuild_due boolean")
    import dataclasses
    knobs = dataclasses.replace(DEFAULTS, buffer_threshold=3, batch_size=2, rebuild_suggestion=3)
    out = live.drain(live.lived(stream_of(spark, tmp_path, rows, ops), live.stored_state(entries, turns, chats), knobs), "seeded")
    got = [tuple(r) for r in out.select("chat_id", "seq", "kind", "turns", "id", "importance", "access_count", "update_count",
                                        "updated_seq", "added", "rebuild_due").orderBy("chat_id", "seq").collect()]
    none = (None,) * 7
    # the seeded turns 4, 5 and turn 7 fire at once; 5 is gone by then, so the swipe retracts nothing
    assert got == [
        ("c", 1, "buffer", [4, 5]) + none,
        ("c", 4, "access", None, "a", 99.0, 2, 0, None, None, None),
        ("c", 5, "update", None, "a", 100.0, 2, 1, 5, None, None),
        ("c", 6, "added", None, "n", 50.0, 0, 0, 6, 3, True),
        ("c", 10, "rebuilt") + (None,) * 6 + (0, False),
        ("c", 11, "update", None, "n", 55.0, 0, 1, 11, None, None),
        ("c", 12, "buffer", [7, 8]) + none,
        ("d", 1, "buffer", [1, 2]) + none]
    assert [m["content"] for m in out.filter("seq = 12").first()["messages"]] == ["new", "more"]


def _stored(spark, rows):
    """Entries of ``(chat, id, importance)`` with the rest of their columns filled in."""
    frame = spark.createDataFrame(rows, "chat_id string, id string, importance double")
    shape = spark.createDataFrame([], state.STATE_TABLES["entries"]).schema
    return frame.select(*[f.name if f.name in frame.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in shape])


def test_buckets_hold_deltas_versions_and_conflicts(spark, tmp_path, monkeypatch):
    backend = state.BucketBackend(spark, str(tmp_path / "b"), buckets=4, max_parts=3)
    shown = lambda **at: sorted((r.chat_id, r.id, r.importance) for r in backend.read("entries", **at).collect())
    assert shown() == [] and backend.version("entries") == 0 and backend.compact("entries") == 0
    assert backend.write("entries", _stored(spark, [(f"c{i}", "a", float(i)) for i in range(30)] + [(None, "x", 0.0)])) == 1
    # files go with buckets, not with chats
    assert len(list((tmp_path / "b" / "entries").glob("part-*/rows/bucket=*"))) == 4
    assert len(list((tmp_path / "b" / "entries").glob("part-*/rows/*/*.parquet"))) <= 8
    # two writers from one version: one is refused and leaves no trace
    mine, other = _stored(spark, [("c1", "mine", 1.0)]), _stored(spark, [("c1", "other", 2.0), ("c2", "other", 2.0)])
    assert backend.write("entries", other, at=1) == 2
    with pytest.raises(state.Conflict):
        backend.write("entries", mine, at=1)
    real = backend._add
    monkeypatch.setattr(backend, "_add", lambda *args: (monkeypatch.setattr(backend, "_add", real), real(*args),
                                                       backend.write("entries", other, at=2))[1])
    with pytest.raises(state.Conflict):  # overtaken after its rows were written
        backend.write("entries", mine, at=2)
    assert backend.version("entries") == 3 and backend.vacuum("entries", keep=3) == 1
    want = sorted([(f"c{i}", "a", float(i)) for i in range(30) if i not in (1, 2)] + [("c1", "other", 2.0), ("c2", "other", 2.0)])
    assert shown() == want and shown(version=1) == sorted((f"c{i}", "a", float(i)) for i in range(30))
    # a write without a version goes on top and, with four parts, compacts; a chat may be emptied
    assert backend.write("entries", mine, chats=spark.createDataFrame([("c3",), (None,)], "chat_id string")) == 5
    want = sorted([r for r in want if r[0] not in ("c1", "c3")] + [("c1", "mine", 1.0)])
    assert shown() == want and len(backend._manifest("entries", 5)["parts"]) == 1
    one = state.Store(backend).load("entries", ["c4"])
    assert [r.id for r in one.collect()] == ["a"]
    assert "bucket" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]
    # the four parts before the compaction and four old manifests go
    assert backend.vacuum("entries", keep=1) == 4 + 4 and shown() == want


def test_compaction_keeps_what_came_meanwhile(spark, tmp_path, monkeypatch):
    backend = state.BucketBackend(spark, str(tmp_path / "b"), buckets=2)
    backend.write("entries", _stored(spark, [("p", "a", 1.0), ("q", "a", 1.0)]))
    backend.write("entries", _stored(spark, [("p", "b", 2.0)]))
    real = backend._commit

    def overtaken(name, version, manifest):
        monkeypatch.setattr(backend, "_commit", real)
        backend.write("entries", _stored(spark, [("q", "c", 3.0)]))
        return real(name, version, manifest)
    monkeypatch.setattr(backend, "_commit", overtaken)
    assert backend.compact("entries") == 4
    assert sorted((r.chat_id, r.id) for r in backend.read("entries").collect()) == [("p", "b"), ("q", "c")]
    assert len(backend._manifest("entries", 4)["parts"]) == 2
