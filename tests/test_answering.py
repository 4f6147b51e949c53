from pyspark.sql import functions as F

from rememora.operators import graph
from rememora.plans import answering
from rememora.schema import ENTRY
from rememora.sources.state import ParquetBackend, Store


def test_a_request_answers_and_leaves_its_marks(spark, tmp_path):
    at = F.lit("2026-04-20T10:00:00Z").cast("timestamp")
    rows = [("c", f"e{i}", i, scope, text, None, ["t"], [], 50.0, "draft", None, None, 0, 0, [i], "x") for i, (scope, text) in enumerate([
        ("episodic", "Alice lives in Marseille"), ("episodic", "Bob is from Paris"), ("working", "fresh message")])]
    entries = spark.createDataFrame(rows, ENTRY).withColumn("created_at", at).withColumn("updated_at", at)
    store = Store(ParquetBackend(spark, str(tmp_path / "state")))
    store.persist("entries", entries)
    store.persist("edges", graph.build_edges(entries))
    store.persist("buffer", spark.createDataFrame([("c", 0, "e2")], "chat_id string, pos long, id string"))
    turns = spark.createDataFrame([("c", 0, "user", "hello"), ("c", 1, "user", "Where does Alice live?"), ("c", 2, "assistant", "?")],
                                  "chat_id string, turn long, role string, text string")
    block = answering.answer(store, turns, at).first()["block"]
    assert block.startswith("Retrieved memories:\n- fresh message\n- Alice lives in Marseille")
    again = turns.withColumn("turn", F.col("turn") + 5)
    assert answering.answer(store, again, at, cause="swipe").first()["block"] == block
    state = {r["id"]: r for r in store.load("entries").collect()}
    assert state["e0"]["importance"] == 56 and state["e0"]["access_count"] == 2 and state["e2"]["access_count"] == 0
    traces = store.load("traces").orderBy("seq").collect()
    assert [(t["tier"], t["cause"], list(t["ranking"])[0]) for t in traces] == [("3", None, "e2"), ("0", "swipe", "e2")]
    assert store.load("fuzzy_cache").first()["key"] == "alice does live where"
    assert answering.answer(store, turns, at, mode="off") is None
