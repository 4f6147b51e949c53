import json

import pytest

import check_oracle
import __spark_entry__ as entry

# order-dependent random streams and iterative clustering have no SQL form
WITHOUT_SQL = {"baseline_random", "leiden", "persona_rebuild"}
CHECKED = ["bm25_topk", "floor_topk", "cooccurrence_edges_capped", "ladder_snapshot", "dedup_fold", "consolidated_entries",
           "ir_metrics", "knn_topk", "latency_percentiles_floor", "elbow", "viewer_grouped_limit", "stratified_sample"]


def test_every_query_has_sql_or_a_reason():
    optional = set(entry.llm.QUERIES) | {"pipeline"} if entry.llm else set()
    assert set(entry.queries()) - set(entry.oracle_sql()) - optional == WITHOUT_SQL
    assert not set(entry.oracle_sql()) - set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, small, name):
    got = entry.queries()[name](spark, small).toPandas()
    want = check_oracle.connect(small).execute(entry.oracle_sql()[name]).df()
    assert check_oracle.compare(got, want) == ""


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_neighbours_cover_all_events(spark, small):
    """Edges of odd and even events of every user, without those heavier than the mean."""
    edges = {}
    for e in spark.read.parquet(f"{small}/events.parquet").collect():
        kind = {"purchase": "supports", "click": "mentions"}.get(e.event_type, "same_topic")
        key = (str(e.user_id % 10), str(e.user_id), str(json.loads(e.props)["k"]), kind)
        weight, seq = edges.get(key, (e.value, e.event_id))
        edges[key] = max(weight, e.value), min(seq, e.event_id)
    mean = sum(w for w, _ in edges.values()) / len(edges)
    want, places = [], {}
    for key, (weight, seq) in sorted(edges.items(), key=lambda x: x[1][1]):
        if weight <= mean:
            places[key[:2]] = places.get(key[:2], 0) + 1
            want.append((*key, places[key[:2]]))
    got = entry.queries()["edge_neighbours_all"](spark, small).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    users = {r.from_id for r in got}
    assert any(int(u) % 2 for u in users) and any(int(u) % 4 == 2 for u in users)
