"""Spark schemas of the persisted tables and of the corpora."""

from __future__ import annotations

ENTRY = (
    "chat_id string, id string, seq long, scope string, content string, subject string, tags array<string>, "
    "relations array<struct<type:string,target:string>>, importance double, maturity string, "
    "created_at timestamp, updated_at timestamp, access_count long, update_count long, "
    "source_messages array<long>, extractor string")
EDGE = "chat_id string, from_id string, to_id string, type string, weight double, seq long"
BUFFER = "chat_id string, pos long, id string"
CACHE = "chat_id string, key string, ids array<string>, written long"
TRACE = (
    "chat_id string, seq long, kind string, at timestamp, query string, intent string, tier string, "
    "per_tier map<string,array<struct<id:string,bm25:double,score:double>>>, ranking array<string>, "
    "scorer string, cause string, fact_count long, added long, updated long, duration_ms long, error string")
STATE_TABLES = {"entries": ENTRY, "edges": EDGE, "buffer": BUFFER, "exact_cache": CACHE,
                "fuzzy_cache": CACHE, "traces": TRACE}

METRICS = ("struct<mrr:double,coverage:double,n:long,n_scored:long,n_skipped:long>")
SWEEP_POINT = (f"struct<overrides:map<string,string>,metrics:{METRICS},latencyMs:string,retrieverId:string>")
SWEEP_ROUND = f"struct<name:string,knob:string,winner:struct<value:string>,points:array<{SWEEP_POINT}>>"
SWEEP_FILE = (
    f"timestamp string, sweep_name string, name string, rounds array<{SWEEP_ROUND}>, points array<{SWEEP_POINT}>, "
    f"result struct<name:string,rounds:array<{SWEEP_ROUND}>,points:array<{SWEEP_POINT}>>")
RUN_LINE = (
    "conversationId string, qa struct<question:string,answer:string,category:string>, "
    "retrieved array<struct<id:string,score:double,tier:string>>, latencyMs double")
RUN_META = "envSnapshot struct<scorerId:string,gitSha:string,nodeVersion:string>"
SESSION_TURNS = "array<struct<speaker:string,text:string,content:string,dia_id:string>>"
LOCOMO_SAMPLE = (
    "sample_id string, id string, conversation map<string,string>, "
    "qa array<struct<question:string,answer:string,evidence:array<string>,category:string>>")
LONGMEM_ITEM = (
    "question_id string, question string, answer string, question_type string, "
    "haystack_session_ids array<string>, answer_session_ids array<string>, "
    "haystack_sessions array<array<struct<role:string,content:string,has_answer:boolean>>>")
