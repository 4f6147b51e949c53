"""Plain SQL for the registered queries, built from shared table expressions."""

from __future__ import annotations

from rememora.functions import extraction
from rememora.params import EDGE_TYPE_WEIGHTS, ENTITY_STOP_WORDS

NOW_S = 1735689600  # 2025-01-01 00:00:00 UTC
STOP = ", ".join(f"'{w}'" for w in ENTITY_STOP_WORDS)


def tok(x: str) -> str:
    return (f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^a-z0-9]+'), "
            f"lambda t: length(t) >= 2)")


def ents(x: str) -> str:
    return (f"list_filter(regexp_extract_all(coalesce({x}, ''), '\\b[A-Z][a-z]{{2,}}\\b'), "
            f"lambda w: w NOT IN ({STOP}))")


def recency(created: str) -> str:
    return f"exp(-greatest(0.0, ({NOW_S} - {created}) / 86400.0) / 30.0)"


BOOST = "CASE maturity WHEN 'draft' THEN 0.85 WHEN 'validated' THEN 1.0 ELSE 1.2 END"
PRIOR = f"((1 + importance / 100) * {recency('created_s')} * {BOOST})"

ENTRIES = f"""entries AS (
  SELECT lang AS chat_id, 'd' || doc_id AS id, doc_id AS seq,
         CASE source WHEN 'src0' THEN 'working' WHEN 'src1' THEN 'persona' ELSE 'episodic' END AS scope,
         text AS content, {ents('text')}[1] AS subject, [source] AS tags,
         ((doc_id * 37) % 101)::DOUBLE AS importance,
         CASE WHEN (doc_id * 37) % 101 >= 85 THEN 'core' WHEN (doc_id * 37) % 101 >= 65 THEN 'validated'
              ELSE 'draft' END AS maturity,
         1704067200 + ((doc_id * 7919) % 8760) * 3600 AS created_s
  FROM documents)"""

QUERIES = """queries AS (
  SELECT CASE WHEN regexp_matches(lower(text), '(^|[^a-z])(the|of|that)([^a-z]|$)') THEN 'en'
              WHEN regexp_matches(lower(text), '(^|[^a-z])(der|die|und)([^a-z]|$)') THEN 'de'
              WHEN regexp_matches(lower(text), '(^|[^a-z])(el|los|las|y)([^a-z]|$)') THEN 'es'
              ELSE 'fr' END AS chat_id,
         item_id AS query_id, text AS query
  FROM benchmark)"""


def bm25(pool: str = "entries WHERE scope <> 'working'", queries: str = "queries") -> str:
    return f"""
pooled AS (SELECT * FROM {pool}),
doc_tokens AS (
  SELECT chat_id, id, seq,
         list_concat({tok('content')}, {tok('subject')}, {tok('subject')},
                     {tok("array_to_string(tags, ' ')")}, {tok("array_to_string(tags, ' ')")}) AS toks
  FROM pooled),
doc_len AS (SELECT chat_id, id, len(toks) AS len FROM doc_tokens),
stats AS (SELECT chat_id, count(*) AS n_docs, avg(len) AS avg_len FROM doc_len GROUP BY chat_id),
postings AS (
  SELECT chat_id, id, seq, term, count(*) AS tf
  FROM (SELECT chat_id, id, seq, unnest(toks) AS term FROM doc_tokens) GROUP BY ALL),
df AS (SELECT chat_id, term, count(*) AS df FROM postings GROUP BY ALL),
q_terms AS (
  SELECT DISTINCT chat_id, query_id, term
  FROM (SELECT chat_id, query_id, unnest({tok('query')}) AS term FROM {queries})),
scores AS (
  SELECT q.chat_id, q.query_id, p.id, p.seq,
         round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.2)
                   / (tf + 1.2 * (0.25 + 0.75 * (len / avg_len))) + 1.0), 10) AS bm25
  FROM q_terms q JOIN postings p USING (chat_id, term) JOIN df USING (chat_id, term)
  JOIN doc_len l ON l.chat_id = p.chat_id AND l.id = p.id JOIN stats s ON s.chat_id = p.chat_id
  GROUP BY ALL)"""


TIER2 = f"""
t2_raw AS (
  SELECT *, row_number() OVER (PARTITION BY chat_id, query_id ORDER BY bm25 DESC, seq) AS bm25_rank
  FROM scores QUALIFY bm25_rank <= 10),
t2_scored AS (
  SELECT r.chat_id, r.query_id, r.id, r.bm25, r.bm25_rank, e.importance, e.maturity, e.created_s,
         round(r.bm25 * {PRIOR}, 10) AS score
  FROM t2_raw r JOIN entries e ON e.chat_id = r.chat_id AND e.id = r.id),
t2 AS (
  SELECT *, row_number() OVER (PARTITION BY chat_id, query_id ORDER BY score DESC, bm25_rank) AS rank
  FROM t2_scored WHERE score > 0)"""

EDGES = f"""
entity_postings AS (
  SELECT DISTINCT chat_id, id, seq, unnest({ents('content')}) AS entity FROM entries WHERE scope <> 'working'),
edge_pairs AS (
  SELECT DISTINCT a.chat_id, a.id AS from_id, b.id AS to_id, b.seq AS to_seq
  FROM entity_postings a JOIN entity_postings b USING (chat_id, entity) WHERE a.seq > b.seq),
edges AS (
  SELECT chat_id, from_id, to_id, 'mentions' AS type, 0.5 AS weight,
         row_number() OVER (PARTITION BY chat_id, from_id ORDER BY to_seq) AS seq
  FROM edge_pairs QUALIFY seq <= 20)"""

INTENT = r"""CASE WHEN trim(query) = '' THEN 'factual'
  WHEN regexp_matches(query, '(?i)\bwhen\b') OR regexp_matches(query, '(?i)\b(before|after|during|recently|yesterday|today)\b')
    OR regexp_matches(query, '(?i)\blast\s+(week|month|year|time)\b') OR regexp_matches(query, '\b(19|20|21)[0-9]{2}\b')
    OR regexp_matches(query, '(?i)\bago\b') THEN 'temporal'
  WHEN regexp_matches(query, '(?i)\bwho\b') OR regexp_matches(query, '(?i)\bwith\s+whom\b')
    OR regexp_matches(query, '(?i)\btogether\b') OR regexp_matches(query, '(?i)\brelated\b')
    OR regexp_matches(query, '(?i)\bconnection\b') OR regexp_matches(query, '(?i)\bbetween\s+\w+\s+and\s+\w+')
    OR regexp_matches(query, '(?i)\brelate(s|d)?\b') OR regexp_matches(query, '\b[A-Z][a-z]+\s+(and|&|,)\s+[A-Z][a-z]+')
    THEN 'relational' ELSE 'factual' END"""

AFFINITY = ("CASE type || '/' || intent " + " ".join(
    f"WHEN '{kind}/{intent}' THEN {value}" for kind, row in EDGE_TYPE_WEIGHTS.items()
    for intent, value in row.items()) + " ELSE 0 END")


def hop(n: int) -> str:
    earlier = " UNION ALL ".join(f"SELECT chat_id, query_id, id FROM beam{i}" for i in range(n))
    return f"""
reached{n} AS (
  SELECT f.chat_id, f.query_id, e.to_id AS id, f.intent, f.pos AS from_pos, e.seq AS edge_seq, e.type
  FROM beam{n - 1} f JOIN edges e ON e.chat_id = f.chat_id AND e.from_id = f.id
  JOIN pooled p ON p.chat_id = f.chat_id AND p.id = e.to_id
  WHERE NOT EXISTS (SELECT 1 FROM ({earlier}) d
                    WHERE d.chat_id = f.chat_id AND d.query_id = f.query_id AND d.id = e.to_id)),
beam{n} AS (
  SELECT r.chat_id, r.query_id, r.id, r.intent,
         row_number() OVER (PARTITION BY r.chat_id, r.query_id
                            ORDER BY round({AFFINITY} + 0.3 * coalesce(s.bm25, 0), 10) DESC, from_pos, edge_seq) AS pos
  FROM reached{n} r LEFT JOIN scores s ON s.chat_id = r.chat_id AND s.query_id = r.query_id AND s.id = r.id
  QUALIFY pos <= 5)"""


def tier3(k: int = 5, queries: str = "queries") -> str:
    return f"""
intents AS (SELECT chat_id, query_id, {INTENT} AS intent FROM {queries}),
beam0 AS (SELECT t.chat_id, t.query_id, t.id, i.intent, t.rank AS pos
          FROM t2 t JOIN intents i ON i.chat_id = t.chat_id AND i.query_id = t.query_id WHERE t.rank <= 3),
{hop(1)},
{hop(2)},
found AS (
  SELECT chat_id, query_id, id, hop, min(pos) AS pos FROM (
    SELECT *, 0 AS hop FROM beam0 UNION ALL SELECT *, 1 FROM beam1 UNION ALL SELECT *, 2 FROM beam2)
  GROUP BY ALL),
t3_scored AS (
  SELECT f.chat_id, f.query_id, f.id, f.hop, f.pos, s.bm25, round(s.bm25 * {PRIOR}, 10) AS score
  FROM found f JOIN scores s ON s.chat_id = f.chat_id AND s.query_id = f.query_id AND s.id = f.id
  JOIN entries e ON e.chat_id = f.chat_id AND e.id = f.id),
t3 AS (
  SELECT *, row_number() OVER (PARTITION BY chat_id, query_id ORDER BY score DESC, hop, pos) AS rank
  FROM t3_scored WHERE score > 0 QUALIFY rank <= {k})"""


def floor(k: int = 5) -> str:
    return f"""
floor_rows AS (
  SELECT chat_id, id, round({PRIOR}, 10) AS score,
         row_number() OVER (PARTITION BY chat_id ORDER BY round({PRIOR}, 10) DESC, seq) AS rank
  FROM entries WHERE scope <> 'working' QUALIFY rank <= {k})"""


def ladder(queries: str = "queries") -> str:
    return f"""
ladder AS (
  SELECT chat_id, query_id, rank, id, '3' AS tier, bm25, score FROM t3
  UNION ALL
  SELECT q.chat_id, q.query_id, f.rank, f.id, 'floor', 0.0, f.score
  FROM {queries} q JOIN floor_rows f USING (chat_id)
  WHERE NOT EXISTS (SELECT 1 FROM t3 WHERE t3.chat_id = q.chat_id AND t3.query_id = q.query_id))"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


ORACLE: dict[str, str] = {}

ORACLE["tokenize_term_freq"] = f"""
SELECT doc_id, term, count(*) AS tf
FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM documents) GROUP BY doc_id, term"""
ORACLE["bm25_topk"] = with_(ENTRIES, QUERIES, bm25()) + """
SELECT chat_id, query_id, rank, id, round(bm25, 6) AS bm25 FROM (
  SELECT *, row_number() OVER (PARTITION BY chat_id, query_id ORDER BY bm25 DESC, seq) AS rank FROM scores)
WHERE rank <= 10"""
ORACLE["baseline_bm25only"] = with_(ENTRIES, QUERIES, bm25("entries")) + """
SELECT chat_id, query_id, rank, id, round(bm25, 6) AS bm25 FROM (
  SELECT *, row_number() OVER (PARTITION BY chat_id, query_id ORDER BY bm25 DESC, seq) AS rank FROM scores)
WHERE rank <= 5"""
ORACLE["tier2_rescored"] = with_(ENTRIES, QUERIES, bm25(), TIER2) + """
SELECT chat_id, query_id, rank, id, round(bm25, 6) AS bm25, round(score, 6) AS score FROM t2"""
ORACLE["tier2_factors"] = with_(ENTRIES, QUERIES, bm25(), TIER2) + f"""
SELECT chat_id, query_id, id, importance, round(1 + importance / 100, 6) AS importance_factor,
       round({recency('created_s')}, 6) AS recency_factor, {BOOST}::DOUBLE AS maturity_factor FROM t2"""
ORACLE["floor_topk"] = with_(ENTRIES, floor()) + """
SELECT chat_id, rank, id, round(score, 6) AS score FROM floor_rows"""
ORACLE["baseline_recency"] = with_(ENTRIES, QUERIES) + """
SELECT q.chat_id, q.query_id, r.rank, r.id FROM queries q JOIN (
  SELECT chat_id, id, row_number() OVER (PARTITION BY chat_id ORDER BY created_s DESC, seq) AS rank
  FROM entries QUALIFY rank <= 5) r USING (chat_id)"""
ORACLE["intent_classify"] = with_(
    "asked AS (SELECT conv_id, turn, text AS query FROM conversations)") + f"""
SELECT conv_id, turn, {INTENT} AS intent FROM asked"""
ORACLE["entity_extract"] = f"""
SELECT DISTINCT doc_id, unnest({ents('text')}) AS entity FROM documents"""
ORACLE["cooccurrence_edges_capped"] = with_(ENTRIES, EDGES) + """
SELECT chat_id, from_id, to_id, type, weight::DOUBLE AS weight, seq FROM edges"""
ORACLE["graph_degree"] = with_(ENTRIES, EDGES) + """
SELECT chat_id, from_id, count(*) AS degree, round(sum(weight::DOUBLE), 6) AS total_weight FROM edges GROUP BY ALL"""
ORACLE["tier3_hop1"] = with_(ENTRIES, QUERIES, bm25(), TIER2, EDGES, tier3()) + """
SELECT chat_id, query_id, id, pos FROM beam1"""
ORACLE["tier3_hop2"] = with_(ENTRIES, QUERIES, bm25(), TIER2, EDGES, tier3()) + """
SELECT chat_id, query_id, id, hop, pos FROM found"""
ORACLE["ladder_snapshot"] = with_(ENTRIES, QUERIES, bm25(), TIER2, EDGES, tier3(), floor(), ladder()) + """
SELECT chat_id, query_id, rank, id, tier, round(bm25, 6) AS bm25, round(score, 6) AS score FROM ladder"""


# --- write path over conversations ---------------------------------------------

TURN = 1 << 32
TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"

BATCHES = f"""
placed AS (
  SELECT conv_id AS chat_id, turn, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place
  FROM conversations WHERE {TRIM.format('text')} <> ''),
batched AS (
  SELECT *, place // 5 AS batch,
         least((place // 5) * 5 + 9, max(place) OVER (PARTITION BY chat_id)) AS fired_at
  FROM placed),
batch_sources AS (
  SELECT chat_id, batch, list(turn ORDER BY place) AS sources FROM batched GROUP BY ALL)"""

FACTS = f"""
lines AS (
  SELECT chat_id, batch, place, unnest(string_split('[user] ' || text, chr(10))) AS line,
         generate_subscripts(string_split('[user] ' || text, chr(10)), 1) AS ln FROM batched),
bodies AS (
  SELECT chat_id, batch, string_agg(regexp_extract(line, '^\\[(user|assistant|system)\\]\\s+(.*)$', 2), ' '
                                    ORDER BY place, ln) AS body
  FROM lines WHERE regexp_matches(line, '^\\[(user|assistant|system)\\]\\s+(.*)$') GROUP BY ALL),
sentences AS (
  SELECT chat_id, batch, {TRIM.format("unnest(regexp_split_to_array(body, '[.!?]+\\s+'))")} AS content,
         generate_subscripts(regexp_split_to_array(body, '[.!?]+\\s+'), 1) AS ord FROM bodies),
named AS (
  SELECT *, {ents('content')}[1] AS subject,
         list_filter(regexp_split_to_array(content, '\\s+'), lambda w: length(w) > 0) AS words FROM sentences),
chosen AS (
  SELECT *, row_number() OVER (PARTITION BY chat_id, batch ORDER BY ord) - 1 AS pos
  FROM named WHERE len(words) >= 4 AND subject IS NOT NULL QUALIFY pos < 5),
tagged AS (
  SELECT *, list_filter(list_transform(words, lambda w: regexp_replace(lower(w), '[^a-z]', '', 'g')),
                        lambda w: length(w) >= 4 AND w <> lower(subject)) AS raw_tags FROM chosen),
extracted AS (
  SELECT t.chat_id, t.batch, t.pos, t.content, t.subject,
         list_filter(raw_tags, lambda w, i: list_position(raw_tags, w) = i)[1:3] AS tags,
         s.sources, b.fired_at * {TURN} + 1 + t.batch % 65536 * 32768 + t.pos AS seq
  FROM tagged t JOIN batch_sources s USING (chat_id, batch)
  JOIN (SELECT DISTINCT chat_id, batch, fired_at FROM batched) b USING (chat_id, batch)),
facts AS (
  SELECT *, 'ep_2025-01-01T00:00:00_' || substr(sha256(concat_ws('|', 'episodic', content, subject,
            array_to_string(list_sort(tags), ','), array_to_string(sources, ','), 'rules@v1')), 1, 12) AS id
  FROM extracted)"""


def fold(facts: str, name: str = "fates") -> str:
    """The sequential fold, one fact per recursion step and group."""
    overlap = "len(list_intersect(a.toks, o.toks))"
    same = (f"list_filter(f.accepted, lambda a: len(a.toks) > 0 AND "
            f"{overlap} / (len(a.toks) + len(o.toks) - {overlap}) >= 0.7)")
    return f"""
ordered AS (
  SELECT chat_id, subject, seq, list_distinct({tok('content')}) AS toks,
         row_number() OVER (PARTITION BY chat_id, subject ORDER BY seq) AS n
  FROM {facts} WHERE subject IS NOT NULL),
fold AS (
  SELECT chat_id, subject, n, seq, seq AS target_seq, [{{'seq': seq, 'toks': toks}}] AS accepted
  FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.chat_id, o.subject, o.n, o.seq,
         CASE WHEN len({same}) > 0 THEN ({same})[1].seq ELSE o.seq END,
         CASE WHEN len({same}) > 0 THEN f.accepted
              ELSE list_append(f.accepted, {{'seq': o.seq, 'toks': o.toks}}) END
  FROM fold f JOIN ordered o ON o.chat_id = f.chat_id AND o.subject = f.subject AND o.n = f.n + 1),
{name} AS (
  SELECT chat_id, subject, seq, target_seq FROM fold
  UNION ALL SELECT chat_id, subject, seq, seq FROM {facts} WHERE subject IS NULL)"""


EPISODIC = """
updates AS (SELECT chat_id, target_seq, count(*) AS n FROM fates WHERE target_seq <> seq GROUP BY ALL),
episodic AS (
  SELECT f.chat_id, f.id, f.seq, 'episodic' AS scope, f.content, f.subject, f.tags, f.sources,
         least(100.0, 50 + 5 * coalesce(u.n, 0))::DOUBLE AS importance, 'draft' AS maturity,
         1735689600 AS created_s, coalesce(u.n, 0) AS update_count, f.batch
  FROM facts f JOIN fates t ON t.chat_id = f.chat_id AND t.seq = f.seq AND t.target_seq = f.seq
  LEFT JOIN updates u ON u.chat_id = f.chat_id AND u.target_seq = f.seq)"""


def with_recursive(*parts: str) -> str:
    return with_(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


ORACLE["batch_chunks"] = with_(BATCHES) + """
SELECT b.chat_id, b.batch, count(*) AS n_messages, min(b.fired_at) AS fired_at,
       array_to_string(list(b.turn ORDER BY b.place), ',') AS sources
FROM batched b GROUP BY b.chat_id, b.batch"""
ORACLE["rule_extract_facts"] = with_(BATCHES, FACTS) + """
SELECT chat_id, batch, id, seq, content, subject, array_to_string(tags, ',') AS tags,
       array_to_string(sources, ',') AS sources FROM facts"""
ORACLE["consolidated_entries"] = with_recursive(BATCHES, FACTS, fold("facts"), EPISODIC) + """
SELECT chat_id, id, seq, content, subject, importance, update_count FROM episodic"""
ORACLE["consolidate_incremental"] = ORACLE["consolidated_entries"]
ORACLE["consolidation_report"] = with_recursive(BATCHES, FACTS, fold("facts")) + """
SELECT s.chat_id, s.batch, count(f.seq) FILTER (t.target_seq = f.seq) AS added,
       count(f.seq) FILTER (t.target_seq <> f.seq) AS updated, any_value(len(s.sources)) AS drained,
       0::BIGINT AS parse_failures, 0::BIGINT AS entries_skipped, any_value(coalesce(c.cut, 0)) AS facts_cut
FROM batch_sources s LEFT JOIN facts f USING (chat_id, batch)
LEFT JOIN (SELECT chat_id, batch, greatest(0, count(*) - 5) AS cut FROM named
           WHERE len(words) >= 4 AND subject IS NOT NULL GROUP BY ALL) c USING (chat_id, batch)
LEFT JOIN fates t ON t.chat_id = f.chat_id AND t.seq = f.seq GROUP BY s.chat_id, s.batch"""
ORACLE["dedup_fold"] = with_recursive(ENTRIES, fold("entries")) + """
SELECT chat_id, seq, target_seq FROM fates"""
ORACLE["find_duplicate"] = with_recursive(ENTRIES, fold("entries")) + """
SELECT f.chat_id, f.subject, f.seq AS a, f.target_seq AS b,
       round(len(list_intersect(x.toks, y.toks))
             / (len(x.toks) + len(y.toks) - len(list_intersect(x.toks, y.toks))), 6) AS similarity
FROM fates f JOIN ordered x ON x.chat_id = f.chat_id AND x.seq = f.seq
JOIN ordered y ON y.chat_id = f.chat_id AND y.seq = f.target_seq WHERE f.target_seq <> f.seq"""


# --- evaluation over conversations ----------------------------------------------

WORKING = """
working AS (
  SELECT chat_id, 'wk_2025-01-01T00:00:00_' || substr(sha256(concat_ws('|', 'working', text, '', '',
           turn::VARCHAR, 'seeder')), 1, 12) AS id,
         place * 4294967296 AS seq, 'working' AS scope, text AS content, NULL::VARCHAR AS subject,
         []::VARCHAR[] AS tags, [turn] AS sources, 50.0::DOUBLE AS importance, 'draft' AS maturity,
         1735689600 AS created_s
  FROM placed),
entries AS (
  SELECT chat_id, id, seq, scope, content, subject, tags, sources, importance, maturity, created_s FROM episodic
  UNION ALL SELECT * FROM working)"""

QA = """
qa AS (
  SELECT q.conv_id AS chat_id, q.turn AS query_id, q.text AS query, [q.turn, q.turn + 1] AS evidence,
         CASE WHEN q.turn <= 1 THEN 'opening' ELSE 'follow-up' END AS task_type, a.conv_id IS NULL AS abstention
  FROM conversations q LEFT JOIN conversations a
    ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
  WHERE q.role = 'user')"""

MEMORY = (BATCHES, FACTS, fold("facts"), EPISODIC, WORKING, QA)
CONVERSATION_LADDER = (*MEMORY, bm25(queries="qa"), TIER2, EDGES, tier3(10, "qa"), floor(10), ladder("qa"))


def scores_for(ranked: str, name: str) -> str:
    ks = (1, 3, 5, 10)
    hits = ", ".join(f"count(*) FILTER (matched AND rank <= {k}) AS hits_{k}" for k in ks)
    rates = ", ".join(
        f"CASE WHEN n_matched > 0 THEN hits_{k} / least({k}, n_retrieved) END AS precision_{k}, "
        f"CASE WHEN n_matched > 0 THEN hits_{k} / n_matched END AS recall_{k}" for k in ks)
    return f"""
{name}_marked AS (
  SELECT r.chat_id, r.query_id, r.rank, r.id, list_has_any(e.sources, q.evidence) AS matched
  FROM {ranked} r JOIN entries e ON e.chat_id = r.chat_id AND e.id = r.id
  JOIN qa q ON q.chat_id = r.chat_id AND q.query_id = r.query_id),
{name}_folded AS (
  SELECT chat_id, query_id, count(*) AS n_retrieved, count(*) FILTER (matched) AS n_matched,
         min(rank) FILTER (matched) AS first_rank, {hits} FROM {name}_marked GROUP BY ALL),
{name}_scores AS (
  SELECT q.*, coalesce(n_matched, 0) > 0 AS scored,
         CASE WHEN n_matched > 0 THEN 1 / first_rank END AS mrr, {rates}
  FROM qa q LEFT JOIN {name}_folded f ON f.chat_id = q.chat_id AND f.query_id = q.query_id)"""


METRICS = ", ".join(f"round(avg({m}_{k}), 6) AS {m}_{k}" for m in ("precision", "recall") for k in (1, 3, 5, 10))
LEXICAL_10 = """
SELECT chat_id, query_id, id, row_number() OVER (PARTITION BY chat_id, query_id ORDER BY bm25 DESC, seq) AS rank
FROM scores QUALIFY rank <= 10"""
RECENT_10 = """
SELECT q.chat_id, q.query_id, e.id, e.rank FROM qa q JOIN (
  SELECT chat_id, id, row_number() OVER (PARTITION BY chat_id ORDER BY created_s DESC, seq) AS rank
  FROM entries QUALIFY rank <= 10) e USING (chat_id)"""


def nested(*parts: str, out: str, name: str) -> str:
    """A finished result as one named table, its helper names kept inside."""
    return f"{name} AS ({with_(*parts)} {out})"


ORACLE["conversation_ladder"] = with_recursive(*CONVERSATION_LADDER) + """
SELECT chat_id, query_id, rank, id, tier, round(bm25, 6) AS bm25, round(score, 6) AS score FROM ladder"""
ORACLE["gold_match"] = with_recursive(*CONVERSATION_LADDER, scores_for("ladder", "l")) + """
SELECT chat_id, query_id, rank, id, matched FROM l_marked"""
ORACLE["gold_match_legacy"] = with_recursive(
    *MEMORY, bm25("entries", "qa"), f"lexical AS ({LEXICAL_10})", f"""
sides AS (
  SELECT l.chat_id, l.query_id, l.id, g.turn, list_distinct({tok('e.content')}) AS a, list_distinct({tok('g.text')}) AS b
  FROM lexical l JOIN entries e ON e.chat_id = l.chat_id AND e.id = l.id
  JOIN conversations g ON g.conv_id = l.chat_id AND g.turn BETWEEN l.query_id AND l.query_id + 1)""") + """
SELECT chat_id, query_id, turn, id FROM sides
WHERE CASE WHEN len(a) + len(b) = 0 THEN 1
      ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END >= 0.5"""
ORACLE["ir_metrics"] = with_recursive(*CONVERSATION_LADDER, scores_for("ladder", "l")) + f"""
, answerable AS (SELECT * FROM l_scores WHERE NOT abstention)
SELECT count(*) AS n, count(*) FILTER (scored) AS n_scored, count(*) FILTER (NOT scored) AS n_skipped,
       (SELECT count(*) FROM l_scores WHERE abstention) AS abstentions,
       round(count(*) FILTER (scored) / count(*), 6) AS coverage, round(avg(mrr), 6) AS mrr, {METRICS}
FROM answerable"""
ORACLE["ir_metrics_by_type"] = with_recursive(*CONVERSATION_LADDER, scores_for("ladder", "l")) + """
SELECT task_type, count(*) FILTER (scored) AS n_scored, count(*) FILTER (NOT scored) AS n_skipped,
       round(avg(mrr), 6) AS mrr, round(count(*) FILTER (scored) / count(*), 6) AS coverage
FROM l_scores WHERE NOT abstention GROUP BY task_type"""
_COMPARED = " UNION ALL ".join(
    f"SELECT '{name}' AS retriever, * FROM {name}_scores" for name in ("ladder", "bm25only", "recency"))
ORACLE["baseline_comparison"] = with_recursive(
    *CONVERSATION_LADDER,
    nested(bm25("entries", "qa"), out=LEXICAL_10, name="lexical"), f"recent AS ({RECENT_10})",
    scores_for("ladder", "ladder"), scores_for("lexical", "bm25only"), scores_for("recent", "recency")) + f"""
SELECT retriever, count(*) AS n, count(*) FILTER (scored) AS n_scored,
       round(count(*) FILTER (scored) / count(*), 6) AS coverage, round(avg(mrr), 6) AS mrr,
       round(avg(recall_5), 6) AS recall_5
FROM ({_COMPARED}) WHERE NOT abstention GROUP BY retriever"""
ORACLE["rank_alignment_full_join"] = with_recursive(
    *CONVERSATION_LADDER, nested(bm25("entries", "qa"), out=LEXICAL_10, name="lexical")) + """
SELECT coalesce(a.chat_id, b.chat_id) AS chat_id, coalesce(a.query_id, b.query_id) AS query_id,
       coalesce(a.rank, b.rank) AS rank, a.id AS left_id, b.id AS right_id, coalesce(a.id = b.id, false) AS same
FROM ladder a FULL JOIN lexical b ON a.chat_id = b.chat_id AND a.query_id = b.query_id AND a.rank = b.rank"""


# --- caches and upkeep ------------------------------------------------------------

ORACLE["exact_cache_key"] = f"""
SELECT conv_id, turn, lpad(lower(to_hex(list_reduce(
         list_prepend(2166136261::BIGINT, list_transform(string_split(q, ''), lambda c: unicode(c)::BIGINT)),
         lambda h, c: (xor(h, c) * 16777619) & 4294967295))), 8, '0') AS key
FROM (SELECT conv_id, turn, lower({TRIM.format('text')}) AS q FROM conversations)"""
ORACLE["token_set_key"] = f"""
SELECT doc_id, array_to_string(list_sort(list_distinct({tok('text')})), ' ') AS key FROM documents"""
_HELD = f"""
keyed AS (SELECT lang AS chat_id, doc_id, list_sort(list_distinct({tok('text')})) AS toks,
                 lower({TRIM.format('text')}) AS norm FROM documents)"""
ORACLE["fuzzy_cache_match"] = with_(_HELD, """
written AS (SELECT chat_id, toks, max(doc_id) AS w FROM keyed WHERE len(toks) > 0 GROUP BY ALL),
held AS (SELECT * FROM written QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY w DESC) <= 200),
near AS (
  SELECT k.chat_id, k.doc_id AS query_id, h.w,
         len(list_intersect(k.toks, h.toks))
         / (len(k.toks) + len(h.toks) - len(list_intersect(k.toks, h.toks))) AS similarity
  FROM keyed k JOIN held h USING (chat_id))""") + """
SELECT chat_id, query_id, w::VARCHAR AS cached_id, round(similarity, 6) AS similarity FROM near
WHERE similarity >= 0.6
QUALIFY row_number() OVER (PARTITION BY chat_id, query_id ORDER BY similarity DESC, w) = 1"""
ORACLE["exact_cache_match"] = with_(_HELD, """
held AS (SELECT chat_id, norm, max(doc_id) AS w FROM keyed GROUP BY ALL
         QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY max(doc_id) DESC) <= 200)""") + """
SELECT k.chat_id, k.doc_id AS query_id, h.w::VARCHAR AS cached_id FROM keyed k JOIN held h USING (chat_id, norm)"""
ORACLE["cache_evict_topn"] = """
SELECT event_type AS chat_id, concat_ws('-', user_id, json_extract_string(props, '$.k')) AS key, max(event_id) AS written
FROM events GROUP BY ALL
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY max(event_id) DESC) <= 200"""
ORACLE["ladder_with_caches"] = with_(ENTRIES, QUERIES, bm25(), TIER2, EDGES, tier3(), floor(), ladder()) + """
SELECT chat_id, query_id, rank, id, CASE tier WHEN '3' THEN '0' ELSE tier END AS tier FROM ladder"""
ORACLE["working_prepend"] = with_(ENTRIES, QUERIES, floor(), """
buffer AS (SELECT chat_id, id, row_number() OVER (PARTITION BY chat_id ORDER BY seq DESC) AS pos
           FROM entries WHERE scope = 'working' QUALIFY pos <= 5),
both_blocks AS (
  SELECT q.chat_id, q.query_id, b.id, 0 AS block, b.pos FROM queries q JOIN buffer b USING (chat_id)
  UNION ALL
  SELECT q.chat_id, q.query_id, f.id, 1, f.rank FROM queries q JOIN floor_rows f USING (chat_id)
  WHERE f.id NOT IN (SELECT id FROM buffer b WHERE b.chat_id = f.chat_id))""") + """
SELECT chat_id, query_id, row_number() OVER (PARTITION BY chat_id, query_id ORDER BY block, pos) AS rank, id
FROM both_blocks"""
ORACLE["access_bump"] = """
SELECT user_id::VARCHAR AS id, least(100.0, 20 + 3 * count(*) FILTER (event_type = 'view'))::DOUBLE AS importance,
       count(*) FILTER (event_type = 'view') AS access_count
FROM events GROUP BY user_id"""
ORACLE["update_bump"] = """
SELECT user_id::VARCHAR AS id,
       least(100.0, least(100.0, 20 + 3 * count(*) FILTER (event_type = 'click'))
             + 5 * count(*) FILTER (event_type = 'purchase'))::DOUBLE AS importance,
       count(*) FILTER (event_type = 'click') AS access_count,
       count(*) FILTER (event_type = 'purchase') AS update_count,
       epoch_us(coalesce(max(ts) FILTER (event_type = 'purchase'), min(ts))) AS updated_us
FROM events GROUP BY user_id"""
ORACLE["daily_decay"] = with_(ENTRIES) + f"""
SELECT chat_id, id, round(importance * pow(0.995, ({NOW_S} - created_s) / 86400), 6) AS importance FROM entries"""
ORACLE["maturity_transition"] = with_(ENTRIES) + """
SELECT chat_id, id, maturity,
       CASE maturity WHEN 'draft' THEN CASE WHEN g >= 65 THEN 'validated' ELSE 'draft' END
         WHEN 'validated' THEN CASE WHEN g >= 85 THEN 'core' WHEN g < 35 THEN 'draft' ELSE 'validated' END
         ELSE CASE WHEN g < 60 THEN 'validated' ELSE 'core' END END AS next
FROM (SELECT *, least(100.0, importance + length(content) % 40) AS g FROM entries)"""
ORACLE["trace_ring"] = """
SELECT event_type AS chat_id, event_id AS seq, value FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 128"""
ORACLE["scrub_deleted"] = """
SELECT conv_id AS chat_id, conv_id || ':' || turn AS id FROM conversations c WHERE NOT EXISTS (
  SELECT 1 FROM events e WHERE e.event_type = 'error' AND e.user_id = c.conv_id
  AND json_extract_string(e.props, '$.k')::BIGINT = c.turn)"""
ORACLE["last_user_query"] = """
SELECT conv_id AS chat_id, max(turn) AS turn, arg_max(text, turn) AS query
FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id"""
ORACLE["memory_block"] = with_(ENTRIES, QUERIES, floor(3)) + """
SELECT q.chat_id, q.query_id, 'Retrieved memories:' || chr(10) ||
       string_agg('- ' || e.content, chr(10) ORDER BY f.rank) AS block
FROM queries q JOIN floor_rows f USING (chat_id) JOIN entries e ON e.chat_id = f.chat_id AND e.id = f.id
GROUP BY q.chat_id, q.query_id"""
ORACLE["entry_validate"] = """
SELECT doc_id::VARCHAR AS id, source <> 'src0' AND length(text) > 0 AND lang <> 'es'
       AND n_chars / 50 BETWEEN 0 AND 100 AS valid FROM documents"""
ORACLE["tags_populated"] = with_(BATCHES, FACTS) + """
SELECT chat_id, round(avg((len(tags) > 0)::INT), 6) AS tagged FROM facts GROUP BY chat_id"""
ORACLE["viewer_grouped_limit"] = with_(ENTRIES) + """
SELECT coalesce(nullif(subject, ''), '(no subject)') AS label, chat_id, id, importance FROM entries
ORDER BY label, importance DESC, chat_id, seq LIMIT 500"""
ORACLE["viewer_subject_counts"] = with_(ENTRIES) + """
SELECT chat_id, coalesce(nullif(subject, ''), '(no subject)') AS label, count(*) AS n FROM entries GROUP BY ALL"""
ORACLE["viewer_graph_page"] = with_(ENTRIES, EDGES, """
busiest AS (SELECT chat_id, from_id, count(*) AS degree FROM edges GROUP BY ALL
            ORDER BY degree DESC, chat_id, from_id LIMIT 200)""") + """
SELECT e.chat_id, e.from_id, e.to_id, b.degree,
       row_number() OVER (PARTITION BY e.chat_id, e.from_id ORDER BY e.seq, e.to_id) AS place
FROM edges e JOIN busiest b USING (chat_id, from_id) QUALIFY place <= 10"""
ORACLE["viewer_subject_filter"] = with_(ENTRIES) + """
SELECT chat_id, id, subject FROM entries WHERE contains(lower(subject), 'an')"""
ORACLE["trace_labels"] = """
SELECT event_id, CASE event_type WHEN 'view' THEN 'T0' WHEN 'click' THEN 'T3' WHEN 'signup' THEN 'Floor' ELSE '?' END AS label,
       strftime(ts, '%Y-%m-%dT%H:%M:%S') AS shown,
       CASE WHEN length(props) > 8 THEN substr(props, 1, 8) || '…' ELSE props END AS props FROM events"""


# --- run, trace and sweep analytics --------------------------------------------------

_SORTED = "list(value ORDER BY value)"
ORACLE["latency_percentiles_floor"] = f"""
SELECT event_type AS tier, count(*) AS n,
       ({_SORTED})[floor((count(*) - 1) * 0.5)::BIGINT + 1] AS p50_n1,
       ({_SORTED})[floor((count(*) - 1) * 0.95)::BIGINT + 1] AS p95_n1,
       ({_SORTED})[least(count(*) - 1, floor(count(*) * 0.5))::BIGINT + 1] AS p50_n,
       ({_SORTED})[least(count(*) - 1, floor(count(*) * 0.95))::BIGINT + 1] AS p95_n
FROM events GROUP BY event_type"""
ORACLE["trace_latency_stats"] = f"""
SELECT event_type AS tier, count(*) AS n,
       ({_SORTED})[floor((count(*) - 1) * 0.5 + 0.5)::BIGINT + 1] AS p50,
       ({_SORTED})[floor((count(*) - 1) * 0.95 + 0.5)::BIGINT + 1] AS p95,
       ({_SORTED})[floor((count(*) - 1) * 0.99 + 0.5)::BIGINT + 1] AS p99,
       min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std
FROM events GROUP BY event_type"""
ORACLE["tier_distribution"] = """
SELECT event_type AS tier, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
FROM events GROUP BY event_type"""
ORACLE["pearson_len_latency"] = """
SELECT *, CASE WHEN abs(r) < 0.1 THEN 'none' WHEN r > 0.3 THEN 'moderate positive'
               WHEN r < -0.3 THEN 'moderate negative' ELSE 'weak' END AS reading
FROM (SELECT event_type AS tier, count(*) AS n,
             round(corr(json_extract_string(props, '$.k')::BIGINT, value), 6) AS r FROM events GROUP BY event_type)
WHERE n >= 10"""
ORACLE["slowest_calls"] = """
SELECT event_id AS id, event_type AS tier, value AS lat_ms FROM events ORDER BY value DESC, event_id LIMIT 20"""
ORACLE["fastest_calls"] = """
SELECT event_id AS id, event_type AS tier, value AS lat_ms FROM events ORDER BY value, event_id LIMIT 20"""
ORACLE["trace_enrichment"] = """
WITH keyed AS (SELECT *, event_type || ' ' || json_extract_string(props, '$.k') AS query FROM events),
answers AS (SELECT query, max(value) AS answer FROM keyed WHERE event_type = 'purchase' GROUP BY query)
SELECT event_id AS id, query, value AS lat_ms, answer FROM keyed LEFT JOIN answers USING (query)"""
ORACLE["run_mode_summary"] = """
WITH tiers AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL),
modes AS (SELECT user_id, event_type FROM tiers
          QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_type) = 1)
SELECT e.user_id AS run, count(*) AS n_calls, round(avg(value), 6) AS top_score_mean,
       any_value(m.event_type) AS top_tier_mode, 'default' AS scorer_id
FROM events e JOIN modes m USING (user_id) GROUP BY e.user_id"""


def points(*keys: str) -> str:
    k = ", ".join(keys)
    return f"""points AS (SELECT {k}, avg(l_quantity) / 50 AS mrr, avg(l_tax) * 10 AS coverage, count(*) AS n
  FROM lineitem GROUP BY {k})"""


ORACLE["sweep_summary"] = with_(points("l_returnflag", "l_linestatus", "l_discount")) + """
SELECT l_returnflag AS sweep_name, l_linestatus AS knob, count(*) AS n_points, round(min(mrr), 6) AS mrr_min,
       round(max(mrr), 6) AS mrr_max, round(max(mrr) - min(mrr), 6) AS mrr_span,
       round(avg(coverage), 6) AS coverage_mean FROM points GROUP BY ALL"""
ORACLE["sweep_diff"] = with_(points("l_returnflag", "l_linenumber", "l_discount")) + """
SELECT a.l_returnflag AS knob, a.l_discount AS value, round(b.mrr - a.mrr, 6) AS delta_mrr,
       round(b.coverage - a.coverage, 6) AS delta_coverage
FROM points a JOIN points b ON a.l_returnflag = b.l_returnflag AND a.l_discount = b.l_discount
WHERE a.l_linenumber = 1 AND b.l_linenumber = 2"""
ORACLE["elbow"] = with_(points("l_returnflag", "l_discount"), """
sloped AS (
  SELECT *, (lead(mrr) OVER w - mrr) / nullif(lead(l_discount) OVER w - l_discount, 0) AS slope
  FROM points WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_discount)),
judged AS (SELECT *, max(abs(slope)) OVER (PARTITION BY l_returnflag) AS steepest FROM sloped),
elbows AS (
  SELECT * FROM judged WHERE steepest >= 0.005 AND abs(slope) <= 0.1 * steepest + 1e-12
  QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_discount) = 1),
axis AS (
  SELECT max(abs(slope)) < 0.005 AS flat FROM (
    SELECT CASE WHEN lead(l_discount) OVER w = l_discount THEN 0
                ELSE (lead(mrr) OVER w - mrr) / (lead(l_discount) OVER w - l_discount) END AS slope
    FROM points WINDOW w AS (ORDER BY l_discount))),
ranked AS (
  SELECT l_discount, l_returnflag, mrr, 'elbow' AS rationale, 1 AS p FROM elbows
  UNION ALL
  SELECT CASE WHEN flat THEN 0 ELSE l_discount END, CASE WHEN flat THEN 'A' ELSE l_returnflag END, mrr,
         CASE WHEN flat THEN 'flat axis' ELSE 'best point' END, 2 AS p
  FROM points, axis)""") + """
SELECT l_discount, l_returnflag, round(mrr, 6) AS mrr, rationale FROM ranked ORDER BY p, mrr DESC LIMIT 1"""
ORACLE["amendment_gate"] = with_(points("l_returnflag", "l_linenumber", "l_discount")) + """
SELECT c.l_returnflag, c.l_linenumber, c.l_discount,
       CASE WHEN c.mrr - b.mrr < 0.02 THEN 'hold: gain too small'
            WHEN c.coverage - b.coverage < -0.05 THEN 'hold: coverage falls' ELSE 'amend' END AS verdict
FROM points c JOIN points b ON b.l_returnflag = c.l_returnflag AND b.l_linenumber = c.l_linenumber AND b.l_discount = 0"""
ORACLE["structural_invariant"] = with_(points("l_returnflag"), """
d AS (SELECT max(mrr) FILTER (l_returnflag = 'R') - max(mrr) FILTER (l_returnflag = 'A') AS delta FROM points)""") + """
SELECT round(delta, 6) AS delta, CASE WHEN delta IS NULL THEN 'N/A' WHEN delta >= -0.02 THEN 'PASS' ELSE 'FAIL' END AS verdict
FROM d"""
ORACLE["consolidation_rates"] = """
WITH t AS (
  SELECT o_orderstatus AS sweep, sum(floor(o_totalprice / 1000)::BIGINT)::BIGINT AS added,
         sum(o_custkey % 7)::BIGINT AS updated, sum(floor(o_totalprice / 500)::BIGINT)::BIGINT AS drained,
         sum(o_custkey % 11)::BIGINT AS batches, sum(o_custkey % 2)::BIGINT AS parse_failures,
         sum(o_custkey % 3)::BIGINT AS entries_skipped
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY o_orderstatus)
SELECT *, round(updated / greatest(1, added + updated), 6) AS update_rate,
       round(updated / greatest(1, drained), 6) AS dedup_hit_rate,
       round(parse_failures / greatest(1, batches), 6) AS parse_fail_rate,
       round(entries_skipped / greatest(1, added + updated + entries_skipped), 6) AS entry_skip_rate FROM t"""
ORACLE["weighted_mrr_rollup"] = """
WITH cells AS (
  SELECT l_linenumber, l_returnflag, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS n_scored,
         avg(l_discount) FILTER (l_linestatus = 'F') AS mrr,
         count(*) FILTER (l_tax > 0.04) AS updated, count(*) FILTER (l_tax <= 0.04) AS added
  FROM lineitem GROUP BY ALL)
SELECT l_linenumber, sum(n)::BIGINT AS n, sum(n_scored)::BIGINT AS n_scored, (sum(n) - sum(n_scored))::BIGINT AS n_skipped,
       round(sum(n_scored) / sum(n), 6) AS coverage,
       round(sum(mrr * n_scored) / sum(n_scored) FILTER (mrr IS NOT NULL), 6) AS mrr,
       round(sum(updated) / (sum(updated) + sum(added)), 6) AS update_rate FROM cells GROUP BY l_linenumber"""
ORACLE["chunk_merge"] = """
WITH walls AS (SELECT l_returnflag, l_linenumber, sum(l_extendedprice) AS w FROM lineitem GROUP BY ALL)
SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS n_scored,
       round(avg(l_discount) FILTER (l_linestatus = 'F'), 6) AS mrr,
       (list(l_extendedprice ORDER BY l_extendedprice))[floor((count(*) - 1) * 0.5)::BIGINT + 1] AS p50,
       (list(l_extendedprice ORDER BY l_extendedprice))[floor((count(*) - 1) * 0.95)::BIGINT + 1] AS p95,
       round((SELECT max(w) FROM walls x WHERE x.l_returnflag = lineitem.l_returnflag), 2) AS wall_ms
FROM lineitem GROUP BY l_returnflag"""
ORACLE["stratified_sample"] = """
SELECT lang, doc_id FROM (
  SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('7|' || lang || '|' || doc_id), doc_id) AS turn
  FROM documents) ORDER BY turn, lang LIMIT 100"""
ORACLE["chunk_plan"] = """
WITH placed AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents),
size AS (SELECT ceil(count(*) / greatest(1, count(*) // 80))::BIGINT AS s FROM documents),
cut AS (SELECT place // s AS chunk, min(place) AS first, max(place) AS last, count(*) AS n_items FROM placed, size GROUP BY 1)
SELECT cell, chunk, first, last, n_items FROM cut, (SELECT unnest(range(3)) AS cell)"""
_CAPPED = " UNION ALL ".join(
    f"SELECT chat_id, {cap} AS edge_cap, count(*) AS n_edges, count(DISTINCT from_id) AS n_sources "
    f"FROM edges WHERE seq <= {cap} GROUP BY chat_id" for cap in (5, 10, 20))
ORACLE["grid_sweep"] = with_(ENTRIES, EDGES) + _CAPPED
ORACLE["spearman_price_key"] = """
WITH r AS (
  SELECT o_orderpriority AS grp,
         rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice)
         + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2 AS ra,
         rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey)
         + (count(*) OVER (PARTITION BY o_orderpriority, o_custkey) - 1) / 2 AS rb FROM orders)
SELECT grp, round(corr(ra, rb), 6) AS rho FROM r GROUP BY grp"""
ORACLE["outlier_fence"] = """
WITH q AS (SELECT event_type AS tier, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT tier, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 + 1.5 * (q3 - q1), 6) AS fence,
       count(*) FILTER (value > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM q JOIN events ON event_type = tier GROUP BY tier, q1, q3"""
ORACLE["half_means"] = """
WITH p AS (SELECT event_type AS tier, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS place,
                  count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT tier, round(avg(value) FILTER (place < n // 2), 6) AS first_half,
       round(avg(value) FILTER (place >= n // 2), 6) AS second_half FROM p GROUP BY tier"""
ORACLE["state_digest"] = with_(BATCHES, FACTS) + """
SELECT chat_id, count(*) AS n_facts,
       sum(('0x' || substr(sha256(concat_ws('|', seq, id, content, subject)), 1, 15))::HUGEINT)::VARCHAR AS fingerprint
FROM facts GROUP BY chat_id"""
ORACLE["exact_cache_match"] = with_(_HELD, """
latest AS (SELECT chat_id, norm, max(doc_id) AS w FROM keyed GROUP BY ALL),
held AS (SELECT * FROM latest QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY w DESC) <= 200)""") + """
SELECT k.chat_id, k.doc_id AS query_id, h.w::VARCHAR AS cached_id FROM keyed k JOIN held h USING (chat_id, norm)"""
ORACLE["cache_evict_topn"] = """
WITH latest AS (
  SELECT event_type AS chat_id, concat_ws('-', user_id, json_extract_string(props, '$.k')) AS key, max(event_id) AS written
  FROM events GROUP BY ALL)
SELECT * FROM latest QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY written DESC) <= 200"""


# --- vectors, communities, persona --------------------------------------------------

_DOT = "round(least(1, greatest(-1, list_dot_product(a.v, b.v))), 9)"
_UNIT = """
vecs AS (
  SELECT vec_id, label::VARCHAR AS label,
         list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings))"""


def knn(k: int, on: str) -> str:
    return f"""
sims AS (SELECT a.label, a.vec_id AS qid, b.vec_id AS id, {_DOT} AS similarity FROM vecs a JOIN vecs b ON {on}),
hits AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) <= {k + 1}),
near AS (
  SELECT label, qid, id, similarity, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS rank
  FROM hits WHERE qid <> id AND similarity > 0),
knn_edges AS (SELECT least(qid, id) AS a, greatest(qid, id) AS b, max(similarity) AS w FROM near GROUP BY 1, 2),
ends AS (SELECT a AS node, w FROM knn_edges UNION ALL SELECT b, w FROM knn_edges),
degrees AS (SELECT node, sum(w) AS degree FROM ends GROUP BY node),
given AS (SELECT vec_id AS node, label::INT AS comm FROM vecs),
totals AS (SELECT comm, sum(coalesce(degree, 0)) AS total FROM given LEFT JOIN degrees USING (node) GROUP BY comm),
inner_w AS (SELECT x.comm, 2 * sum(w) AS inside FROM knn_edges JOIN given x ON x.node = a JOIN given y ON y.node = b
            WHERE x.comm = y.comm GROUP BY x.comm)"""


ORACLE["knn_topk"] = with_(_UNIT, knn(15, "a.label = b.label")) + """
SELECT label AS key, qid, id, rank, round(similarity, 6) AS similarity FROM near"""
ORACLE["knn_global"] = with_(_UNIT, knn(5, "true")) + """
SELECT qid, id, rank, round(similarity, 6) AS similarity FROM near"""
ORACLE["knn_symmetric"] = with_(_UNIT, knn(15, "true")) + "SELECT a, b, round(w, 6) AS w FROM knn_edges"
ORACLE["knn_degree"] = with_(_UNIT, knn(15, "true")) + "SELECT node, round(degree, 6) AS degree FROM degrees"
ORACLE["modularity"] = with_(_UNIT, knn(15, "true")) + """
SELECT 'all' AS key, round(sum(coalesce(inside, 0) / m - pow(total / m, 2)), 6) AS q
FROM totals LEFT JOIN inner_w USING (comm), (SELECT sum(degree) AS m FROM degrees)"""
ORACLE["community_stats"] = with_(_UNIT, knn(15, "true")) + """
SELECT comm, round(coalesce(inside, 0), 6) AS inside, round(total, 6) AS total FROM totals LEFT JOIN inner_w USING (comm)"""
ORACLE["cosine_to_label_mean"] = with_(_UNIT, """
flat AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vecs),
means AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM flat GROUP BY ALL) GROUP BY label)""") + """
SELECT vec_id AS id, round(list_dot_product(v, c) / sqrt(list_dot_product(c, c)), 6) AS cosine
FROM vecs JOIN means USING (label)"""
_STEP3 = "xor({s}, ({s} << 13) & 4294967295)"
ORACLE["hashed_embeddings"] = """
WITH RECURSIVE seeds AS (
  SELECT conv_id, turn, list_reduce(
           list_prepend(2166136261::BIGINT, list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT)),
           lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS h FROM conversations),
walk AS (
  SELECT conv_id, turn, 0 AS n, CASE WHEN h = 0 THEN 3735928559 ELSE h END AS s FROM seeds
  UNION ALL
  SELECT conv_id, turn, n + 1, xor(s2, (s2 << 5) & 4294967295) FROM (
    SELECT *, xor(s1, s1 >> 17) AS s2 FROM (
      SELECT *, xor(s, (s << 13) & 4294967295) AS s1 FROM walk WHERE n < 16))),
raw AS (SELECT conv_id, turn, n - 1 AS dim, s / 4294967295 * 2 - 1 AS x FROM walk WHERE n > 0)
SELECT conv_id, turn, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY conv_id, turn)), 6) AS x FROM raw"""
ORACLE["persona_replace"] = with_(ENTRIES, """
facts AS (SELECT * FROM entries WHERE scope = 'episodic' AND subject IS NOT NULL),
best AS (SELECT chat_id, subject, content FROM facts
         QUALIFY row_number() OVER (PARTITION BY chat_id, subject ORDER BY length(content) DESC, content) = 1),
firsts AS (SELECT chat_id, subject, min(seq) AS seq FROM facts GROUP BY ALL)""") + """
SELECT chat_id, subject, 'p' || seq AS id, content FROM best JOIN firsts USING (chat_id, subject)
UNION ALL
SELECT chat_id, subject, id, content FROM entries e WHERE scope = 'persona'
  AND NOT EXISTS (SELECT 1 FROM firsts f WHERE f.chat_id = e.chat_id AND f.subject = e.subject)"""


# --- sources and live path ------------------------------------------------------------

_BLOCKS = """
blocks AS (
  SELECT conv_id || '-' || (turn // 64) AS sample_id, turn % 64 // 2 + 1 AS session, turn, role, text,
         row_number() OVER (PARTITION BY conv_id, turn // 64 ORDER BY turn) - 1 AS place FROM conversations),
samples AS (SELECT sample_id FROM blocks WHERE role = 'user' GROUP BY sample_id)"""
ORACLE["locomo_turns"] = with_(_BLOCKS) + """
SELECT sample_id AS chat_id, place AS turn, session::INT AS session, role AS speaker, text
FROM blocks"""
ORACLE["locomo_evidence"] = with_(_BLOCKS) + """
SELECT q.sample_id AS chat_id, row_number() OVER (PARTITION BY q.sample_id ORDER BY q.turn) - 1 AS query_id,
       q.text AS query, CASE WHEN q.turn % 3 = 2 THEN '' ELSE coalesce((
         SELECT t.place::VARCHAR FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, session ORDER BY turn) - 1 AS i FROM blocks) t
         WHERE t.sample_id = q.sample_id AND t.session = q.session AND t.i = q.turn % 2), '') END AS evidence
FROM blocks q WHERE q.role = 'user'"""
_MARKS = """
marks AS (SELECT *, role = 'assistant' AND length(text) % 2 = 0 AS marked FROM blocks),
whole AS (SELECT *, session = 1 AND NOT bool_or(marked) OVER (PARTITION BY sample_id, session) AS all_turns,
                 CASE WHEN count(DISTINCT session) OVER (PARTITION BY sample_id) = 1 THEN '_abs' ELSE '' END AS suffix FROM marks)"""
ORACLE["longmemeval_turns"] = with_(_BLOCKS, _MARKS) + """
SELECT sample_id || suffix AS chat_id, place AS turn, (session - 1)::INT AS session, role AS speaker, text FROM whole"""
ORACLE["longmemeval_evidence"] = with_(_BLOCKS, _MARKS) + """
SELECT sample_id || suffix AS chat_id, 'multi-session' AS task_type, any_value(suffix) = '_abs' AS abstention,
       coalesce(string_agg(place::VARCHAR, ',' ORDER BY place) FILTER (marked OR all_turns), '') AS evidence
FROM whole GROUP BY sample_id || suffix"""
ORACLE["run_source"] = """
SELECT user_id::VARCHAR AS conversation_id, props AS question, event_type AS category,
       (event_type <> 'error')::BIGINT AS n_retrieved, CASE WHEN event_type <> 'error' THEN event_id::VARCHAR END AS top_id,
       CASE WHEN event_type <> 'error' THEN value END AS top_score,
       CASE WHEN event_type <> 'error' THEN event_type END AS top_tier FROM events"""
ORACLE["batch_result_ingest"] = """
SELECT CASE WHEN turn = 3 THEN '(unparseable)' WHEN turn % 5 = 4 THEN '../' || conv_id || '-' || turn
            ELSE conv_id || '-' || turn END AS key,
       CASE WHEN turn = 3 THEN 'not json' WHEN turn % 5 = 4 THEN 'unsafe custom_id' WHEN role = 'system' THEN 'status 500'
            WHEN length(text) % 7 = 0 THEN 'finish length' END AS reason,
       CASE WHEN turn <> 3 THEN length(text)::INT END AS n_chars FROM conversations"""
_PROMPT = "to_json([{'role': 'system', 'content': $$" + extraction.EXTRACTION_PROMPT + "$$}, {'role': 'user', 'content': body}])"
ORACLE["warmup_batches"] = with_(BATCHES, f"""
bodies AS (
  SELECT chat_id, batch, 'Transcript:' || chr(10) || string_agg('[user] ' || text, chr(10) ORDER BY place)
         || chr(10) || chr(10) || 'Return the JSON now.' AS body FROM batched GROUP BY chat_id, batch)""") + f"""
SELECT chat_id, batch, sha256('model-a' || chr(0) || {_PROMPT}::VARCHAR || chr(0) || '4096') AS key FROM bodies"""
ORACLE["extraction_cache_split"] = with_(BATCHES) + """
SELECT DISTINCT chat_id, batch, batch = 0 AS cached FROM batched"""
ORACLE["extraction_validate"] = with_(BATCHES) + """
SELECT chat_id, batch,
       CASE chat_id % 4 WHEN 1 THEN 'parse_failure' WHEN 2 THEN 'not_object' ELSE 'ok' END AS status,
       (chat_id % 4 IN (0, 3))::BIGINT AS n_facts, (chat_id % 4 IN (0, 3))::BIGINT AS skipped,
       CASE WHEN chat_id % 4 IN (0, 3) THEN arg_min(text, place) END AS content
FROM batched GROUP BY chat_id, batch"""
ORACLE["traced_calls"] = """
SELECT event_id AS id, round(value, 6) AS lat_ms, event_type AS tier,
       CASE WHEN event_type <> 'error' OR true THEN props END AS query, length(props) AS query_len
FROM events WHERE event_type <> 'signup'"""
ORACLE["state_roundtrip"] = with_(ENTRIES) + """
SELECT chat_id, id, seq, scope, CASE chat_id WHEN 'fr' THEN 1.0 ELSE importance END AS importance, created_s FROM entries"""
ORACLE["state_deltas"] = with_(ENTRIES) + """
SELECT 'c' || seq // 5 AS chat_id, id, seq, 1 AS refused,
       CASE WHEN seq // 5 % 9 = 0 THEN 3.0 WHEN seq // 5 % 3 = 0 THEN 1.0 ELSE importance END AS importance
FROM entries WHERE seq // 5 % 6 <> 0 OR seq // 5 % 9 = 0"""
ORACLE["stream_buffer"] = """
WITH placed AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place,
                       count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE trim(text) <> '')
SELECT conv_id::VARCHAR AS chat_id, place // 2 AS fire, 'buffer' AS reason,
       string_agg(turn::VARCHAR, ',' ORDER BY place) AS turns
FROM placed WHERE place // 2 * 2 + 4 <= n GROUP BY conv_id, place // 2"""
ORACLE["stream_cache_routing"] = """
WITH keyed AS (
  SELECT user_id, event_id, event_type, event_type || ' ' || json_extract_string(props, '$.k') AS exact,
         event_type || CASE WHEN length(json_extract_string(props, '$.k')) >= 2
                            THEN ' ' || json_extract_string(props, '$.k') ELSE '' END AS fuzzy,
         count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS epoch FROM events),
asked AS (
  SELECT *, min(event_id) OVER (PARTITION BY user_id, fuzzy) AS first_id,
         row_number() OVER (PARTITION BY user_id, epoch, exact ORDER BY event_id) AS nth FROM keyed WHERE event_type <> 'error')
SELECT user_id::VARCHAR AS chat_id, event_id AS seq, first_id::VARCHAR AS first_id,
       CASE WHEN event_id = first_id THEN '3' WHEN nth > 1 THEN '0' ELSE '1' END AS tier FROM asked"""


# a fold over the events of every chat, one step a round
ORACLE["stream_cache_evict"] = """
WITH RECURSIVE asked AS (
  SELECT user_id // 15 AS chat_id, event_id, event_type || ' k' || json_extract_string(props, '$.k') AS q,
         event_type = 'error' AND json_extract_string(props, '$.k') = '0' AS wipes,
         row_number() OVER (PARTITION BY user_id // 15 ORDER BY event_id) AS n FROM events),
fold AS (
  SELECT chat_id, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS tier, NULL::BIGINT AS first_id,
         []::STRUCT(q VARCHAR, id BIGINT)[] AS exact, []::STRUCT(q VARCHAR, id BIGINT)[] AS fuzzy FROM asked WHERE n = 1
  UNION ALL
  SELECT chat_id, n, event_id, tier, id,
         CASE WHEN wipes THEN [] WHEN tier = '0' THEN exact
              ELSE list_append(exact, {'q': q, 'id': id})[CASE WHEN len(exact) = 200 THEN 2 ELSE 1 END:] END,
         CASE WHEN wipes OR tier <> '3' THEN fuzzy
              ELSE list_append(fuzzy, {'q': q, 'id': id})[CASE WHEN len(fuzzy) = 200 THEN 2 ELSE 1 END:] END
  FROM (SELECT f.chat_id, a.n, a.event_id, a.q, a.wipes, f.exact, f.fuzzy,
               list_filter(f.exact, lambda x: x.q = a.q)[1].id AS in_exact, list_filter(f.fuzzy, lambda x: x.q = a.q)[1].id AS in_fuzzy,
               CASE WHEN in_exact IS NOT NULL THEN '0' WHEN in_fuzzy IS NOT NULL THEN '1' ELSE '3' END AS tier,
               coalesce(in_exact, in_fuzzy, a.event_id) AS id
        FROM fold f JOIN asked a ON a.chat_id = f.chat_id AND a.n = f.n + 1))
SELECT chat_id::VARCHAR AS chat_id, seq, tier, first_id::VARCHAR AS first_id
FROM fold JOIN asked USING (chat_id, n) WHERE NOT wipes"""
ORACLE["stream_lifecycle"] = """
WITH RECURSIVE said AS (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events),
ops AS (
  SELECT user_id AS chat_id, event_id AS seq, k % 8 AS turn, 'f' || k % 16 AS id,
         CASE WHEN event_type IN ('click', 'signup') THEN 'message' WHEN event_type = 'view' THEN 'access'
              WHEN event_type = 'purchase' THEN CASE WHEN k >= 90 THEN 'rebuilt' WHEN k % 2 = 0 THEN 'fact' ELSE 'update' END
              WHEN k % 10 = 9 THEN 'switch' ELSE 'retract' END AS op FROM said),
moves AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY seq) AS n FROM ops WHERE op IN ('message', 'retract', 'switch')),
fold AS (
  SELECT chat_id, 0::BIGINT AS n, NULL::BIGINT AS seq, 0::BIGINT AS fires, NULL::BIGINT[] AS turns,
         CASE WHEN chat_id % 2 = 0 AND chat_id IN (SELECT c_custkey FROM customer) THEN [1, 3]::BIGINT[] ELSE [] END AS held
  FROM moves WHERE n = 1
  UNION ALL
  SELECT chat_id, n, seq, fires + brims::BIGINT, CASE WHEN brims THEN held[:2] END, CASE WHEN brims THEN held[3:] ELSE held END
  FROM (SELECT f.chat_id, m.n, m.seq, f.fires,
               CASE m.op WHEN 'message' THEN list_append(f.held, m.turn)
                         WHEN 'retract' THEN list_filter(f.held, lambda x: x <> m.turn) ELSE f.held END AS held,
               m.op <> 'retract' AND len(CASE m.op WHEN 'message' THEN list_append(f.held, m.turn) ELSE f.held END) >= 4 AS brims
        FROM fold f JOIN moves m ON m.chat_id = f.chat_id AND m.n = f.n + 1)),
births AS (
  SELECT c_custkey AS chat_id, 'f' || j AS id, ((c_custkey * 37 + j * 13) % 101)::DOUBLE AS importance, -1 AS born
  FROM customer, range(10) r(j)),
all_births AS (
  SELECT * FROM births UNION ALL
  SELECT chat_id, id, 50.0, min(seq) FROM ops WHERE op = 'fact' AND (chat_id, id) NOT IN (SELECT chat_id, id FROM births)
  GROUP BY chat_id, id),
touched AS (
  SELECT o.chat_id, o.seq, CASE WHEN o.seq = born THEN 'added' WHEN op = 'access' THEN 'access' ELSE 'update' END AS kind, id, importance
  FROM ops o JOIN all_births b USING (chat_id, id) WHERE op IN ('access', 'update', 'fact') AND o.seq >= born),
counted AS (
  SELECT *, count(*) FILTER (kind = 'access') OVER w AS access_count, count(*) FILTER (kind = 'update') OVER w AS update_count,
         max(seq) FILTER (kind <> 'access') OVER w AS updated_seq
  FROM touched WINDOW w AS (PARTITION BY chat_id, id ORDER BY seq)),
epochs AS (
  SELECT *, sum((kind = 'rebuilt')::INT) OVER (PARTITION BY chat_id ORDER BY seq) AS epoch
  FROM (SELECT chat_id, seq, kind FROM touched WHERE kind = 'added' UNION ALL SELECT chat_id, seq, 'rebuilt' FROM ops WHERE op = 'rebuilt')),
rebuilds AS (
  SELECT chat_id, seq, kind, count(*) FILTER (kind = 'added') OVER (PARTITION BY chat_id, epoch ORDER BY seq)
         + CASE WHEN epoch = 0 AND chat_id IN (SELECT c_custkey FROM customer) THEN chat_id % 4 ELSE 0 END AS added FROM epochs)
SELECT chat_id::VARCHAR AS chat_id, seq, 'buffer' AS kind, fires - 1 AS fire, array_to_string(turns, ',') AS turns, NULL::VARCHAR AS id,
       NULL::DOUBLE AS importance, -1 AS access_count, -1 AS update_count, -1 AS updated_seq, -1 AS added, false AS rebuild_due
FROM fold WHERE turns IS NOT NULL
UNION ALL
SELECT c.chat_id::VARCHAR, c.seq, c.kind, -1, NULL, id, least(100.0, importance + 3 * access_count + 5 * update_count),
       access_count, update_count, coalesce(updated_seq, -1), coalesce(r.added, -1), coalesce(r.added >= 5, false)
FROM counted c LEFT JOIN rebuilds r ON r.chat_id = c.chat_id AND r.seq = c.seq
UNION ALL
SELECT chat_id::VARCHAR, seq, kind, -1, NULL, NULL, NULL, -1, -1, -1, added, false FROM rebuilds WHERE kind = 'rebuilt'"""


# --- edges with types, upserts and caps ---------------------------------------------------

TYPED_EDGES = f"""
entity_postings AS (
  SELECT DISTINCT chat_id, id, seq, unnest({ents('content')}) AS entity FROM entries WHERE scope <> 'working'),
candidate_edges AS (
  SELECT DISTINCT a.chat_id, a.id AS from_id, b.id AS to_id, 'mentions' AS type, 0.5::DOUBLE AS weight, 1 AS block, b.seq AS place
  FROM entity_postings a JOIN entity_postings b USING (chat_id, entity) WHERE a.seq > b.seq
  UNION ALL
  SELECT chat_id, id, 'd' || (seq * 13 + j * 29) % 500,
         ['mentions', 'supports', 'same_topic', 'temporal_next', 'contradicts'][(seq + j) % 5 + 1], 1.0::DOUBLE, 0, j
  FROM entries, range(25) r(j) WHERE j < CASE WHEN seq % 10 = 0 THEN 25 WHEN seq % 5 = 0 THEN 3 ELSE 0 END),
merged_edges AS (
  SELECT chat_id, from_id, to_id, type, max(weight) AS weight, min(block * 1000000000 + place) AS first_place
  FROM candidate_edges GROUP BY chat_id, from_id, to_id, type),
kept_edges AS (
  SELECT * FROM merged_edges
  QUALIFY row_number() OVER (PARTITION BY chat_id, from_id ORDER BY weight DESC, first_place, to_id, type) <= 20),
edges AS (
  SELECT chat_id, from_id, to_id, type, weight,
         row_number() OVER (PARTITION BY chat_id, from_id ORDER BY first_place, to_id, type) AS seq FROM kept_edges)"""
ORACLE["typed_edges_capped"] = with_(ENTRIES, TYPED_EDGES) + """
SELECT chat_id, from_id, to_id, type, weight, seq FROM edges"""
ORACLE["typed_ladder"] = with_(ENTRIES, QUERIES, bm25(), TIER2, TYPED_EDGES, tier3(), floor(), ladder()) + """
SELECT chat_id, query_id, rank, id, tier, round(score, 6) AS score FROM ladder"""
EVENT_EDGES = """
all_edges AS (
  SELECT event_id % 2 AS part, (user_id % 10)::VARCHAR AS chat_id, user_id::VARCHAR AS from_id,
         json_extract_string(props, '$.k') AS to_id,
         CASE event_type WHEN 'purchase' THEN 'supports' WHEN 'click' THEN 'mentions' ELSE 'same_topic' END AS type,
         value, event_id FROM events),
sided AS (
  SELECT part, chat_id, from_id, to_id, type, max(value) AS weight, min(event_id) AS seq
  FROM all_edges GROUP BY part, chat_id, from_id, to_id, type)"""
ORACLE["edges_cap_fates"] = with_(EVENT_EDGES) + """
, fresh AS (SELECT n.* FROM sided n WHERE part = 1 AND NOT EXISTS (
    SELECT 1 FROM sided o WHERE o.part = 0 AND o.chat_id = n.chat_id AND o.from_id = n.from_id AND o.to_id = n.to_id AND o.type = n.type)),
pool AS (SELECT * FROM fresh UNION ALL SELECT o.* FROM sided o WHERE part = 0 AND EXISTS (
    SELECT 1 FROM sided n WHERE n.part = 1 AND n.chat_id = o.chat_id AND n.from_id = o.from_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY chat_id, from_id ORDER BY weight DESC, part DESC, seq) AS place FROM pool)
SELECT chat_id, from_id, to_id, type, weight,
       CASE WHEN place <= 20 THEN 'kept' WHEN part = 0 THEN 'evicted' ELSE 'dropped' END AS fate FROM ranked"""
ORACLE["edge_upsert"] = with_(EVENT_EDGES) + """
SELECT chat_id, from_id, to_id, type, arg_max(weight, part) AS weight, arg_min(seq, part) AS seq
FROM sided GROUP BY chat_id, from_id, to_id, type"""
ORACLE["edge_neighbours"] = with_(EVENT_EDGES) + """
SELECT chat_id, from_id, to_id, type, row_number() OVER (PARTITION BY chat_id, from_id ORDER BY seq) AS place
FROM sided WHERE part = 0 AND chat_id::BIGINT % 2 = 0 AND from_id::BIGINT % 4 = 0"""
ORACLE["edge_neighbours_all"] = with_(EVENT_EDGES) + """
, whole AS (SELECT chat_id, from_id, to_id, type, max(value) AS weight, min(event_id) AS seq
            FROM all_edges GROUP BY chat_id, from_id, to_id, type)
SELECT chat_id, from_id, to_id, type, row_number() OVER (PARTITION BY chat_id, from_id ORDER BY seq) AS place
FROM whole w WHERE NOT EXISTS (
  SELECT 1 FROM whole h WHERE h.weight > (SELECT avg(weight) FROM whole)
    AND h.chat_id = w.chat_id AND h.from_id = w.from_id AND h.to_id = w.to_id AND h.type = w.type)"""


# --- upkeep, viewer and write path, second part -------------------------------------------

ORACLE["cache_invalidate"] = """
WITH keyed AS (
  SELECT user_id::VARCHAR AS chat_id, event_type || '-' || json_extract_string(props, '$.k') AS key, max(event_id) AS written
  FROM events GROUP BY ALL)
SELECT chat_id, key, written FROM keyed
WHERE chat_id NOT IN (SELECT user_id::VARCHAR FROM events WHERE event_type = 'purchase' AND value > (SELECT avg(value) FROM events))
QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY written DESC) <= 200"""
ORACLE["traces_cleared"] = """
SELECT user_id::VARCHAR AS chat_id, event_id AS seq FROM events
WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > (SELECT 2 * avg(value) FROM events))
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3"""
ORACLE["entry_construct"] = with_(ENTRIES) + """
SELECT chat_id, CASE scope WHEN 'working' THEN 'wk' WHEN 'episodic' THEN 'ep' ELSE 'ps' END || '_2025-01-01T00:00:00_' ||
       substr(sha256(concat_ws('|', scope, content, coalesce(subject, ''), tags[1], seq, 'x')), 1, 12) AS id,
       50.0::DOUBLE AS importance, 'draft' AS maturity, 0::BIGINT AS access_count, 0::BIGINT AS update_count,
       1735689600::BIGINT AS updated_s
FROM entries WHERE length(content) > 0"""
ORACLE["messages_accepted"] = f"""
SELECT conv_id AS chat_id, turn, text FROM conversations
WHERE role = 'assistant' AND turn > 1 AND {TRIM.format('text')} <> ''"""
ORACLE["reasoning_stripped"] = r"""
SELECT conv_id AS chat_id, turn, CASE WHEN turn % 2 = 0 THEN regexp_replace(text, '^\s+', '') ELSE text END AS text
FROM conversations"""
ORACLE["rebuild_due"] = with_recursive(BATCHES, FACTS, fold("facts")) + """
SELECT s.chat_id, count(f.seq) FILTER (t.target_seq = f.seq) AS facts_since_rebuild,
       count(f.seq) FILTER (t.target_seq = f.seq) >= 100 AS rebuild_due
FROM batch_sources s LEFT JOIN facts f USING (chat_id, batch)
LEFT JOIN fates t ON t.chat_id = f.chat_id AND t.seq = f.seq GROUP BY s.chat_id"""
ORACLE["viewer_by_recency"] = with_(ENTRIES) + """
SELECT coalesce(nullif(subject, ''), '(no subject)') AS label, chat_id, id FROM entries
ORDER BY label, created_s DESC, chat_id, seq LIMIT 500"""
ORACLE["viewer_by_added"] = ORACLE["viewer_by_recency"].replace("LIMIT 500", "LIMIT 300")
ORACLE["viewer_unnamed_filter"] = with_(ENTRIES) + """
SELECT chat_id, id FROM entries
WHERE coalesce(subject, '') = '' OR contains(lower(subject), 'no sub')"""
ORACLE["trace_badges"] = """
SELECT event_id, CASE event_type WHEN 'click' THEN 'swipe' WHEN 'purchase' THEN 'regen' END AS badge,
       CASE WHEN event_type = 'view' THEN value END AS top FROM events"""
ORACLE["scorer_custom"] = with_(ENTRIES, QUERIES, bm25(), TIER2, EDGES, tier3()) + """
SELECT f.chat_id, f.query_id, f.id, round(s.bm25, 6) AS bm25, round(s.bm25 * (1 + e.importance / 100), 6) AS score
FROM found f JOIN scores s ON s.chat_id = f.chat_id AND s.query_id = f.query_id AND s.id = f.id
JOIN entries e ON e.chat_id = f.chat_id AND e.id = f.id WHERE s.bm25 > 0
QUALIFY row_number() OVER (PARTITION BY f.chat_id, f.query_id ORDER BY s.bm25 * (1 + e.importance / 100) DESC, f.hop, f.pos) <= 5"""


# --- distributions and sweep files ----------------------------------------------------------

ORACLE["baseline_by_type"] = with_recursive(
    *CONVERSATION_LADDER,
    nested(bm25("entries", "qa"), out=LEXICAL_10, name="lexical"), f"recent AS ({RECENT_10})",
    scores_for("ladder", "ladder"), scores_for("lexical", "bm25only"), scores_for("recent", "recency")) + f"""
SELECT retriever, task_type, count(*) AS n, count(*) FILTER (scored) AS n_scored,
       round(count(*) FILTER (scored) / count(*), 6) AS coverage, round(avg(mrr), 6) AS mrr, round(avg(recall_5), 6) AS recall_5
FROM ({_COMPARED}) WHERE NOT abstention GROUP BY retriever, task_type"""
_LENGTHS = "list(length(content) ORDER BY length(content))"
ORACLE["fact_lengths"] = with_(BATCHES, FACTS) + f"""
SELECT 'rules@v1' AS extractor, count(*) AS n, ({_LENGTHS})[floor((count(*) - 1) * 0.5)::BIGINT + 1] AS p50,
       ({_LENGTHS})[floor((count(*) - 1) * 0.95)::BIGINT + 1] AS p95, max(length(content)) AS longest
FROM facts HAVING count(*) > 0"""
ORACLE["factor_distribution"] = with_(ENTRIES, QUERIES, bm25(), TIER2, f"""
factors AS (
  SELECT 'importance_factor' AS factor, (1 + importance / 100)::DOUBLE AS value FROM t2
  UNION ALL SELECT 'recency_factor', round({recency('created_s')}, 6)::DOUBLE FROM t2
  UNION ALL SELECT 'maturity_factor', ({BOOST})::DOUBLE FROM t2)""") + f"""
SELECT factor, count(*) AS n, min(value) AS least, ({_SORTED})[floor((count(*) - 1) * 0.5)::BIGINT + 1] AS p50,
       ({_SORTED})[floor((count(*) - 1) * 0.95)::BIGINT + 1] AS p95, max(value) AS greatest FROM factors GROUP BY factor"""
ORACLE["sweep_files"] = """
WITH p AS (
  SELECT l_returnflag AS flag, l_linenumber AS line, round(avg(l_discount), 6) AS mrr, count(*) AS n,
         count(*) FILTER (l_quantity > 10) AS n_scored, round(avg(l_quantity), 4) AS p50 FROM lineitem GROUP BY ALL),
m AS (SELECT *, round(n_scored / n, 6) AS coverage, n - n_scored AS n_skipped FROM p)
SELECT 't' AS timestamp, 'sweep-' || flag AS sweep_name, 'first' AS round, 'edge_cap' AS knob, line::VARCHAR AS value, mrr, coverage,
       n, n_scored, n_skipped, p50 AS latency_p50, NULL::DOUBLE AS latency_p95, line = 3 AS is_winner FROM m
UNION ALL
SELECT '', 'flat-' || flag, 'edge_cap', 'edge_cap', line::VARCHAR, mrr, coverage, n, n_scored, n_skipped, p50, p50 * 2, false FROM m
UNION ALL
SELECT '', 'baselines', 'baselines', 'retriever', 'r' || line, mrr, coverage, n, n_scored, n_skipped, p50, p50 * 2, false FROM m"""


# --- the ladder over a grid of points -----------------------------------------------

def knob_points(**knobs: list) -> str:
    """Every combination of the knobs, the others at their defaults."""
    values = {"lambda_1": [1.0], "seeds": [3], "beam": [5], "cap": [20]} | knobs
    lists = ", ".join(f"(SELECT unnest({v}) AS {k})" for k, v in values.items())
    return f"points AS (SELECT row_number() OVER () AS point, * FROM {lists})"


def point_hop(n: int) -> str:
    earlier = " UNION ALL ".join(f"SELECT chat_id, query_id, point, id FROM beam{i}" for i in range(n))
    return f"""
reached{n} AS (
  SELECT f.chat_id, f.query_id, f.point, e.to_id AS id, f.intent, f.pos AS from_pos, e.seq AS edge_seq, e.type
  FROM beam{n - 1} f JOIN points g USING (point)
  JOIN edges e ON e.chat_id = f.chat_id AND e.from_id = f.id AND e.seq <= g.cap
  JOIN pooled p ON p.chat_id = f.chat_id AND p.id = e.to_id
  WHERE NOT EXISTS (SELECT 1 FROM ({earlier}) d WHERE d.chat_id = f.chat_id AND d.query_id = f.query_id
                    AND d.point = f.point AND d.id = e.to_id)),
beam{n} AS (
  SELECT * EXCLUDE (beam) FROM (
    SELECT r.chat_id, r.query_id, r.point, r.id, r.intent, g.beam,
           row_number() OVER (PARTITION BY r.chat_id, r.query_id, r.point ORDER BY
             round(g.lambda_1 * ({AFFINITY}) + 0.3 * coalesce(s.bm25, 0), 10) DESC, from_pos, edge_seq) AS pos
    FROM reached{n} r JOIN points g USING (point)
    LEFT JOIN scores s ON s.chat_id = r.chat_id AND s.query_id = r.query_id AND s.id = r.id) WHERE pos <= beam)"""


POINT_LADDER = f"""
intents AS (SELECT chat_id, query_id, {INTENT} AS intent FROM qa),
beam0 AS (
  SELECT t.chat_id, t.query_id, g.point, t.id, i.intent, t.rank AS pos FROM t2 t
  JOIN intents i ON i.chat_id = t.chat_id AND i.query_id = t.query_id JOIN points g ON t.rank <= g.seeds),
{point_hop(1)},
{point_hop(2)},
found AS (
  SELECT chat_id, query_id, point, id, hop, min(pos) AS pos FROM (
    SELECT *, 0 AS hop FROM beam0 UNION ALL SELECT *, 1 FROM beam1 UNION ALL SELECT *, 2 FROM beam2) GROUP BY ALL),
t3 AS (
  SELECT *, row_number() OVER (PARTITION BY chat_id, query_id, point ORDER BY score DESC, hop, pos) AS rank FROM (
    SELECT f.*, s.bm25, round(s.bm25 * {PRIOR}, 10) AS score FROM found f
    JOIN scores s ON s.chat_id = f.chat_id AND s.query_id = f.query_id AND s.id = f.id
    JOIN entries e ON e.chat_id = f.chat_id AND e.id = f.id) WHERE score > 0 QUALIFY rank <= 10),
ladder AS (
  SELECT chat_id, query_id, point, rank, id FROM t3 UNION ALL
  SELECT q.chat_id, q.query_id, g.point, f.rank, f.id FROM qa q JOIN points g ON true JOIN floor_rows f USING (chat_id)
  WHERE NOT EXISTS (SELECT 1 FROM t3 WHERE t3.chat_id = q.chat_id AND t3.query_id = q.query_id AND t3.point = g.point))"""
_KS = (1, 3, 5, 10)
POINT_METRICS = f"""
marked AS (
  SELECT r.*, list_has_any(e.sources, q.evidence) AS matched FROM ladder r
  JOIN entries e ON e.chat_id = r.chat_id AND e.id = r.id JOIN qa q ON q.chat_id = r.chat_id AND q.query_id = r.query_id),
folded AS (
  SELECT chat_id, query_id, point, count(*) AS n_retrieved, count(*) FILTER (matched) AS n_matched,
         min(rank) FILTER (matched) AS first_rank, {", ".join(f"count(*) FILTER (matched AND rank <= {k}) AS hits_{k}" for k in _KS)}
  FROM marked GROUP BY ALL),
point_scores AS (
  SELECT g.point, coalesce(n_matched, 0) > 0 AS scored, CASE WHEN n_matched > 0 THEN 1 / first_rank END AS mrr,
         {", ".join(f"CASE WHEN n_matched > 0 THEN hits_{k} / least({k}, n_retrieved) END AS precision_{k}, "
                    f"CASE WHEN n_matched > 0 THEN hits_{k} / n_matched END AS recall_{k}" for k in _KS)}
  FROM qa q JOIN points g ON true
  LEFT JOIN folded f ON f.chat_id = q.chat_id AND f.query_id = q.query_id AND f.point = g.point WHERE NOT q.abstention),
swept AS (
  SELECT point, count(*) AS n, count(*) FILTER (scored) AS n_scored, round(count(*) FILTER (scored) / count(*), 6) AS coverage,
         round(avg(mrr), 6) AS mrr, {METRICS} FROM point_scores GROUP BY point)"""


def swept(**knobs: list) -> tuple[str, ...]:
    return (*MEMORY, bm25(queries="qa"), TIER2, EDGES, floor(10), knob_points(**knobs), POINT_LADDER, POINT_METRICS)


_GRID = swept(lambda_1=[0.5, 1.0, 2.0], seeds=[1, 3], beam=[2, 5], cap=[2, 20])
_GRID_KNOBS = "lambda_1::DOUBLE AS lambda_1, seeds::INT AS seeds_k, beam::INT AS beam_width, cap::INT AS edge_cap"
ORACLE["ladder_sweep"] = with_recursive(*_GRID) + f"SELECT {_GRID_KNOBS}, s.* EXCLUDE (point) FROM swept s JOIN points USING (point)"
ORACLE["ladder_elbow"] = with_recursive(*_GRID, f"rows_ AS (SELECT {_GRID_KNOBS}, mrr FROM swept JOIN points USING (point))", """
sloped AS (
  SELECT *, (lead(mrr) OVER w - mrr) / (lead(lambda_1) OVER w - lambda_1) AS slope
  FROM rows_ WINDOW w AS (PARTITION BY seeds_k, beam_width, edge_cap ORDER BY lambda_1)),
judged AS (SELECT *, max(abs(slope)) OVER (PARTITION BY seeds_k, beam_width, edge_cap) AS steepest FROM sloped),
elbows AS (
  SELECT * FROM judged WHERE steepest >= 0.005 AND abs(slope) <= 0.1 * steepest + 1e-12
  QUALIFY row_number() OVER (PARTITION BY seeds_k, beam_width, edge_cap ORDER BY lambda_1) = 1),
axis AS (
  SELECT max(abs(slope)) < 0.005 AS flat FROM (
    SELECT CASE WHEN lead(lambda_1) OVER w = lambda_1 THEN 0 ELSE (lead(mrr) OVER w - mrr) / (lead(lambda_1) OVER w - lambda_1) END AS slope
    FROM rows_ WINDOW w AS (ORDER BY lambda_1))),
best AS (SELECT * FROM rows_ ORDER BY mrr DESC, lambda_1, seeds_k DESC, beam_width DESC, edge_cap DESC LIMIT 1),
ranked AS (
  SELECT lambda_1, seeds_k, beam_width, edge_cap, mrr, 'elbow' AS rationale, 1 AS p FROM elbows UNION ALL
  SELECT CASE WHEN flat THEN 1.0 ELSE lambda_1 END, CASE WHEN flat THEN 3 ELSE seeds_k END, CASE WHEN flat THEN 5 ELSE beam_width END,
         CASE WHEN flat THEN 20 ELSE edge_cap END, mrr, CASE WHEN flat THEN 'flat axis' ELSE 'best point' END, 2 FROM best, axis)""") + """
SELECT lambda_1, seeds_k, beam_width, edge_cap, mrr, rationale FROM ranked ORDER BY p, mrr DESC, seeds_k, beam_width, edge_cap, lambda_1 LIMIT 1"""


def pinned(n: int, knob: str, where: str) -> str:
    """Round n of a descent: its points, and the value at the elbow or of the highest metric."""
    return f"""
round{n} AS (SELECT {knob} AS value, coalesce(mrr, 0) AS mrr FROM swept JOIN points USING (point) WHERE {where}),
slopes{n} AS (SELECT *, abs((lead(mrr) OVER w - mrr) / (lead(value) OVER w - value)) AS rise FROM round{n} WINDOW w AS (ORDER BY value)),
pin{n} AS (
  SELECT coalesce((SELECT min(value) FROM slopes{n} WHERE rise <= 0.1 * (SELECT max(rise) FROM slopes{n}) + 1e-12),
                  (SELECT value FROM round{n} ORDER BY mrr DESC, value LIMIT 1)) AS value)"""


ORACLE["ladder_descent"] = with_recursive(
    *swept(lambda_1=[0.5, 1.0, 1.5], beam=[1, 3, 5], cap=[2, 5, 20]), pinned(0, "lambda_1", "beam = 5 AND cap = 20"),
    pinned(1, "beam", "lambda_1 = (SELECT value FROM pin0) AND cap = 20"),
    pinned(2, "cap", "lambda_1 = (SELECT value FROM pin0) AND beam = (SELECT value FROM pin1)")) + " UNION ALL ".join(
    f"SELECT {n}::INT AS round, '{knob}' AS knob, r.value::DOUBLE AS value, r.mrr, r.value = p.value AS pinned FROM round{n} r, pin{n} p"
    for n, knob in enumerate(("lambda_1", "beam_width", "edge_cap")))


# --- calls to a model that fail ---------------------------------------------------------

_ANSWERED = f"""
prompts AS (
  SELECT chat_id, batch, 'Transcript:' || chr(10) || string_agg('[user] ' || text, chr(10) ORDER BY place)
         || chr(10) || chr(10) || 'Return the JSON now.' AS body, count(*) AS n_turns, sum(length(text)) AS n_chars
  FROM batched GROUP BY chat_id, batch),
called AS (SELECT *, substr(sha256(body), 1, 1) AS digit FROM prompts),
answers AS (
  SELECT *, digit NOT IN ('0', '1', '4', '5') AS answered,
         CASE digit WHEN '0' THEN 'failed after 3 attempts: 503 busy' WHEN '1' THEN 'failed after 3 attempts: reset'
                    WHEN '4' THEN '429 quota' WHEN '5' THEN 'response missing string content' END AS error,
         (CASE WHEN digit IN ('0', '1', '3') THEN 3 WHEN digit = '2' THEN 2 ELSE 1 END)::INT AS attempts,
         CASE WHEN digit IN ('0', '1', '3') THEN 600 WHEN digit = '2' THEN 200 ELSE 0 END AS waited_ms FROM called)"""
ORACLE["model_answers"] = with_(BATCHES, _ANSWERED) + "SELECT chat_id, batch, answered, error, attempts, waited_ms FROM answers"
ORACLE["model_write_path"] = with_(BATCHES, _ANSWERED, """
stopped AS (SELECT chat_id, min(batch) AS failed FROM answers WHERE NOT answered GROUP BY 1),
judged AS (SELECT a.*, failed IS NULL OR batch < failed AS drains FROM answers a LEFT JOIN stopped USING (chat_id))""") + """
SELECT chat_id, count(*) FILTER (drains) AS drained, count(*) FILTER (drains AND digit <> '6') AS facts,
       count(*) FILTER (drains AND digit <> '6') AS skipped, count(*) FILTER (drains AND digit = '6') AS parse_failures,
       coalesce(sum(n_turns) FILTER (NOT drains), 0)::BIGINT AS returned_turns,
       coalesce(sum(n_chars) FILTER (NOT drains), 0)::BIGINT AS returned_chars,
       count(*) FILTER (NOT drains AND NOT answered) AS failed_calls, min(batch) FILTER (NOT drains) AS first_returned
FROM judged GROUP BY chat_id"""


# --- whole forms of queries that read part of their tables; invariants ---------------------

ORACLE["lifecycle_bump_all"] = """
SELECT user_id::VARCHAR AS id,
       least(100.0, least(100.0, 20 + 3 * count(*) FILTER (event_type <> 'purchase'))
             + 5 * count(*) FILTER (event_type = 'purchase'))::DOUBLE AS importance,
       count(*) FILTER (event_type <> 'purchase') AS access_count, count(*) FILTER (event_type = 'purchase') AS update_count,
       epoch_us(coalesce(max(ts) FILTER (event_type = 'purchase'), min(ts))) AS updated_us
FROM events GROUP BY user_id"""
ORACLE["sweep_diff_all"] = with_(points("l_returnflag", "l_linenumber", "l_discount")) + """
SELECT a.l_returnflag || '/' || a.l_linenumber AS knob, a.l_discount AS value, round(b.mrr - a.mrr, 6) AS delta_mrr,
       round(b.coverage - a.coverage, 6) AS delta_coverage
FROM points a JOIN points b ON a.l_returnflag = b.l_returnflag AND a.l_discount = b.l_discount AND b.l_linenumber = a.l_linenumber + 1"""
ORACLE["consolidation_rates_all"] = ORACLE["consolidation_rates"].replace(" WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)", "")
ORACLE["trace_enrichment_all"] = ORACLE["trace_enrichment"].replace(" WHERE event_type = 'purchase'", "")
ORACLE["extraction_validate_all"] = with_(BATCHES) + """
SELECT chat_id, batch, 'ok' AS status, count(*) AS n_facts, count(*) AS skipped, sum(length(text))::BIGINT AS n_chars
FROM batched GROUP BY chat_id, batch"""
ORACLE["leiden_invariants"] = """
SELECT count(DISTINCT vec_id) AS nodes, true AS several, 0::BIGINT AS unplaced, 0::BIGINT AS repeated, 0::BIGINT AS misnamed,
       0::BIGINT AS split, 0 AS worse FROM embeddings"""
ORACLE["persona_invariants"] = with_(ENTRIES) + """
SELECT chat_id, subject, count(*) AS n_facts, 0::BIGINT AS uncovered, 0::BIGINT AS doubled, 0::BIGINT AS adrift
FROM entries WHERE scope = 'episodic' AND length(subject) > 0 GROUP BY chat_id, subject"""
