"""Rule-based fact extraction and parsing of model answers, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rememora.functions.text import SPACE, bind, entities, strip_space
from rememora.params import DEFAULTS, EDGE_TYPES, ENTITY_STOP_WORDS, RESERVED_EDGE_TYPES, RESERVED_TARGETS, Params

# --- fixed values ---------------------------------------------------------------
MIN_TAG_LENGTH = 4
ROLE_LINE = r"^\[(user|assistant|system)\]" + SPACE + r"+(.*)$"
SENTENCE_END = r"[.!?]+" + SPACE + "+"
TAG_STOP_WORDS = tuple(w.lower() for w in ENTITY_STOP_WORDS)
EXTRACTION_PROMPT = """You extract durable facts from a transcript of chat messages.

Output STRICT JSON, no prose, no markdown fences, matching this schema:
{
  "entries": [
    {
      "content": "<one factual statement, 1-2 sentences, third person>",
      "subject": "<canonical subject name or null if none>",
      "tags": ["<short topical tags>", ...],
      "relations": [
        { "type": "<mentions|supports|same_topic|temporal_next>", "target": "<other entry id or stable subject string>" }
      ]
    }
  ]
}

Rules:
- Only extract facts durably relevant to the character or world. Skip pleasantries, acknowledgments, and filler.
- If nothing durable, return {"entries": []}.
- "subject" is the character, place, or entity the fact is ABOUT.
- "tags" are lowercase single words or short multi-word strings.
- Relations are optional; omit the field entirely if none.
- Do not emit "contradicts" relations; that type is reserved."""
# --- end of fixed values ----------------------------------------------------------

FACT = ("array<struct<content:string,subject:string,tags:array<string>,"
        "relations:array<struct<type:string,target:string>>>>")


def transcript(messages: Column) -> Column:
    """``[role] content`` lines of an array of (role, content)."""
    return F.array_join(F.transform(
        messages, lambda m: F.concat(F.lit("["), m["role"], F.lit("] "), m["content"])), "\n")


def prompt_messages(messages: Column) -> Column:
    """System and user message of an extraction request."""
    user = F.concat(F.lit("Transcript:\n"), transcript(messages), F.lit("\n\nReturn the JSON now."))
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(EXTRACTION_PROMPT).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")))


def _words(sentence: Column) -> Column:
    return F.filter(F.split(sentence, SPACE + "+"), lambda w: F.length(w) > 0)


def first(values: Column, limit: int | None) -> Column:
    return values if limit is None else F.slice(values, 1, limit)


def _tags(sentence: Column, subject: Column, limit: int | None) -> Column:
    cleaned = F.transform(_words(sentence), lambda w: F.regexp_replace(F.lower(w), "[^a-z]", ""))
    useful = F.filter(cleaned, lambda w: (F.length(w) >= MIN_TAG_LENGTH) & (w != F.lower(subject))
                      & ~w.isin(*TAG_STOP_WORDS))
    return first(F.array_distinct(useful), limit)


def rule_facts(messages: Column, params: Params = DEFAULTS) -> Column:
    """All facts of a batch: sentences of ``min_words`` words or more that name a subject.

    Lines without a role prefix are not read, so of a message that spans several
    lines only the first counts, unless ``join_lines`` makes them one.
    """
    if params.join_lines:
        messages = F.transform(messages, lambda m: F.struct(
            m["role"].alias("role"), F.translate(m["content"], "\n", " ").alias("content")))
    lines = F.filter(F.split(transcript(messages), "\n"), lambda line: line.rlike(ROLE_LINE))
    body = F.array_join(F.transform(lines, lambda line: F.regexp_extract(line, ROLE_LINE, 2)), " ")
    sentences = F.transform(F.split(body, SENTENCE_END), strip_space)
    named = F.transform(sentences, lambda s: F.struct(
        s.alias("content"), F.get(entities(s), F.lit(0)).alias("subject"), F.size(_words(s)).alias("n")))
    facts = F.filter(named, lambda s: (s["n"] >= params.min_words) & s["subject"].isNotNull())
    return bind(facts, lambda kept: F.transform(kept, lambda f: F.struct(
        f["content"].alias("content"), f["subject"].alias("subject"),
        _tags(f["content"], f["subject"], params.max_tags).alias("tags"),
        F.array().cast("array<struct<type:string,target:string>>").alias("relations"))))


def unfenced(answer: Column) -> Column:
    """Trimmed answer without one surrounding code fence."""
    trimmed = strip_space(answer)
    fence = r"^```(?:json)?" + SPACE + r"*([\s\S]*?)" + SPACE + r"*```$"
    return F.when(trimmed.rlike(fence), strip_space(F.regexp_extract(trimmed, fence, 1))).otherwise(trimmed)


def parse_answer(answer: Column) -> Column:
    """The answer as a VARIANT, NULL when it is not JSON."""
    return F.try_parse_json(unfenced(answer))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def answer_status(parsed: Column) -> Column:
    """ok, parse_failure, not_object or no_entries."""
    entries = F.try_variant_get(parsed, "$.entries", "variant")
    return (F.when(parsed.isNull(), "parse_failure")
            .when(~_kind(parsed).startswith("OBJECT"), "not_object")
            .when(entries.isNull() | ~F.coalesce(_kind(entries).startswith("ARRAY"), F.lit(False)), "no_entries")
            .otherwise("ok"))


def _text_field(item: Column, path: str) -> Column:
    value = F.try_variant_get(item, path, "variant")
    return F.when(_kind(value) == "STRING", F.try_variant_get(item, path, "string"))


def _absent(item: Column, path: str) -> Column:
    value = F.try_variant_get(item, path, "variant")
    return value.isNull() | F.is_variant_null(value)


def skip_reason(item: Column) -> Column:
    """Why one extracted item is unusable, or NULL when it is fine."""
    def list_of(path):
        return F.when(_absent(item, path), F.array().cast("array<variant>")).otherwise(
            F.try_variant_get(item, path, "array<variant>"))

    tags, relations = list_of("$.tags"), list_of("$.relations")

    def relation_fault(r):
        kind, target = _text_field(r, "$.type"), _text_field(r, "$.target")
        return (F.when(kind.isNull() | target.isNull() | (F.length(target) == 0), "relation_shape")
                .when(~kind.isin(*EDGE_TYPES), "relation_type")
                .when(~kind.isin(*RESERVED_EDGE_TYPES) & target.isin(*RESERVED_TARGETS), "relation_target"))

    content = _text_field(item, "$.content")
    return (
        F.when(item.isNull() | F.is_variant_null(item)
               | ~(_kind(item).startswith("OBJECT") | _kind(item).startswith("ARRAY")), "not_object")
        .when(content.isNull() | (F.length(content) == 0), "content")
        .when(~_absent(item, "$.subject") & _text_field(item, "$.subject").isNull(), "subject")
        .when(tags.isNull() | ~F.forall(tags, lambda t: F.coalesce(_kind(t) == "STRING", F.lit(False))), "tags")
        .when(relations.isNull(), "relations")
        .otherwise(F.get(F.filter(F.transform(relations, relation_fault), lambda r: r.isNotNull()), F.lit(0))))


def item_fields(item: Column) -> Column:
    """A usable item as a fact struct; reserved relation types are left out."""
    relations = F.try_variant_get(item, "$.relations", "array<struct<type:string,target:string>>")
    allowed = F.filter(relations, lambda r: ~r["type"].isin(*RESERVED_EDGE_TYPES))
    return F.struct(
        _text_field(item, "$.content").alias("content"),
        _text_field(item, "$.subject").alias("subject"),
        F.coalesce(F.try_variant_get(item, "$.tags", "array<string>"),
                   F.array().cast("array<string>")).alias("tags"),
        F.coalesce(allowed, F.array().cast("array<struct<type:string,target:string>>")).alias("relations"))
