"""Content-derived identifiers and stable hashes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from rememora.params import SCOPE_PREFIX


def _joined(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), ",")


def entry_id(scope: Column, at: Column, content: Column, subject: Column, tags: Column,
             sources: Column, extractor: Column) -> Column:
    """``<prefix>_<UTC second>_<12 hex digits>``; tag order and null/'' subject do not matter."""
    seed = F.concat_ws("|", scope, content, F.coalesce(subject, F.lit("")),
                       _joined(F.sort_array(tags)), _joined(sources), extractor)
    prefix = F.create_map(*[F.lit(x) for x in chain(*SCOPE_PREFIX.items())])
    return F.concat_ws(
        "_", F.element_at(prefix, scope),
        F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"),
        F.substring(F.sha2(seed, 256), 1, 12))


def cache_key(model: Column, messages_json: Column, max_tokens: Column) -> Column:
    nul = F.lit("\x00")
    return F.sha2(F.concat(model, nul, messages_json, nul, max_tokens.cast("string")), 256)


def row_digest(*parts: Column) -> Column:
    """A 60-bit positive number per row; sums of it identify a multiset of rows."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
