"""Tunable constants of the engine, in one immutable object.

A sweep derives a variant with :meth:`Params.override`; nothing is mutated, so
two variants can be planned side by side in one Spark session.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# --- fixed values (must equal the published memory model) -------------------
SCOPES = ("working", "episodic", "persona")
MATURITY_TIERS = ("draft", "validated", "core")
EDGE_TYPES = ("mentions", "supports", "same_topic", "temporal_next", "contradicts")
RESERVED_EDGE_TYPES = ("contradicts",)
RESERVED_TARGETS = ("__proto__", "constructor", "prototype")
INTENTS = ("factual", "relational", "temporal")
SCOPE_PREFIX = {"working": "wk", "episodic": "ep", "persona": "ps"}
MATURITY_BOOST = {"draft": 0.85, "validated": 1.0, "core": 1.2}
EDGE_TYPE_WEIGHTS = {
    "supports": {"factual": 0.9, "relational": 0.5, "temporal": 0.3},
    "mentions": {"factual": 0.7, "relational": 0.9, "temporal": 0.3},
    "same_topic": {"factual": 0.5, "relational": 0.8, "temporal": 0.5},
    "temporal_next": {"factual": 0.3, "relational": 0.4, "temporal": 0.9},
    "contradicts": {"factual": 0.2, "relational": 0.3, "temporal": 0.2},
}
ENTITY_STOP_WORDS = (
    "A", "I", "The", "It", "Is", "In", "Of", "Or", "On", "At", "To", "An", "As",
    "Be", "By", "Do", "Go", "He", "Me", "My", "No", "So", "Up", "Us", "We",
)
STANDARD_K = (1, 3, 5, 10)
# --- end of fixed values -----------------------------------------------------

SWEEPABLE = frozenset({
    "lambda_1", "lambda_2", "max_hops", "seeds_k", "beam_width", "edge_cap",
    "cooccurrence_weight", "explicit_weight", "subject_boost", "tag_boost",
    "cache_cap", "dedup_threshold", "batch_size", "buffer_threshold",
    "extract_max_tokens", "max_facts", "max_tags", "min_words", "join_lines",
})


@dataclass(frozen=True)
class Params:
    # ranking
    k1: float = 1.2
    b: float = 0.75
    delta: float = 1.0
    subject_boost: int = 2
    tag_boost: int = 2
    # ladder
    fuzzy_threshold: float = 0.6
    candidates_k: int = 10
    seeds_k: int = 3
    beam_width: int = 5
    max_hops: int = 2
    lambda_1: float = 1.0
    lambda_2: float = 0.3
    cache_cap: int = 200
    trace_cap: int = 128
    # graph
    edge_cap: int = 20
    explicit_weight: float = 1.0
    cooccurrence_weight: float = 0.5
    # lifecycle
    access_bonus: float = 3.0
    update_bonus: float = 5.0
    daily_decay: float = 0.995
    recency_tau_days: float = 30.0
    promote_validated: float = 65.0
    promote_core: float = 85.0
    demote_draft: float = 35.0
    demote_validated: float = 60.0
    # consolidation
    buffer_threshold: int = 10
    batch_size: int = 5
    idle_seconds: int = 60
    rebuild_suggestion: int = 100
    dedup_threshold: float = 0.7
    extract_max_tokens: int = 4096
    # rule extraction: facts kept of a batch and tags of a fact (None: all), words a fact needs at least,
    # and whether a message's later lines are read as part of its first
    max_facts: int | None = 5
    max_tags: int | None = 3
    min_words: int = 4
    join_lines: bool = False
    # persona rebuild
    knn_base: int = 15
    knn_step: int = 5
    gamma_base: float = 1.0
    gamma_step: float = 0.2
    max_depth: int = 3
    min_cluster_size: int = 2
    leiden_tolerance: float = 1e-6
    leiden_max_outer: int = 32
    embedding_dim: int = 16

    def override(self, **changes) -> "Params":
        """A copy with swept knobs replaced; any other name is refused."""
        unknown = sorted(set(changes) - SWEEPABLE)
        if unknown:
            raise ValueError(f"unknown or non-sweepable parameter: {', '.join(unknown)}")
        return replace(self, **changes)

    def knn_k(self, depth: int) -> int:
        if depth < 0 or int(depth) != depth:
            raise ValueError("depth must be a non-negative integer")
        return self.knn_base + depth * self.knn_step

    def gamma(self, depth: int) -> float:
        if depth < 0:
            raise ValueError("depth must be non-negative")
        return max(0.01, self.gamma_base - depth * self.gamma_step)


DEFAULTS = Params()


# fixed values: accepted bounds of the host settings
SETTINGS_BOUNDS = {"buffer_size": (1, 50), "idle_ms": (5_000, 600_000), "trace_cap": (16, 1024)}


@dataclass(frozen=True)
class Settings:
    """Host settings that matter to the engine, clamped into their bounds."""

    buffer_size: int = 5
    idle_ms: int = 60_000
    trace_cap: int = 128
    scorer: str = "default"
    injection_mode: str = "automatic"

    def __post_init__(self):
        for name, (low, high) in SETTINGS_BOUNDS.items():
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value:
                value = type(self).__dataclass_fields__[name].default
            object.__setattr__(self, name, int(min(high, max(low, round(value)))))
        if self.injection_mode not in ("automatic", "macro", "off"):
            object.__setattr__(self, "injection_mode", "automatic")

    def params(self, base: Params = DEFAULTS) -> Params:
        return replace(base, buffer_threshold=self.buffer_size,
                       idle_seconds=self.idle_ms // 1000, trace_cap=self.trace_cap)
