"""Named scorers: Column factories, so a custom scorer stays inside codegen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from rememora.functions.lifecycle import prior
from rememora.operators.ranking import rounded
from rememora.params import DEFAULTS, Params

# a scorer sees the entry columns plus ``bm25`` and ``intent``
Scorer = Callable[[Column, Params], Column]


def entry_prior(now: Column, params: Params = DEFAULTS) -> Column:
    return prior(now, F.col("importance"), F.col("maturity"), F.col("created_at"), params)


def default_scorer(now: Column, params: Params = DEFAULTS) -> Column:
    """bm25 x (1 + importance/100) x recency x maturity; zero without a lexical match."""
    return rounded(F.when(F.col("bm25") == 0, F.lit(0.0)).otherwise(F.col("bm25") * entry_prior(now, params)))


class ScorerRegistry:
    def __init__(self):
        self._scorers: dict[str, Scorer] = {"default": default_scorer}
        self.current = "default"

    def register(self, name: str, scorer: Scorer) -> None:
        if not isinstance(name, str) or not name:
            raise ValueError("scorer name must be a non-empty string")
        if not callable(scorer):
            raise TypeError("scorer must be callable")
        if self._scorers.get(name) is scorer:
            return
        if name in self._scorers:
            raise ValueError(f"scorer '{name}' is already registered")
        self._scorers[name] = scorer

    def use(self, name: str) -> None:
        if name not in self._scorers:
            raise KeyError(f"scorer '{name}' is not registered")
        self.current = name

    def get(self, name: str | None = None) -> Scorer:
        return self._scorers[name or self.current]
