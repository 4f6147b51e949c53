"""Lifecycle arithmetic: recency, maturity, importance and the entry prior."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rememora.params import DEFAULTS, MATURITY_BOOST, MATURITY_TIERS, Params

MS_PER_DAY = 86_400_000.0


def recency(now: Column, created: Column, tau_days: float = DEFAULTS.recency_tau_days) -> Column:
    if not tau_days > 0:
        raise ValueError("tau must be a positive number of days")
    age = (F.unix_millis(now) - F.unix_millis(created)) / F.lit(MS_PER_DAY)
    return F.exp(-F.greatest(F.lit(0.0), age) / F.lit(float(tau_days)))


def maturity_boost(maturity: Column) -> Column:
    boost = None
    for tier, value in MATURITY_BOOST.items():
        boost = (F.when if boost is None else boost.when)(maturity == tier, F.lit(value))
    return boost.otherwise(F.raise_error(F.concat(F.lit("invalid maturity: "),
                                                  F.coalesce(maturity, F.lit("null")))).cast("double"))


def next_maturity(importance: Column, current: Column, params: Params = DEFAULTS) -> Column:
    """One hysteresis step per evaluation."""
    return (
        F.when((importance < 0) | (importance > 100) | importance.isNull(),
               F.raise_error(F.lit("importance out of range")).cast("string"))
        .when(current == "draft",
              F.when(importance >= params.promote_validated, "validated").otherwise("draft"))
        .when(current == "validated",
              F.when(importance >= params.promote_core, "core")
              .when(importance < params.demote_draft, "draft").otherwise("validated"))
        .when(current == "core",
              F.when(importance < params.demote_validated, "validated").otherwise("core"))
        .otherwise(F.raise_error(F.lit("invalid maturity")).cast("string"))
    )


def clamp_importance(value: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), value))


def bumped(importance: Column, events: Column, bonus: float) -> Column:
    """Importance after ``events`` equal positive bonuses (clamping once is exact)."""
    return clamp_importance(importance + F.lit(bonus) * events)


def decayed(importance: Column, days: Column, params: Params = DEFAULTS) -> Column:
    checked = F.when(days < 0, F.raise_error(F.lit("days must be >= 0")).cast("double")).otherwise(days)
    return clamp_importance(importance * F.pow(F.lit(params.daily_decay), checked))


def prior(now: Column, importance: Column, maturity: Column, created: Column,
          params: Params = DEFAULTS) -> Column:
    """Query-independent weight of an entry: what scoring multiplies into BM25."""
    return (
        (F.lit(1.0) + importance / F.lit(100.0))
        * recency(now, created, params.recency_tau_days)
        * maturity_boost(maturity)
    )


def is_maturity(value: Column) -> Column:
    return F.coalesce(value.isin(*MATURITY_TIERS), F.lit(False))
