"""Usage metering: J7, F23, A4-A7, W3, W4, W6, T5 as a batch.

``calls`` is an append-only log: ts, model, task_id, input_chars, output_chars.
Every counter is an aggregate over it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from newsmill import fixed
from newsmill.functions.arrays import col
from newsmill.operators import ordered
from newsmill.operators.joins import first_pattern


def _first_price(model: Column, table, default):
    """Values of the first table entry whose name is in the model name."""
    out = []
    for i in range(1, len(table[0])):
        hit = None
        for row in table:
            test = F.contains(model, F.lit(row[0]))
            hit = F.when(test, row[i]) if hit is None else hit.when(test, row[i])
        out.append(hit.otherwise(default[i - 1]))
    return out


def model_name(model: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(col(model), F.lit("unknown")), "^models/", "")


def cost(
    model: Column | str,
    input_chars: Column | str,
    output_chars: Column | str,
    price_in: Column | None = None,
    price_out: Column | None = None,
) -> Column:
    """dollars of one call, rounded to six places."""
    m = col(model)
    if price_in is None or price_out is None:
        price_in, price_out = _first_price(m, fixed.PRICING, fixed.DEFAULT_PRICE)
    factor = F.when(F.contains(m, F.lit(fixed.THINKING_MARK)), fixed.THINKING_MULTIPLIER).otherwise(1)
    tokens = lambda c: col(c) / fixed.CHARS_PER_TOKEN
    return F.round(
        tokens(input_chars) * price_in / 1_000_000
        + tokens(output_chars) * factor * price_out / 1_000_000,
        6,
    )


def rate_limits(model: Column | str) -> tuple[Column, Column]:
    """Calls per minute and per day allowed for a model."""
    rpm, rpd = _first_price(model_name(model), fixed.RATE_LIMITS, fixed.DEFAULT_RATE_LIMIT)
    return rpm, rpd


def price_calls(calls: DataFrame, pricing: DataFrame | None = None, model: str = "model") -> DataFrame:
    """Add the cost, from a pricing table when one is given.

    ``pricing``: priority, model_pattern, in_per_m, out_per_m; the first pattern
    contained in the model name wins, the default price takes the rest.
    """
    if pricing is None:
        return calls.withColumn("cost", cost(model, "input_chars", "output_chars"))
    priced = first_pattern(
        calls, model, pricing, "model_pattern", "priority", ["in_per_m", "out_per_m"]
    )
    default_in, default_out = fixed.DEFAULT_PRICE
    return priced.withColumn(
        "cost",
        cost(
            model, "input_chars", "output_chars",
            F.coalesce("in_per_m", F.lit(default_in)), F.coalesce("out_per_m", F.lit(default_out)),
        ),
    ).drop("in_per_m", "out_per_m")


# --- rollups ----------------------------------------------------------------

def rollup(calls: DataFrame, unit: str, keys: Sequence[str] = ()) -> DataFrame:
    """A4: calls and cost per day or month."""
    return calls.groupBy(*keys, F.date_trunc(unit, F.col("ts")).alias(unit)).agg(
        F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost"), 6).alias("cost_estimate")
    )


def task_totals(calls: DataFrame, as_of: Column | str, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """A5: calls today and this month, and the last run, per task."""
    now = col(as_of)
    same = lambda unit: F.date_trunc(unit, F.col("ts")) == F.date_trunc(unit, now)
    return calls.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(
        F.count_if(same("day")).alias("calls_today"),
        F.count_if(same("month")).alias("calls_this_month"),
        F.max("ts").alias("last_run"),
    )


def daily_history(calls: DataFrame, as_of: Column | str, days: int = fixed.HISTORY_DAYS) -> DataFrame:
    """The last ``days`` days that had calls, before the day of ``as_of``."""
    by_day = rollup(calls, "day").where(F.col("day") < F.date_trunc("day", col(as_of)))
    # One row per day of the log: the limit is over days, not over calls.
    return by_day.orderBy(F.desc("day")).limit(days)


def usage_snapshot(
    calls: DataFrame, as_of: Column | str, limits: Mapping[str, Any] = fixed.DEFAULT_LIMITS
) -> DataFrame:
    """Counters of the day and month next to the limits."""
    limits = {**fixed.DEFAULT_LIMITS, **limits}
    now = col(as_of)
    today = F.date_trunc("day", F.col("ts")) == F.date_trunc("day", now)
    month = F.date_trunc("month", F.col("ts")) == F.date_trunc("month", now)
    spent = lambda test: F.coalesce(F.round(F.sum(F.when(test, F.col("cost"))), 6), F.lit(0.0))
    budget = F.lit(float(limits["monthly_budget_usd"]))
    out = calls.agg(
        F.count_if(today).alias("daily_calls"),
        F.count_if(month).alias("monthly_calls"),
        spent(today).alias("daily_cost_estimate"),
        spent(month).alias("monthly_cost_estimate"),
    )
    over = F.col("monthly_cost_estimate") >= budget
    return out.select(
        "*",
        F.lit(limits["daily_max_calls"]).cast("long").alias("daily_limit"),
        F.lit(limits["monthly_max_calls"]).cast("long").alias("monthly_limit"),
        budget.alias("monthly_budget_usd"),
        (
            F.lit(not limits["enabled"])
            | (
                (F.col("daily_calls") < limits["daily_max_calls"])
                & (F.col("monthly_calls") < limits["monthly_max_calls"])
            )
        ).alias("within_limits"),
        over.alias("over_budget"),
        (F.lit(bool(limits["cooldown_enabled"])) & over).alias("cooldown_active"),
    )


# --- ordered logic ----------------------------------------------------------

def running_usage(calls: DataFrame, unit: str = "month", keys: Sequence[str] = ()) -> DataFrame:
    """Running calls and cost within a day or month, in order of (ts, call_id)."""
    by = calls.withColumn("period", F.date_trunc(unit, F.col("ts")))
    out = ordered.running_totals(
        by, [*keys, "period"], ["ts", "call_id"],
        {"running_calls": F.lit(1).cast("long"), "running_cost": F.col("cost").cast("decimal(28,6)")},
    )
    return out.withColumn("running_cost", F.col("running_cost").cast("double"))


def first_over(running: DataFrame, cap: float, keys: Sequence[str] = ("period",)) -> DataFrame:
    """The first moment at which the running cost reaches the cap."""
    return (
        running.where(F.col("running_cost") >= cap)
        .groupBy(*keys)
        .agg(F.min("ts").alias("reached_at"))
    )


def recent_calls(calls: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Calls in the last 60 seconds."""
    return ordered.calls_in_last(calls, keys, "ts", 60, "recent_calls")


def last_calls(calls: DataFrame, keys: Sequence[str] = (), n: int = fixed.LOG_ROWS) -> DataFrame:
    """The newest rows of the log."""
    if keys:
        return ordered.last_rows(calls, keys, [F.desc("ts"), F.desc("call_id")], n)
    return calls.orderBy(F.desc("ts"), F.desc("call_id")).limit(n)
