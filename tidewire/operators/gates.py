"""When a metered source may run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_hours(hours: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(336), hours))


def run_gate(forced: Column, last_run: Column, hours: Column, now: Column, run_hour: int = 0, minute_max: int = 10) -> Column:
    """struct(run boolean, reason string): forced, or due since the last run, or in the first run's UTC window.

    Times are seconds since 1970.
    """
    result = lambda run, reason: F.struct(F.lit(run).alias("run"), F.lit(reason).cast("string").alias("reason"))
    second = F.pmod(now, F.lit(86400))
    opens = F.floor(second / 3600) == run_hour
    first = opens & (F.floor(F.pmod(second, F.lit(3600)) / 60) <= minute_max)
    return (
        F.when(forced, result(True, None))
        .when(last_run.isNotNull() & (now < last_run + interval_hours(hours) * 3600), result(False, "before_run_interval"))
        .when(last_run.isNotNull() | first, result(True, None))
        .otherwise(result(False, "outside_initial_window"))
    )


# For each metered source the hours between its runs, the reads of a run and their cost.
METERED = {"x_api": {"hours": 24, "cap": 10, "least_cap": 10, "unit_cost": 0.0}, "socialdata": {"hours": 12, "cap": 20, "least_cap": 1, "unit_cost": 0.0002}, "tikhub": {"hours": 24, "cap": 20, "least_cap": 1, "unit_cost": 0.0}}


def toggle(value: Column, default: bool) -> Column:
    """A setting as a switch: unset or blank means the default, and only plain words for yes and no count."""
    said = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(said.isin("1", "true", "yes", "on"), True).when(said.isin("0", "false", "no", "off"), False).otherwise(F.lit(default))


def source_run(source: str, enabled: Column, has_key: Column, cap: Column, forced: Column, last_run: Column, now: Column, run_hour: int = 0, minute_max: int = 10) -> Column:
    """struct(enabled, run, reason, cap, max_cost): whether a metered source runs now; a key enables it, a switch kills it,
    a cap below its least skips it, and then the run gate decides. Columns that are null mean their defaults."""
    known = METERED[source]
    on = F.coalesce(enabled, F.lit(True)) & F.coalesce(has_key, F.lit(False))
    most = F.greatest(F.lit(0), F.coalesce(cap, F.lit(known["cap"])))
    gate = run_gate(F.coalesce(forced, F.lit(False)), last_run, F.lit(known["hours"]), now, run_hour, minute_max)
    small = most < known["least_cap"]
    reason = F.when(~F.coalesce(has_key, F.lit(False)), "no_credentials").when(~on, "disabled").when(small, "cap_too_small").otherwise(gate["reason"])
    return F.struct(on.alias("enabled"), (on & ~small & gate["run"]).alias("run"), reason.alias("reason"), most.alias("cap"), F.round(most * known["unit_cost"], 4).alias("max_cost"))


def updated_state(state: DataFrame, attempts: DataFrame, now: Column) -> DataFrame:
    """The run state (source, last_run_at, last_ok, last_item_count, last_success_at, last_error) after a run's attempts
    (source, attempted, ok, item_count, error): only sources that were tried change, and success clears the error."""
    tried = attempts.where("attempted").select("source", F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("item_count", F.lit(0)).cast("long").alias("items"), "error", F.lit(True).alias("new"))
    both = state.join(tried, "source", "full_outer")
    new, ok = F.coalesce("new", F.lit(False)), F.col("ok")
    pick = lambda a, b: F.when(new, a).otherwise(F.col(b)).alias(b)
    error = F.when(new & ok, None).when(new, F.coalesce("error", "last_error")).otherwise(F.col("last_error"))
    return both.select("source", pick(now, "last_run_at"), pick(ok, "last_ok"), pick(F.col("items"), "last_item_count"), F.when(new & ok, now).otherwise(F.col("last_success_at")).alias("last_success_at"), error.alias("last_error"))
