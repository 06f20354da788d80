"""Retention policies as a table keyed by ``dir_name``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelflife.functions.messages import retention_message

# What applies where a policy says nothing.
DEFAULTS = {
    "retention_hours": 24,
    "clean_on_session_end": True,
    "dry_run": False,
    "session_end_summary": True,
}
TYPES = {
    "retention_hours": "int",
    "clean_on_session_end": "boolean",
    "dry_run": "boolean",
    "session_end_summary": "boolean",
}


def settings_of(policy: dict | None) -> dict:
    """The settings of one run: what the policy says, defaults where it is silent or NULL."""
    return {**DEFAULTS, **{name: value for name, value in (policy or {}).items() if value is not None}}


def _typed(name: str, column: Column) -> Column:
    return column.cast(TYPES[name]) if name in TYPES else column


def overlay(policy: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Stored values win, absent columns and NULLs take the default, unknown columns are kept."""
    filled = {}
    for name, value in {**DEFAULTS, **(defaults or {})}.items():
        stored = [_typed(name, F.col(name))] if name in policy.columns else []
        filled[name] = F.coalesce(*stored, _typed(name, F.lit(value)))
    return policy.withColumns(filled)


def policies_for(roots: DataFrame, policy: DataFrame, defaults: dict | None = None) -> DataFrame:
    """The policy of every root, defaults where none is stored. Both sides have one row per root."""
    return overlay(roots.join(policy, "dir_name", "left"), defaults)


def effective_retention(override: Column, configured: Column) -> Column:
    """A given override wins; NULL and 0 mean "use the configured hours", negatives pass."""
    return F.coalesce(F.nullif(override, F.lit(0)), configured)


def effective_dry_run(flag: Column, configured: Column) -> Column:
    """The flag can only turn a dry run on."""
    return F.coalesce(flag, F.lit(False)) | F.coalesce(configured, F.lit(DEFAULTS["dry_run"]))


def runs_on_session_end(enabled: Column) -> Column:
    return F.coalesce(enabled, F.lit(DEFAULTS["clean_on_session_end"]))


def shows_summary(enabled: Column) -> Column:
    return F.coalesce(enabled, F.lit(DEFAULTS["session_end_summary"]))


def is_valid_retention(hours: Column) -> Column:
    return F.coalesce(hours >= 0, F.lit(False))


def update_outcome(updates: DataFrame) -> DataFrame:
    """Each requested update with whether it is accepted and the line reported for it."""
    hours = F.col("retention_hours")
    accepted = is_valid_retention(hours)
    return updates.withColumns({"accepted": accepted, "message": retention_message(accepted, hours)})


def set_retention(policy: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply updates ``(dir_name, retention_hours, updated_at)`` to the policy table.

    Negative hours are rejected, the last accepted update of a root wins, other columns stay, and a
    root without a stored policy gains one. An update without a time counts as older than all others; of
    updates of one time the larger window wins. A stored policy without hours gains the column. Updates are reduced per root before the join, so many
    updates of one root cost a partial aggregate and not a hot join key.
    """
    # A NULL time is the least field of a struct.
    latest = (
        updates.where(is_valid_retention(F.col("retention_hours")))
        .groupBy("dir_name")
        .agg(F.max(F.struct("updated_at", "retention_hours"))["retention_hours"].cast("int").alias("_new_hours"))
    )
    if "retention_hours" not in policy.columns:
        policy = policy.withColumn("retention_hours", F.lit(None).cast("int"))
    return (
        policy.join(latest, "dir_name", "full_outer")
        .withColumn("retention_hours", F.coalesce("_new_hours", "retention_hours"))
        .drop("_new_hours")
    )
