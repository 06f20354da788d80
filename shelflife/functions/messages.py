"""Report texts as columns."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, functions as F

from shelflife.functions.formats import format_size, one_decimal

# The wording of the report lines.
FILE_PLANNED = "[DRY RUN] Would delete: {path} ({size})"
DIR_PLANNED = "[DRY RUN] {dir_name}: Would delete {files} files ({size})"
DIR_DONE = "{dir_name}: Deleted {files} files ({size} freed)"
RUN_START = "Starting cleanup (retention: {hours}h, dry_run: {dry_run})"
RUN_NOTHING = "No files older than {hours}h found"
RUN_DONE = "Cleanup complete: {files} files processed"
SESSION_PLANNED = "Would clean {files} files ({size})"
SESSION_PLANNED_NOTHING = "No old files to clean"
SESSION_DONE = "Cleaned {files} files ({size} freed)"
SESSION_DONE_NOTHING = "No old files found"
STATUS = "  {dir_name}: {size} ({files} files)"
STATUS_VIOLATIONS = " ⚠️  {violations} violations"
OLDEST = "Oldest file: {age} hours ago"
VERDICT_VIOLATIONS = "⚠️  Retention violations: {violations} files exceed {hours}h"
VERDICT_NOTHING = "✓ No retention violations"
RETENTION_SET = "Retention period set to {hours} hours"
RETENTION_INVALID = "Invalid hours value: {hours}"

# The caller's name in front of the session-end line.
RUN_TAG = "[retention] "


def fill(template: str, **columns: Column) -> Column:
    """A text with columns in its places; NULL if one of them is."""
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name:
            parts.append(columns[name].cast("string"))
    return F.concat(*parts)


def file_message(path: Column, size: Column, dry_run: Column) -> Column:
    """What a dry run would do to one file; NULL in a real run."""
    return F.when(dry_run, fill(FILE_PLANNED, path=path, size=format_size(size)))


def dir_message(dir_name: Column, files: Column, size: Column, dry_run: Column) -> Column:
    """One root's result; NULL when it had nothing to purge."""
    values = {"dir_name": dir_name, "files": files, "size": format_size(size)}
    text = F.when(dry_run, fill(DIR_PLANNED, **values)).otherwise(fill(DIR_DONE, **values))
    return F.when(files > 0, text)


def start_message(hours: Column, dry_run: Column) -> Column:
    flag = F.when(dry_run, F.lit("True")).otherwise(F.lit("False"))
    return fill(RUN_START, hours=hours, dry_run=flag)


def total_message(files: Column, hours: Column) -> Column:
    return F.when(files == 0, fill(RUN_NOTHING, hours=hours)).otherwise(fill(RUN_DONE, files=files))


def session_message(files: Column, size: Column, dry_run: Column, tag: str = RUN_TAG) -> Column:
    """The line shown when a session ends: dry run or not, any files or none."""
    values = {"files": files, "size": format_size(size)}
    planned = F.when(files > 0, fill(SESSION_PLANNED, **values)).otherwise(F.lit(SESSION_PLANNED_NOTHING))
    done = F.when(files > 0, fill(SESSION_DONE, **values)).otherwise(F.lit(SESSION_DONE_NOTHING))
    return F.concat(F.lit(tag), F.when(dry_run, planned).otherwise(done))


def status_line(dir_name: Column, size: Column, files: Column, violations: Column) -> Column:
    warning = F.when(violations > 0, fill(STATUS_VIOLATIONS, violations=violations))
    line = fill(STATUS, dir_name=dir_name, size=format_size(size), files=files)
    return F.concat(line, F.coalesce(warning, F.lit("")))


def oldest_message(max_age_hours: Column) -> Column:
    """Age of the oldest file; NULL when there is none."""
    return fill(OLDEST, age=one_decimal(max_age_hours))


def verdict_message(violations: Column, hours: Column) -> Column:
    found = fill(VERDICT_VIOLATIONS, violations=violations, hours=hours)
    return F.when(violations > 0, found).otherwise(F.lit(VERDICT_NOTHING))


def retention_message(accepted: Column, hours: Column) -> Column:
    text = F.coalesce(hours.cast("string"), F.lit("NULL"))
    return F.when(accepted, fill(RETENTION_SET, hours=text)).otherwise(fill(RETENTION_INVALID, hours=text))
