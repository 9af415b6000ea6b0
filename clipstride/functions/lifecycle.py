"""Columns over job, task and event rows: states, labels, policies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Progress shown for each job state.
PROGRESS = {
    "NEW": 0, "QUEUED_FOR_DOWNLOAD": 5, "DOWNLOADING": 18, "QUEUED_FOR_PROCESSING": 28,
    "EXTRACTING_AUDIO": 36, "TRANSCRIBING": 48, "DETECTING_SILENCE": 68, "ANALYZING_WINDOWS": 84,
    "GENERATING_CANDIDATES": 94, "EXPORTING_CLIP": 92, "READY_FOR_REVIEW": 100, "COMPLETED": 100,
    "CANCELED": 0, "FAILED": 0,
}
# Job states by meaning.
ANALYZE_STAGES = (
    "EXTRACTING_AUDIO", "TRANSCRIBING", "DETECTING_SILENCE", "ANALYZING_WINDOWS", "GENERATING_CANDIDATES",
)
RETRYABLE = ("FAILED",)
CANCELABLE = ("QUEUED_FOR_DOWNLOAD", "QUEUED_FOR_PROCESSING")
FORCE_FAILABLE = ("DOWNLOADING", *ANALYZE_STAGES, "EXPORTING_CLIP")
DELETABLE = ("COMPLETED", "FAILED", "CANCELED", "READY_FOR_REVIEW")
COMPLETABLE = ("READY_FOR_REVIEW",)
PROCESSING_NOW = ("DOWNLOADING", *ANALYZE_STAGES)
FINISHED = ("COMPLETED", "FAILED", "CANCELED")
ROLES = ("download", "processing", "export")

# Retry and staleness policies in seconds, per task type.
MAX_ATTEMPTS = {"DOWNLOAD": 3, "ANALYZE": 3, "EXPORT": 3}
INITIAL_BACKOFF_SEC = {"DOWNLOAD": 15, "ANALYZE": 30, "EXPORT": 15}
MAX_BACKOFF_SEC = {"DOWNLOAD": 120, "ANALYZE": 300, "EXPORT": 120}
STALE_AFTER_SEC = {"DOWNLOAD": 900, "ANALYZE": 1200, "EXPORT": 120}

# Events always shown in a timeline, and the order of its phases.
IMPORTANT_EVENTS = (
    "JOB_CREATED", "JOB_QUEUED_FOR_DOWNLOAD", "JOB_DOWNLOAD_COMPLETED", "JOB_QUEUED_FOR_PROCESSING",
    "JOB_READY_FOR_REVIEW", "EXPORT_STARTED", "EXPORT_COMPLETED", "JOB_RETRIED", "JOB_FAILED",
    "JOB_CANCELED", "JOB_FORCE_FAILED",
)
PHASES = ("ingest", "processing", "moderation", "export", "failure")


def lookup(key: Column, values: dict) -> Column:
    """A fixed mapping as one native map access; null for unknown keys."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def status_progress(status: Column) -> Column:
    return F.coalesce(lookup(F.upper(status), PROGRESS), F.lit(0)).cast("long")


def shown_progress(raw: Column, status: Column) -> Column:
    """The stored percentage when it is usable, else the one the state implies."""
    whole = F.floor(raw + F.lit(0.5)).cast("long")
    return F.when(raw >= 0, F.least(whole, F.lit(100).cast("long"))).otherwise(status_progress(status))


def allowed_actions(status: Column) -> dict[str, Column]:
    return {
        "can_retry": status.isin(*RETRYABLE),
        "can_cancel": status.isin(*CANCELABLE),
        "can_force_fail": status.isin(*FORCE_FAILABLE),
        "can_delete": status.isin(*DELETABLE),
        "can_complete": status.isin(*COMPLETABLE),
    }


def retry_backoff_sec(
    task_type: Column, attempt: Column,
    initial: dict[str, int] = INITIAL_BACKOFF_SEC, longest: dict[str, int] = MAX_BACKOFF_SEC,
) -> Column:
    doubled = lookup(task_type, initial) * F.pow(
        F.lit(2.0), F.greatest(F.coalesce(attempt, F.lit(0)), F.lit(1)) - 1
    )
    return F.least(lookup(task_type, longest).cast("double"), doubled).cast("long")


def event_phase(event_type: Column) -> Column:
    """The first matching word decides; the order matters."""
    kind = F.upper(F.coalesce(event_type, F.lit("")))

    def has(*words: str) -> Column:
        found = kind.contains(words[0])
        for word in words[1:]:
            found = found | kind.contains(word)
        return found

    return (
        F.when(has("FAILED", "CANCELED"), "failure").when(has("EXPORT"), "export")
        .when(has("REVIEW"), "moderation").when(has("DOWNLOAD", "CREATED"), "ingest")
        .when(has("PROCESSING", "CLAIMED", "RETRIED"), "processing").otherwise("system")
    )


def event_categories(phase: Column) -> Column:
    extra = (
        F.when(phase.isin("ingest", "processing", "export"), F.array(F.lit("worker")))
        .when(phase == "moderation", F.array(F.lit("moderation")))
        .when(phase == "failure", F.array(F.lit("worker"), F.lit("errors")))
        .otherwise(F.filter(F.array(F.lit("")), lambda x: F.lit(False)))
    )
    return F.array_distinct(F.concat(F.array(F.lit("all"), F.lit("important")), extra))


def normalise_token(value: Column) -> Column:
    """Trimmed and lower-cased; blank becomes null."""
    return F.nullif(F.lower(F.trim(value)), F.lit(""))


def valid_role(value: Column) -> Column:
    return F.coalesce(normalise_token(value).isin(*ROLES), F.lit(False))


def role_of(task_type: Column) -> Column:
    return lookup(task_type, {"DOWNLOAD": "download", "ANALYZE": "processing", "EXPORT": "export"})


def pick(column: Column, choices: dict[str, str | Column]) -> Column:
    out = None
    for name, value in choices.items():
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(column == name, value) if out is None else out.when(column == name, value)
    return out


def one_of(column: Column, names: Sequence[str]) -> Column:
    return F.coalesce(column.isin(*names), F.lit(False))
