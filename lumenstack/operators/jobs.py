"""Durable jobs: queue order, partial updates, pause, cancel, stalled jobs."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .generic import update_where

ACTIVE = ("queued", "running", "paused")
STALLED_MINUTES = 10
RESUMABLE = ("people_index",)


def create(jobs: DataFrame, row: DataFrame) -> DataFrame:
    """Appends a job; status, progress and priority have defaults."""
    defaults = {"status": "queued", "progress": 0.0, "priority": 50}
    return jobs.unionByName(row.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in row.columns}), allowMissingColumns=True)


def update(jobs: DataFrame, job_id: str, clear: tuple[str, ...] = (), increment_attempt: bool = False, **values: Any) -> DataFrame:
    """Sets what is given (None: as it is); ``clear`` names columns to null."""
    own = F.col("job_id") == job_id
    new = {c: F.lit(v) for c, v in values.items() if v is not None} | {c: F.lit(None) for c in clear}
    if increment_attempt:
        new["attempt_count"] = F.coalesce("attempt_count", F.lit(0)) + 1
    return update_where(jobs, own, **new) if new else jobs


def fail(jobs: DataFrame, job_id: str, error: str) -> DataFrame:
    return update_where(jobs, (F.col("job_id") == job_id) & F.col("status").isin(*ACTIVE), status=F.lit("failed"), error_text=F.lit(error))


def request_cancel(jobs: DataFrame, job_id: str) -> DataFrame:
    return update_where(jobs, (F.col("job_id") == job_id) & F.col("status").isin(*ACTIVE), cancel_requested=F.lit(True))


def request_pause(jobs: DataFrame, job_id: str) -> DataFrame:
    """A queued job is paused at once; a running one is asked to."""
    own = F.col("job_id") == job_id
    asked = update_where(jobs, own & (F.col("status") == "running"), pause_requested=F.lit(True))
    return update_where(asked, own & (F.col("status") == "queued"), status=F.lit("paused"))


def request_resume(jobs: DataFrame, job_id: str) -> DataFrame:
    return update_where(jobs, (F.col("job_id") == job_id) & (F.col("status") == "paused"), status=F.lit("queued"), pause_requested=F.lit(False))


def flag(jobs: DataFrame, job_id: str, which: str) -> bool:
    return not jobs.filter((F.col("job_id") == job_id) & F.col(which)).isEmpty()


def get(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.filter(F.col("job_id") == job_id)


def reap(jobs: DataFrame, as_of: dt.datetime, minutes: int = STALLED_MINUTES, resumable: tuple[str, ...] = RESUMABLE) -> DataFrame:
    """Running jobs without a sign for ``minutes``: resumable kinds are queued
    again, others fail."""
    stalled = (F.col("status") == "running") & (F.col("updated_at") < F.lit(as_of) - F.expr(f"INTERVAL {int(minutes)} MINUTES"))
    again = F.col("job_type").isin(*resumable)
    return update_where(jobs, stalled, status=F.when(again, "queued").otherwise("failed"), error_text=F.when(again, F.col("error_text")).otherwise("stalled"))


def active(jobs: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Active jobs once stalled ones are reaped, in the order they are to run."""
    return queue_order(reap(jobs, as_of).filter(F.col("status").isin(*ACTIVE)))


def queue_order(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.col("priority").desc_nulls_last(), F.col("created_at").asc_nulls_first(), "job_id")


def latest(jobs: DataFrame, job_type: str | None = None, limit: int = 1) -> DataFrame:
    rows = jobs.filter(F.col("job_type") == job_type) if job_type else jobs
    return rows.orderBy(F.col("created_at").desc_nulls_last(), F.desc("job_id")).limit(limit)
