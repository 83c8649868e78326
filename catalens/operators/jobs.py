"""Long-running jobs of the driver: started, counted, paused, cancelled and kept as rows of the jobs table."""

from __future__ import annotations

import datetime as dt
import json
import threading
import uuid
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from catalens import schemas as S


class Stopped(Exception):
    """Raised inside a job that was asked to stop."""


@dataclass
class Job:
    kind: str
    params: dict
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    status: str = "running"
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("found", "processed", "failed", "skipped", "removed", "updated"), 0))
    errors: deque = field(default_factory=lambda: deque(maxlen=S.ERROR_ROWS))
    error: str | None = None
    started_at: dt.datetime = field(default_factory=lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
    finished_at: dt.datetime | None = None
    asked: str | None = None

    def check(self) -> None:
        """To be called between steps: ends the job if it was paused or cancelled."""
        if self.asked:
            raise Stopped(self.asked)

    def add(self, **counts: int) -> None:
        for name, n in counts.items():
            self.counts[name] += n

    def fail(self, path: str, error: str) -> None:
        self.counts["failed"] += 1
        self.errors.append({"path": path, "error": error})

    def row(self) -> tuple:
        have = {"id": self.id, "kind": self.kind, "params": json.dumps(self.params, sort_keys=True), "status": self.status, "started_at": self.started_at, "finished_at": self.finished_at, "error": self.error, "recent_errors": json.dumps(list(self.errors))} | self.counts
        return tuple(have[f.name] for f in S.SCHEMAS["jobs"].fields)


class Registry:
    """Jobs of this process. Each runs in a thread under its own Spark job group, which cancelling stops."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jobs, self.lock = spark, {}, threading.Lock()
        self.threads: dict[str, threading.Thread] = {}

    def start(self, kind: str, params: dict, work: Callable[[Job], None]) -> Job:
        job = Job(kind, params)

        def run() -> None:
            self.spark.sparkContext.setJobGroup(job.id, kind, interruptOnCancel=True)
            try:
                work(job)
                job.status = "completed"
            except Stopped as e:
                job.status = str(e)
            except Exception as e:  # noqa: BLE001 - whatever ends a job is its result
                job.status, job.error = (job.asked, None) if job.asked else ("failed", str(e)[:500])
            job.finished_at = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)

        with self.lock:
            self.jobs[job.id] = job
            self.threads[job.id] = threading.Thread(target=run, daemon=True)
            self.threads[job.id].start()
        return job

    def _stop(self, job_id: str, status: str) -> bool:
        job = self.jobs.get(job_id)
        if job is None or job.status != "running":
            return False
        job.asked = status
        self.spark.sparkContext.cancelJobGroup(job_id)
        return True

    def cancel(self, job_id: str) -> bool:
        return self._stop(job_id, "cancelled")

    def pause(self, job_id: str) -> bool:
        return self._stop(job_id, "paused")

    def resume(self, job_id: str, work: Callable[[Job], None]) -> Job:
        """A new job with the stored parameters; refused while an equal one runs."""
        old = self.jobs[job_id]
        if old.status not in ("paused", "cancelled", "interrupted"):
            raise ValueError(f"a {old.status} job cannot be resumed")
        if any(j.status == "running" and (j.kind, j.params) == (old.kind, old.params) for j in self.jobs.values()):
            raise ValueError("an equal job is running")
        return self.start(old.kind, old.params, work)

    def wait(self, job_id: str, seconds: float | None = None) -> Job:
        self.threads[job_id].join(seconds)
        return self.jobs[job_id]

    def table(self) -> DataFrame:
        """The live jobs as rows, to lay over the stored ones."""
        return self.spark.createDataFrame([j.row() for j in self.jobs.values()], S.SCHEMAS["jobs"])
