"""Small tables beside the index: jobs, checkpoints, errors, searches. Each change is an appended JSON line; what a
key has last holds. They belong to the driver and are read back as DataFrames."""

from __future__ import annotations

import json
import os
import threading
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.schema import JOB_STATES

#: Counters that a job starts with.
COUNTERS = (
    "records_read", "inserted", "duplicates", "malformed_records", "pages", "links", "files", "errors", "retry_count", "bytes_downloaded",
)
_SCHEMAS = {
    "jobs": "id long, job_type string, status string, params string, stats string, created_at string, updated_at string",
    "checkpoints": "job_id long, ckey string, state string, updated_at string",
    "errors": "id long, job_id long, context string, message string, detail string, created_at string",
    "history": "id long, target string, mode string, result_count long, created_at string",
}


def now() -> str:
    return datetime.now(UTC).replace(microsecond=0).isoformat()


class Jobs:
    def __init__(self, folder: str) -> None:
        self.folder, self.lock = folder, threading.RLock()
        os.makedirs(folder, exist_ok=True)

    def _append(self, table: str, row: dict) -> dict:
        with self.lock, open(f"{self.folder}/{table}.jsonl", "a", encoding="utf-8") as f:
            f.write(json.dumps(row) + "\n")
        return row

    def _rows(self, table: str) -> list[dict]:
        try:
            with self.lock, open(f"{self.folder}/{table}.jsonl", encoding="utf-8") as f:
                rows = [json.loads(x) for x in f]
        except FileNotFoundError:
            return []
        clears = [k for k, r in enumerate(rows) if r.get("cleared")]
        return rows[clears[-1] + 1 :] if clears else rows

    def frame(self, spark: SparkSession, table: str) -> DataFrame:
        """A table as it stands, one row for each job or key."""
        rows = spark.createDataFrame(self._latest(table), _SCHEMAS[table]) if self._latest(table) else spark.createDataFrame([], _SCHEMAS[table])
        return rows

    def _latest(self, table: str) -> list[dict]:
        key = {"jobs": ("id",), "checkpoints": ("job_id", "ckey")}.get(table, ("id",))
        last = {tuple(r[k] for k in key): r for r in self._rows(table)}
        names = [x.split()[0] for x in _SCHEMAS[table].split(", ")]
        text = lambda v: json.dumps(v) if isinstance(v, dict) else v
        return [{n: text(r.get(n)) for n in names} for r in last.values()]

    def create(self, job_type: str, params: dict) -> int:
        with self.lock:
            number = max((r["id"] for r in self._rows("jobs")), default=0) + 1
            self._append("jobs", {"id": number, "job_type": job_type, "status": "pending", "params": params, "stats": dict.fromkeys(COUNTERS, 0), "created_at": now(), "updated_at": now()})
        return number

    def get(self, job_id: int) -> dict | None:
        return next((r for r in reversed(self._rows("jobs")) if r["id"] == job_id), None)

    def update(self, job_id: int, **fields) -> None:
        if fields.get("status", "pending") not in JOB_STATES:
            raise ValueError(fields["status"])
        with self.lock:
            self._append("jobs", {**(self.get(job_id) or {}), **fields, "updated_at": now()})

    def bump(self, job_id: int, **by: int) -> None:
        with self.lock:
            stats = dict((self.get(job_id) or {}).get("stats", {}))
            for k, v in by.items():
                stats[k] = stats.get(k, 0) + v
            self.update(job_id, stats=stats)

    def control(self, job_id: int, pause: bool | None = None, cancel: bool | None = None) -> None:
        flags = {k: v for k, v in (("pause", pause), ("cancel", cancel)) if v is not None}
        self.update(job_id, **flags)

    def wants_stop(self, job_id: int) -> str | None:
        """The state that a job was told to take: stopped, paused or none."""
        job = self.get(job_id) or {}
        return "stopped" if job.get("cancel") else "paused" if job.get("pause") else None

    def list(self, active_only: bool = False, limit: int | None = 50) -> list[dict]:
        rows = sorted({r["id"]: r for r in self._rows("jobs")}.values(), key=lambda r: -r["id"])
        return [r for r in rows if not active_only or r["status"] in JOB_STATES[:4]][:limit]

    def checkpoint(self, job_id: int, key: str, state: dict) -> None:
        self._append("checkpoints", {"job_id": job_id, "ckey": key, "state": state, "updated_at": now()})

    def load_checkpoint(self, job_id: int, key: str) -> dict | None:
        return next((r["state"] for r in reversed(self._rows("checkpoints")) if (r["job_id"], r["ckey"]) == (job_id, key)), None)

    def record_error(self, context: str, message: str, job_id: int | None = None, detail: str = "") -> None:
        with self.lock:
            number = len(self._rows("errors")) + 1
            self._append("errors", {"id": number, "job_id": job_id, "context": context, "message": message, "detail": detail, "created_at": now()})

    def errors(self, limit: int | None = 200) -> list[dict]:
        return self._rows("errors")[::-1][:limit]

    def clear_errors(self) -> None:
        self._append("errors", {"cleared": True})

    def add_history(self, target: str, mode: str, result_count: int) -> None:
        with self.lock:
            number = len(self._rows("history")) + 1
            self._append("history", {"id": number, "target": target, "mode": mode, "result_count": result_count, "created_at": now()})

    def history(self, limit: int = 100) -> list[dict]:
        return self._rows("history")[::-1][:limit]


def errors_by_context(errors: DataFrame) -> DataFrame:
    return errors.groupBy("context").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "context")
