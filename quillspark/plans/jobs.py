"""A query as a job: its run, its bounded answer as context, and the evidence it leaves."""

from __future__ import annotations

import hashlib
import time
import uuid
from dataclasses import dataclass, field

from .engine import Engine, Result
from .errors import QueryError
from .parser import shape
from .render import context


@dataclass
class Job:
    """A run of a query: how far it is, what came of it, and its steps as (progress, message)."""

    id: str
    status: str = "running"
    steps: list[tuple[int, str]] = field(default_factory=list)
    output: Result | None = None
    error: dict | None = None
    seconds: float = 0.0


def run_job(engine: Engine, sql: str, limit: int | None = None) -> Job:
    """Runs a query of the dialect; a refused one is a failed job, not an exception."""
    job, began = Job(f"job_{uuid.uuid4().hex}"), time.monotonic()
    job.steps.append((30, "Running query"))
    try:
        job.output = engine.run(sql, limit)
    except QueryError as e:
        job.status, job.error = "failed", {"code": e.code, "message": str(e)}
    else:
        job.status = "completed"
        job.steps.append((90, "Query ready"))
    job.seconds = time.monotonic() - began
    return job


def prepared(engine: Engine, sql: str, max_rows: int = 50, limit: int | None = None) -> dict:
    """A query's answer as context for a model, and its evidence: hashes, counts and the query's shape, never its text."""
    job = run_job(engine, sql, limit)
    if job.error:
        raise QueryError(job.error["code"], job.error["message"])
    body, n = context(sql, job.output, max_rows), len(job.output.rows)
    evidence = {
        "id": f"ev_{uuid.uuid4().hex}",
        "kind": "ai_query_context_selected",
        "source_ref": "query_context",
        "content_hash": "sha256:" + hashlib.sha256(body.encode()).hexdigest(),
        "signals": ["truncated_rows"] if n > max_rows else [],
        "decision": "local_query_context_selected",
        "query_shape": {k: str(v) for k, v in shape(sql).items()},
    }
    return {"job": job, "context": body, "tokens": -(-len(body) // 4), "rows": n, "included": min(n, max_rows), "truncated": n > max_rows, "evidence": evidence}
