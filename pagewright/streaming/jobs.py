"""Jobs, leases, sessions and nonces as folds over events; the same reducers serve batch and stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grouped import Columns, by_group, rows_of

TERMINAL = ("succeeded", "failed", "cancelled")


# ---- jobs


def step(state: dict | None, event: dict) -> dict:
    """A job after an event: terminal states stay, cancel requests stick, running progress never falls."""
    progress = None if event.get("progress") is None or pd.isna(event["progress"]) else max(0, min(100, int(event["progress"])))
    status = event["status"]
    if state is None:
        return {"status": status, "progress": progress or 0, "cancel_requested": status == "cancel_requested", "updates": 1}
    if state["status"] in TERMINAL and status != state["status"]:
        return state
    new = dict(state, updates=state["updates"] + 1)
    if (state["cancel_requested"] or state["status"] == "cancel_requested") and status not in ("cancelled", "cancel_requested"):
        new |= {"cancel_requested": True, "status": "cancel_requested"}
    else:
        new |= {"status": status, "cancel_requested": state["cancel_requested"] or status == "cancel_requested"}
    if progress is not None:
        keep = state["status"] == "running" and new["status"] == "running"
        new["progress"] = max(state["progress"], progress) if keep else progress
    return new


JOB_STATE = "status string, progress int, cancel_requested boolean, updates int"


def fold_jobs(events: DataFrame) -> DataFrame:
    """(job_id, state columns) of (job_id, ts, event_no, status, progress)."""

    def fold(g: Columns) -> list[tuple]:
        state = None
        for e in rows_of(g):
            state = step(state, e)
        return [(g["job_id"][0], *(state[k] for k in ("status", "progress", "cancel_requested", "updates")))]

    return by_group(events.select("job_id", "ts", "event_no", "status", "progress"), ["job_id"], ["ts", "event_no"], fold, f"job_id string, {JOB_STATE}")


def stream_jobs(events: DataFrame) -> DataFrame:
    """The same fold over a stream; each trigger gives the changed jobs' new states."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        names = ("status", "progress", "cancel_requested", "updates")
        state = dict(zip(names, group.get, strict=True)) if group.exists else None
        for e in pd.concat(list(batches)).sort_values(["ts", "event_no"]).to_dict("records"):
            state = step(state, e)
        group.update(tuple(state[n] for n in names))
        yield pd.DataFrame([{"job_id": key[0], **state}])

    return events.groupBy("job_id").applyInPandasWithState(fold, f"job_id string, {JOB_STATE}", JOB_STATE, "update", GroupStateTimeout.NoTimeout)


def stuck(jobs: DataFrame, now: str, seconds: int = 1200) -> DataFrame:
    """Running jobs without an update for so long, as failed."""
    idle = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("updated_at").cast("timestamp"))
    return jobs.withColumn("status", F.when((F.col("status") == "running") & (idle > seconds), "failed").otherwise(F.col("status")))


def recent(jobs: DataFrame, limit: int) -> DataFrame:
    """The newest jobs; none for a limit of 0 or less."""
    return jobs.orderBy(F.desc("created_at"), "job_id").limit(max(0, limit))


def live_index(jobs: DataFrame, now: str, ttl: int = 86400) -> DataFrame:
    """Index entries younger than the TTL; one exactly as old goes."""
    return jobs.where(F.unix_timestamp(F.col("created_at").cast("timestamp")) > F.unix_timestamp(F.lit(now).cast("timestamp")) - ttl)


# ---- leases

GLOBAL_CAP, IDENTITY_CAP, LEASE_TTL = 4, 2, 600


def admit(active: dict[str, tuple[str, int]], event: dict) -> str:
    """Apply a lease event to the active leases (task -> identity, expiry) and name the outcome."""
    now, task, who = int(event["ts"]), event["task_id"], event["identity_id"]
    held = active.get(task)
    if event["action"] == "release":
        if held is None:
            return "NO_OP"
        if held[0] != who:
            return "MISMATCH"
        del active[task]
        return "RELEASED"
    if event["action"] == "renew":
        if held is None or held[1] < now:
            return "EXPIRED"
        if held[0] != who:
            return "MISMATCH"
        active[task] = (who, now + LEASE_TTL)
        return "RENEWED"
    if held is not None and held[1] >= now:
        active[task] = (held[0], now + LEASE_TTL)
        return "ALREADY_ACQUIRED"
    for t in [t for t, (_, e) in active.items() if e < now]:  # one that expires just now still counts
        del active[t]
    if len(active) >= GLOBAL_CAP:
        return "GLOBAL_CAPACITY_EXHAUSTED"
    if sum(w == who for w, _ in active.values()) >= IDENTITY_CAP:
        return "IDENTITY_CAPACITY_EXHAUSTED"
    active[task] = (who, now + LEASE_TTL)
    return "ACQUIRED"


def lease_outcomes(events: DataFrame, pool: str = "pool") -> DataFrame:
    """(event_no, outcome) of lease events; capacities are those of one pool, so a pool is one sequence by nature."""

    def fold(g: Columns) -> list[tuple]:
        active: dict[str, tuple[str, int]] = {}
        return [(e["event_no"], admit(active, e)) for e in rows_of(g)]

    return by_group(events, [pool], ["ts", "event_no"], fold, "event_no long, outcome string")


# ---- render sessions

SESSION_TTL, SESSION_CAP = 1800, 32


def visit(state: dict, event: dict) -> str:
    """Apply a session event to the sessions of one manager (``last`` access by content hash, ``pages`` rendered in each) and name the outcome.

    Idle sessions expire and take their pages along; at capacity the one of oldest access goes.
    """
    last, pages, now, key = state["last"], state["pages"], float(event["ts"]), event["sha256"]

    def drop(k: str) -> None:
        last.pop(k, None)
        pages.pop(k, None)

    for k in [k for k, t in last.items() if now - t > SESSION_TTL]:
        drop(k)
    action, known = event["action"], key in last
    if action == "delete":
        drop(key)
        return "deleted" if known else "missing"
    if not known and action != "create":
        return "missing"
    if not known and len(last) >= SESSION_CAP:
        drop(min(last, key=last.get))
    last[key] = now
    if action == "create":
        return "reused" if known else "created"
    if action == "get":
        return "found"
    page = f"{event['page']}:{event['dpi']:g}"  # a rendered page is kept for its resolution
    if page in pages.setdefault(key, []):
        return "cached"
    pages[key].append(page)
    return "rendered"


def session_outcomes(events: DataFrame, shard: str = "shard") -> DataFrame:
    """(event_no, outcome) of session events by content hash: created, reused, found, rendered, cached, missing or deleted.

    Each shard is one manager with its own capacity.  Events other than ``page`` need no page and dpi.
    """

    def fold(g: Columns) -> list[tuple]:
        state: dict = {"last": {}, "pages": {}}
        return [(e["event_no"], visit(state, e)) for e in rows_of(g)]

    return by_group(events, [shard], ["ts", "event_no"], fold, "event_no long, outcome string")


def stream_sessions(events: DataFrame, shard: str = "shard") -> DataFrame:
    """The same over a stream; a manager's sessions are kept as JSON between triggers."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(group.get[0]) if group.exists else {"last": {}, "pages": {}}
        rows = pd.concat(list(batches)).sort_values(["ts", "event_no"]).to_dict("records")
        out = pd.DataFrame({"event_no": [e["event_no"] for e in rows], "outcome": [visit(state, e) for e in rows]})
        group.update((json.dumps(state),))
        yield out

    return events.groupBy(shard).applyInPandasWithState(fold, "event_no long, outcome string", "state string", "append", GroupStateTimeout.NoTimeout)


# ---- nonces

SKEW = 300


def accepted_requests(events: DataFrame) -> DataFrame:
    """(event_no, accepted): within the allowed skew, and the first such use of its nonce."""
    fresh = F.abs(F.col("ts") - F.col("request_ts")) <= SKEW
    first = F.row_number().over(Window.partitionBy("nonce", fresh).orderBy("ts", "event_no")) == 1
    return events.select("event_no", (fresh & first).alias("accepted"))


def stream_accepted(events: DataFrame) -> DataFrame:
    """First uses of nonces in a stream of (at timestamp, nonce, request_at timestamp)."""
    fresh = events.where(F.abs(F.unix_timestamp("at") - F.unix_timestamp("request_at")) <= SKEW)
    return fresh.withWatermark("at", f"{SKEW} seconds").dropDuplicatesWithinWatermark(["nonce"])
