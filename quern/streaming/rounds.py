"""Control flow of the filtering loop over a small state: installments, floors, stops, reuse."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Stop(str, Enum):
    ROUND_CAP = "round_cap"
    SUBSETS_CLEAN = "subsets_clean"
    POOL_EXHAUSTED = "pool_exhausted"
    CRITERIA_EXHAUSTED = "criteria_exhausted"


class IncompleteBlock(RuntimeError):
    """A block of criteria of which some were not applied."""


@dataclass
class State:
    pool_rows: int
    round: int = 0
    swept_through: int = 0
    applied: list[str] = field(default_factory=list)
    installments: list[dict] = field(default_factory=list)
    measured: dict[str, float] = field(default_factory=dict)  # pool fingerprint -> rate
    deferred: list[tuple[str, str]] = field(default_factory=list)
    below_floor: bool = False
    stop: Stop | None = None


def fingerprint(pool: DataFrame, row: str = "row_id") -> str:
    """The same for equal sets of rows in any order and partitioning."""
    r = pool.select(F.xxhash64(F.col(row).cast("string")).alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    return f"{r['n']}-{r['x']}-{r['s']}"


def measure(state: State, pool: DataFrame, run: Callable[[DataFrame], float | None], kind: str = "rate") -> float | None:
    """A pool's measurement, taken once; what cannot be taken now is put on the queue, once."""
    key = fingerprint(pool)
    if key in state.measured:
        return state.measured[key]
    value = run(pool)
    if value is None:
        if (kind, key) not in state.deferred:
            state.deferred.append((kind, key))
    else:
        state.measured[key] = value
    return value


def installment(state: State, round_no: int, block: list[str], sweep: Callable[[list[str]], DataFrame], floor: int) -> list[dict]:
    """Apply one round's whole block; ``sweep`` returns its report (crit_id, pool_after, applied)."""
    report = [r.asDict() for r in sweep(block).orderBy("ord").collect()]
    done = [r["crit_id"] for r in report if r["applied"]]
    if set(done) != set(block) and not any(r["pool_after"] < floor for r in report if r["applied"]):
        raise IncompleteBlock(f"round {round_no}: {sorted(set(block) - set(done))}")
    state.applied += done
    state.swept_through = round_no
    if report:
        state.pool_rows = next((r["pool_after"] for r in reversed(report) if r["applied"]), state.pool_rows)
    state.below_floor = state.pool_rows < floor
    state.installments.append({"round": round_no, "criteria": done, "pool_after": state.pool_rows})
    return report


def next_stop(state: State, *, cap: int, floor: int, converged: bool, pending: int) -> Stop | None:
    """Why to stop before another round, or None."""
    if converged:
        return Stop.SUBSETS_CLEAN
    if state.pool_rows < floor:
        return Stop.POOL_EXHAUSTED
    if state.round >= cap:
        return Stop.ROUND_CAP
    if state.round and not pending and state.swept_through >= state.round:
        return Stop.CRITERIA_EXHAUSTED
    return None


def run_loop(state: State, step: Callable[[State], tuple[bool, int]], *, cap: int, floor: int) -> State:
    """Rounds until a reason to stop; ``step`` runs one and returns (converged, criteria pending).

    A state that stopped at the cap goes on if the cap was raised; other stops are final.
    """
    if state.stop is Stop.ROUND_CAP and state.round < cap:
        state.stop = None
    while state.stop is None:
        state.round += 1
        converged, pending = step(state)
        state.stop = next_stop(state, cap=cap, floor=floor, converged=converged, pending=pending)
    return state
