"""High availability: one elected replica for each cluster."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .folds import ordered_fold

FAIL_OVER_S, FORGET_S = 30, 600


@dataclass(frozen=True)
class Elected:
    replica: str | None = None
    at: int = 0


def decide(state: Elected, replica: str | None, now: int, fail_over: int = FAIL_OVER_S, forget: int = FORGET_S) -> tuple[Elected, bool]:
    """The new state, and whether the batch is dropped.

    A batch without replica always passes. The first replica of a cluster is elected. Another one is
    dropped; if the elected one was silent for fail_over seconds, it is elected too, but its batch is
    still dropped. At every multiple of `forget` seconds, a cluster silent for that long is forgotten.
    """
    if not replica:
        return state, False
    if state.replica is not None and now // forget * forget - state.at >= forget:
        state = Elected()
    if state.replica in (None, replica):
        return Elected(replica, now), False
    if now - state.at >= fail_over:
        return Elected(replica, now), True
    return state, True


def deduplicate(batches: DataFrame) -> DataFrame:
    """batches(batch_id, cluster, replica, now_s) with `dropped`, in order of time and id within a cluster."""
    rows = batches.select("batch_id", "cluster", "replica", "now_s")

    def step(state: Elected, v: tuple) -> tuple[Elected, tuple[bool]]:
        state, dropped = decide(state, v[0], int(v[1]))
        return state, (dropped,)

    return ordered_fold(rows, "cluster", ["now_s", "batch_id"], Elected, step, ["replica", "now_s"], ["dropped"], "batch_id long, cluster string, replica string, now_s long, dropped boolean")
