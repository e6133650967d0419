"""Keeping a store fresh: file events, bursts, scans that see one state, and waiting until what is published covers a change.

Events make what is published stale at once (its revision is revoked), and only then count as a new generation. A scan
covers the generations that began before it; a waiter is released by the first publication whose scan covers its own.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.store import RevisionConflict, Store
from graphloom.streaming.policy import Policy

#: Milliseconds of quiet that end a burst and that it may last; attempts of a scan and of a publication; seconds of a wait. Fixed values.
QUIET_MS, LONGEST_MS, ATTEMPTS, WAIT_SECONDS = 50, 250, 3, 30.0


class Unstable(RuntimeError):
    """Files kept changing while they were read."""


def relevant(events: DataFrame) -> DataFrame:
    """Events (path, kind) that may change sources: no accesses but a close after writing, nothing of Git's own folder."""
    own = F.regexp_like("path", F.lit(r"(^|/)\.git(/|$)"))
    return events.filter((~F.col("kind").startswith("access") | (F.col("kind") == "access_close_write")) & ~own)


def bursts(events: DataFrame, by: list[str], quiet_ms: int = QUIET_MS, longest_ms: int = LONGEST_MS) -> DataFrame:
    """Adds burst (from 0 for each of `by`): events (at, in milliseconds) no further apart than quiet_ms, cut where they last longest_ms."""
    w = Window.partitionBy(*by).orderBy("at")
    before = F.lag("at").over(w)
    e = events.withColumn("_new", F.when(before.isNull() | (F.col("at") - before > quiet_ms), 1).otherwise(0))
    e = e.withColumn("_run", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    e = e.withColumn("_piece", F.floor((F.col("at") - F.min("at").over(Window.partitionBy(*by, "_run"))) / longest_ms))
    return e.withColumn("burst", F.dense_rank().over(Window.partitionBy(*by).orderBy("_run", "_piece")) - 1).drop("_new", "_run", "_piece")


def stable_scan(inventory: Callable[[], DataFrame], read: Callable[[DataFrame], DataFrame], attempts: int = ATTEMPTS) -> DataFrame:
    """What read gives for an inventory (path and whatever tells versions of a file apart) that is the same after reading.

    read must store what it reads, as a lazy table would be read only later.
    """
    before = inventory()
    rows = sorted(map(tuple, before.collect()))  # names of files, on the driver as they come from it
    for _ in range(attempts):
        out = read(before)
        again = inventory()
        now = sorted(map(tuple, again.collect()))
        if now == rows:
            return out
        before, rows = again, now
    raise Unstable(f"files changed during each of {attempts} scans")


@dataclass
class Live:
    """scan(kind, paths) gives the tables of a revision: kind is full, or targeted with the changed paths."""

    store: Store
    scan: Callable[[str, set[str]], dict[str, DataFrame]]
    policy: Policy = field(default_factory=Policy)
    generation: int = 0
    covered: int = 0
    pending: set[str] = field(default_factory=set)
    uncertain: bool = False
    epochs: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._changed = threading.Condition()

    def notice(self, paths: set[str], source: str = "", epoch: int | None = None, lost: bool = False) -> int:
        """Takes in events; returns the generation they begin. An epoch that doesn't follow the last one of its source, or
        lost events, make the next scan a full one."""
        with self._changed:
            gap = epoch is not None and source in self.epochs and epoch != self.epochs[source] + 1
            if self.store.current():
                self.store.revoke(self.store.current())
            self.uncertain |= gap or lost
            if epoch is not None:
                self.epochs[source] = epoch
            self.pending |= paths
            self.generation += 1
            return self.generation

    def reconcile(self) -> str:
        """Scans and publishes what the policy asks for: full, targeted or noop."""
        with self._changed:
            covers, paths, uncertain = self.generation, self.pending, self.uncertain
            self.pending, self.uncertain = set(), False
        kind, policy = self.policy.decide(len(paths), uncertain=uncertain)
        try:
            if kind != "noop":
                for attempt in range(ATTEMPTS):
                    try:
                        base = self.store.current()
                        new = self.store.publish(self.scan(kind, paths), base)
                        break
                    except RevisionConflict:
                        if attempt == ATTEMPTS - 1:
                            raise
                if self.generation > covers:
                    self.store.revoke(new)
        except BaseException:
            with self._changed:
                self.pending |= paths
                self.uncertain = True
            raise
        with self._changed:
            self.policy, self.covered = policy, max(self.covered, covers)
            self._changed.notify_all()
        return kind

    def wait(self, seconds: float = WAIT_SECONDS, generation: int | None = None) -> bool:
        """Whether a publication has covered the generation (by default, all events so far) before time is up."""
        with self._changed:
            want = self.generation if generation is None else generation
            return self._changed.wait_for(lambda: self.covered >= want, seconds)

    def follow(self, stream: DataFrame, source: str = "stream"):
        """Starts a query over a stream of events (path, kind): each micro-batch is noticed and reconciled. Batch numbers are
        the source's epochs, so a batch that is missing makes the next scan a full one."""

        def batch(df: DataFrame, number: int) -> None:
            if self.epochs.get(source) == number:
                return
            paths = {r[0] for r in relevant(df).select("path").distinct().collect()}  # the changed paths of one batch
            if paths:
                self.notice(paths, source, number)
                self.reconcile()
            else:
                self.epochs[source] = number

        return stream.writeStream.foreachBatch(batch)
