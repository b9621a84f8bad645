"""Keyed state on streams: debounced triggers and multi-stage dedup.

Both give for a stream what ``operators.states`` gives for a table, as long as a key's
rows arrive in order of their steps. State is one small row a key. With ``idle_ms`` it
leaves after that time without rows: for queries that go on, as Spark makes batches
without data for such timeouts, so that a query with an ``availableNow`` trigger would
not end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DEBOUNCED = "node long, step long, crossing boolean, run long, trigger boolean"
DEDUPED = "uri string, step long, stage string"


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def _dirty(a: int, b: int, bits: int, diff: int) -> bool:
    return ((a ^ b) & 0xFFF).bit_count() >= bits or max(abs((a >> s & 15) - (b >> s & 15)) for s in (0, 4, 8)) >= diff


def debounce(stream: DataFrame, bits: int = 3, diff: int = 4, need: int = 2, idle_ms: int | None = None) -> DataFrame:
    """(node, step, crossing, run, trigger) of a stream (node, step, sig); the first signature of a node is its baseline."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        base, run = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(batches)).sort_values("step")
        out = []
        for step, sig in zip(rows["step"], rows["sig"], strict=True):
            base = int(sig) if base < 0 else base
            hit = _dirty(int(sig), base, bits, diff)
            run = run + 1 if hit else 0
            out.append((key[0], int(step), hit, run, run >= need))
        state.update((base, run))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["node", "step", "crossing", "run", "trigger"])

    g = stream.select(F.col("node").cast("long"), F.col("step").cast("long"), F.col("sig").cast("long")).groupBy("node")
    return g.applyInPandasWithState(update, DEBOUNCED, "base long, run long", "append", _timeout(idle_ms))


def dedup(stream: DataFrame, eps: float, idle_ms: int | None = None) -> DataFrame:
    """(uri, step, stage) of a stream (uri, step, digest, rho, skip): policy, exact, similar or process, against the visit before."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        out = []
        for r in pd.concat(list(batches)).sort_values("step").itertuples():
            stage = "policy" if r.skip else "exact" if last and last[0] == r.digest else "similar" if last and abs(r.rho - last[1]) <= eps else "process"
            last = (r.digest, float(r.rho))
            out.append((key[0], int(r.step), stage))
        state.update(last)
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["uri", "step", "stage"])

    g = stream.select("uri", F.col("step").cast("long"), "digest", F.col("rho").cast("double"), "skip").groupBy("uri")
    return g.applyInPandasWithState(update, DEDUPED, "digest string, rho double", "append", _timeout(idle_ms))


def windowed_cost(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(user_id, start, cost) by tumbling windows of event time, closed by the watermark."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "user_id").agg(F.sum("value").alias("cost"))
    return g.select("user_id", F.col("w.start").alias("start"), "cost")


def tick_loop(stream: DataFrame, on_tick: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs a function on each micro-batch: the tick loop on a stream."""
    return stream.writeStream.foreachBatch(on_tick).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
