"""Structured Streaming forms: idle sessions, late upgrades, cache de-duplication, heartbeat states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.operators import state

FAILURES_TO_DISCONNECT = 3


def idle_sessions(activity: DataFrame, key: str, ts: str, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Finished sessions of an activity stream; the watermark bounds state."""
    return state.sessions(activity.withWatermark(ts, late), key, ts, gap)


def first_requests(requests: DataFrame, keys: list[str], ts: str, keep: str = "1 hour") -> DataFrame:
    """Requests not seen within keep: what a clip cache would have to make."""
    return requests.withWatermark(ts, keep).dropDuplicatesWithinWatermark(keys)


def late_upgrades(positions: DataFrame, upgrades: DataFrame, keep: str = "2 minutes") -> DataFrame:
    """Upgrades that arrive before their bubble is read: position is the watermark, time only bounds state.

    positions: page_id, current_idx, at. upgrades: page_id, idx, text, arrived.
    """
    p, u = positions.withWatermark("at", keep).alias("p"), upgrades.withWatermark("arrived", keep).alias("u")
    on = (F.col("p.page_id") == F.col("u.page_id")) & (F.col("u.idx") > F.col("p.current_idx"))
    on = on & (F.col("u.arrived") >= F.col("p.at") - F.expr(f"interval {keep}")) & (F.col("u.arrived") <= F.col("p.at"))
    return p.join(u, on).select("u.page_id", "u.idx", "u.text", "u.arrived", "p.current_idx")


def heartbeat_states(beats: DataFrame, key: str) -> DataFrame:
    """Connection state after each beat (ts, ok): three failures in a row disconnect, the next success reconnects."""

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], st) -> Iterator[pd.DataFrame]:
        fails, now = st.get if st.exists else (0, "CONNECTING")
        for pdf in pdfs:
            rows = []
            for r in pdf.sort_values("ts").itertuples():
                fails = 0 if r.ok else fails + 1
                if r.ok:
                    now = "CONNECTED"
                elif fails >= FAILURES_TO_DISCONNECT:
                    now = "DISCONNECTED"
                else:
                    now = "RECONNECTING" if now != "DISCONNECTED" else now
                rows.append((k[0], r.ts, now))
            yield pd.DataFrame(rows, columns=["key", "ts", "state"])
        st.update((fails, now))

    return beats.select(F.col(key).cast("string").alias("key"), "ts", "ok").groupBy("key").applyInPandasWithState(
        step, "key string, ts timestamp, state string", "fails int, now string", "append", "NoTimeout"
    )


def heartbeat_states_batch(beats: DataFrame, key: str) -> DataFrame:
    """The same states over a finished table, by windows."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("ts")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    island = beats.withColumn("_i", F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(run))
    inside = Window.partitionBy(key, "_i").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    fails = F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(inside)
    out = island.withColumn("_f", fails)
    label = F.when(F.col("ok"), "CONNECTED").when(F.col("_f") >= FAILURES_TO_DISCONNECT, "DISCONNECTED").otherwise("RECONNECTING")
    return out.select(key, "ts", label.alias("state"))


def upgrades_batch(sink_path: str):
    """foreachBatch writer that appends each micro-batch once, in a folder named by its id."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{sink_path}/batch={batch_id}")

    return write
