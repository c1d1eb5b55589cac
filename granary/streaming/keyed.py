"""Rows of a stream kept once per key with bounded state; duplicates, late ones too, patch what is there (ST1, ST4, ST5).

State is one small row a key, in the state store, and goes when its key has been silent for a stated time of the stream's own clock.
The outcome doesn't depend on the order of arrival: of a key the earliest row stays, with the patched fields of the latest row that has them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "first_at long, first_tie string, patch_at long, patch_tie string, timer long"


class _Changes(StatefulProcessor):
    """Of each key's new rows those that change what is there: an earlier row than any before, a later patch than any before."""

    def __init__(self, columns: Sequence[str], patched: Sequence[str], horizon_ms: int) -> None:
        self.columns, self.patched, self.horizon_ms = list(columns), list(patched), horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.seen.get() if self.seen.exists() else None
        first, patch, timer = ((held[0], held[1]), (held[2], held[3]), held[4]) if held else (None, (None, None), 0)
        best = late = None
        latest = 0
        for frame in rows:
            frame.columns = self.columns  # names that begin with _ don't arrive
            latest = max(latest, int(frame["_at"].max()))
            top = frame.iloc[_extreme(frame, least=True)]
            if first is None or (top["_at"], top["_tie"]) < first:
                first, best = (int(top["_at"]), top["_tie"]), top
            able = frame[frame[self.patched].notna().any(axis=1)]
            if len(able):
                top = able.iloc[_extreme(able, least=False)]
                if patch[0] is None or (top["_at"], top["_tie"]) > patch:
                    patch, late = (int(top["_at"]), top["_tie"]), top
        due = latest // 1000 + self.horizon_ms
        if due > timer:  # one timer a key, always the last
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.seen.update((*first, *patch, timer))
        for row, action in ((best, "row"), (late, "patch")):
            if row is not None:
                yield row.to_frame().T.assign(action=action)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def _extreme(frame: pd.DataFrame, least: bool) -> int:
    """The position of the row that comes first, or last, by time and tie."""
    at = frame["_at"].min() if least else frame["_at"].max()
    ties = frame["_tie"].where(frame["_at"] == at).dropna()
    return frame.index.get_loc(ties[ties == (ties.min() if least else ties.max())].index[0])


def _thinned(key: str, patched: Sequence[str]):
    """Of each Arrow batch the rows that can change anything: two a key at most, so that a frequent key sends little.

    Both carry the batch's latest time of their key as _clock, so that none is behind the watermark where a row that it stands for is not.
    """

    def thin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = frame.sort_values(["_at", "_tie"], kind="stable")
            rows["_clock"] = rows.groupby(key)["_clock"].transform("max")
            able = rows[rows[list(patched)].notna().any(axis=1)]
            keep = rows.drop_duplicates(key).index.union(able.drop_duplicates(key, keep="last").index)
            yield rows.loc[keep]

    return thin


def changes(stream: DataFrame, key: str, ts: str, tie: str, patched: Sequence[str], late: str, horizon_seconds: int) -> DataFrame:
    """The stream's columns and action ("row" or "patch"): the rows that change what is kept of their key.

    late: the watermark; a row behind it is left out, as Spark does, unless newer rows of its key come along. A key that is silent for horizon_seconds beyond the watermark is
    forgotten; if it comes again, its row is emitted again, and `current` still keeps the earliest. Rows without key, time or tie are
    left out. A tie is a text that tells rows of one time apart.
    """
    rows = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(tie).isNotNull())
    rows = rows.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_tie", F.col(tie).cast("string")).withColumn("_clock", F.col(ts).cast("timestamp"))
    thin = rows.mapInPandas(_thinned(key, patched), rows.schema).withWatermark("_clock", late)
    out = T.StructType([*rows.schema.fields, T.StructField("action", T.StringType())])
    found = thin.groupBy(key).transformWithStateInPandas(_Changes(rows.columns, patched, horizon_seconds * 1000), outputStructType=out, outputMode="Append", timeMode="EventTime")
    return found.drop("_at", "_tie", "_clock")


def keep(found: DataFrame, target: str, checkpoint: str) -> None:
    """All changes there are, written to target by run (that is, checkpoint) and batch; a batch that runs again overwrites its own folder.

    State needs the RocksDB store, which is set for this query alone; nothing of the target is read.
    """
    spark, run = found.sparkSession, hashlib.md5(checkpoint.encode(), usedforsecurity=False).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/run={run}/batch={number}")

    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        query = found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, before)
    query.awaitTermination()


def current(rows: DataFrame, key: str, ts: str, tie: str, patched: Sequence[str]) -> DataFrame:
    """What is kept of each key: its earliest row, with the patched fields of the latest row that has any of them.

    rows: changes as written, or all rows of a table; both give the same.
    """
    order = F.struct(F.col(ts), F.col(tie).cast("string"))
    able = F.coalesce(*(F.col(c).cast("string") for c in patched)).isNotNull()
    fixed = [c for c in rows.columns if c not in (key, *patched, "action", "run", "batch")]
    best = F.min_by(F.struct(*fixed), order).alias("_row")
    late = F.max_by(F.struct(*patched), F.when(able, order)).alias("_patch")
    kept = rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(tie).isNotNull()).groupBy(key).agg(best, late)
    return kept.select(key, "_row.*", "_patch.*")
