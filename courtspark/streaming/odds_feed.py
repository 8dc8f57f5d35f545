"""The polled odds folder as a file stream.

Lines of new files are checked and flattened by the batch operators as they are: prices are appended once
each, rejected documents go to a table of their own, and :class:`LineTracker` keeps what is known of every
line that is still being polled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from courtspark.functions.scalars import col
from courtspark.operators.markets import EXPIRY_HOURS, TRACK, explode_props, long_props
from courtspark.sources.odds import check_documents, good_documents, rejected_documents

#: Keyed state needs this store.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def snapshot_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Checked documents of a folder (see ``check_documents``) with their file, new files only."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return check_documents(lines.select("value", F.col("_metadata.file_name").alias("file")))


def _append(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write all there is so far to a parquet table, each row once, then stop."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def append_prices(snapshots: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The prices of all good snapshots seen so far."""
    return _append(long_props(explode_props(good_documents(snapshots))), path, checkpoint)


def append_rejected(snapshots: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The rejected documents seen so far, with their file and the reason."""
    return _append(rejected_documents(snapshots), path, checkpoint)


def polled_prices(snapshots: DataFrame) -> DataFrame:
    """Long prices of good snapshots with the time of their poll (``polled``)."""
    known = good_documents(snapshots).withColumn("polled", F.try_to_timestamp(col("last_update")))
    return long_props(explode_props(known.where(col("polled").isNotNull()), keep=["polled"]), keep=["polled"])


_STATE = "track long, polls long, first_at long, last_at long, first_price double, last_price double, low double, high double, seen array<long>"
_OUT = "track long, polls long, first_poll timestamp, last_poll timestamp, first_price double, last_price double, low double, high double"


class LineTracker(StatefulProcessor):
    """Keeps the current track of one line, as ``operators.markets.line_tracks`` defines it.

    Poll times of the last ``expiry_hours`` are remembered, so a poll that comes again, or out of order, counts
    once; older ones are held back by the watermark. A timer clears a line that is polled no more. ``track`` is the time,
    in microseconds, of the poll that began it, so it stays unique after the state was cleared."""

    def __init__(self, keys: Sequence[str] = TRACK, expiry_hours: float = EXPIRY_HOURS):
        self.keys, self.expiry = list(keys), int(expiry_hours * 3_600_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("track", _STATE)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        polls = pd.concat(list(rows))
        polls = polls.assign(at=polls["polled"].astype("datetime64[us]").astype("int64")).groupby("at")["price"].max()
        now = list(self.state.get()) if self.state.exists() else None
        tracks = {}
        for at, price in sorted(polls.items()):
            at, price = int(at), float(price)
            if now is None or at - now[3] > self.expiry:
                now = [at, 1, at, at, price, price, price, price, [at]]
            elif at not in now[8]:
                now[1] += 1
                if at < now[2]:
                    now[2], now[4] = at, price
                if at > now[3]:
                    now[3], now[5] = at, price
                now[6], now[7] = min(now[6], price), max(now[7], price)
                now[8] = [t for t in now[8] if t > now[3] - self.expiry] + [at]
            tracks[now[0]] = list(now)
        self.state.update(tuple(now))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now[3] // 1000 + self.expiry // 1000 + 1)
        out = pd.DataFrame([t[:8] for t in tracks.values()], columns=["track", "polls", "first_poll", "last_poll", "first_price", "last_price", "low", "high"])
        for c in ("first_poll", "last_poll"):
            out[c] = pd.to_datetime(out[c], unit="us")
        for name, value in zip(self.keys, key, strict=True):
            out.insert(0, name, [value] * len(out))
        yield out[[*self.keys, *[c.split()[0] for c in _OUT.split(", ")]]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def track_lines(prices: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = TRACK, expiry_hours: float = EXPIRY_HOURS) -> StreamingQuery:
    """Tracks of all polls so far; every batch writes the tracks that it changed, in a folder named by the
    batch, so a batch that is run again after a failure writes the same folder. ``current_tracks`` reads them."""
    prices.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kinds = dict(prices.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), _OUT])
    tracked = (
        prices.withWatermark("polled", f"{expiry_hours:g} hours")
        .groupBy(*[col(k) for k in keys])
        .transformWithStateInPandas(LineTracker(keys, expiry_hours), schema, "Update", "EventTime")
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return tracked.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_tracks(spark: SparkSession, path: str, keys: Sequence[str] = TRACK) -> DataFrame:
    """The last written row of every track."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "track", "first_poll", "batch")]
    newest = F.max_by(F.struct("first_poll", *rest), "batch").alias("t")
    return rows.groupBy(*[col(k) for k in keys], "track").agg(newest).select(*[col(k) for k in keys], "track", "t.*")
