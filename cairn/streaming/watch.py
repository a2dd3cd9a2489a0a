"""Watches: what changes for a key against the state kept for it."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.rows import dealt
from ..operators import ledger, watches
from .ingest import _folder, read


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """A key's rows of one micro-batch against its last kind, its rows and its changes so far."""
    last, n, changes = state.get if state.exists else (None, 0, 0)
    rows = pd.concat(list(batches)).sort_values("event_id")
    for kind in rows["event_type"]:
        changes += last is not None and kind != last
        last, n = kind, n + 1
    state.update((last, n, int(changes)))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "changes": [int(changes)]})


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, n, changes: how often a user's kind of event differs from the one before."""
    out = _folder(spark, "watch")
    kept = read(spark, sf_dir).select("user_id", "event_id", "event_type").groupBy("user_id")
    told = kept.applyInPandasWithState(_advance, "user_id long, n long, changes long", "last string, n long, changes long", "update", "NoTimeout")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

    stream = told.writeStream.outputMode("update").option("checkpointLocation", _folder(spark, "state")).foreachBatch(keep)
    stream.trigger(availableNow=True).start().awaitTermination()
    log = spark.read.schema("user_id long, n long, changes long, batch int").parquet(out)
    return ledger.latest(log.select("user_id", "n", "changes", "batch"), ["user_id"], "batch").select("user_id", "n", "changes")


PAIR = "slug long, now string, was string"


class _Pairs(StatefulProcessor):
    """Of each place the last export seen; each later one is given with it. What comes again, or late, gives nothing."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "date date, body string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        date, body = self.last.get() or (None, None)
        began = date
        for row in sorted(rows, key=lambda r: (r["date"], r["body"])):
            if date is None or row["date"] > date:
                if body is not None:
                    yield Row(slug=key[0], now=row["body"], was=body)
                date, body = row["date"], row["body"]
        if date != began:
            self.last.update((date, body))

    def close(self) -> None:
        pass


def paired_stream(exports: DataFrame) -> DataFrame:
    """``watches.paired`` of a stream of exports: (now, was), with a typed state for each place. A place has a row a day.

    Rows are handed over as they are: a table of pandas for each place takes longer than all that is done with it.
    Needs the state store that keeps typed states (RocksDB); see ``state_store``.
    """
    body = F.to_json(F.struct(*watches.FIELDS), {"ignoreNullFields": "false"})
    told = exports.select("slug", "date", body.alias("body")).groupBy("slug").transformWithState(_Pairs(), PAIR, "Append", "None")
    return told.select(*(F.from_json(c, watches.EXPORT).alias(c) for c in ("now", "was")))


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The session with the store for typed states, and with what it had before afterwards."""
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def watched(exports: DataFrame, days: list[str]) -> DataFrame:
    """slug, date, kind, reason: exports landed in steps, each up to a day of ``days``, and a stream over the folder run after each.

    The streams share a checkpoint, so a run goes on from the states of the one before.
    """
    spark = exports.sparkSession
    landed, out, state = _folder(spark, "exports"), _folder(spark, "fired"), _folder(spark, "state")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = "0001-01-01"
    with state_store(spark):
        for day in days:
            part = exports.filter((F.col("date") > F.lit(before)) & (F.col("date") <= F.lit(day)))
            dealt(part, "slug").write.mode("append").parquet(landed)
            stream = watches.fired(paired_stream(spark.readStream.schema(watches.EXPORT).parquet(landed)))
            run = stream.writeStream.outputMode("append").option("checkpointLocation", state).foreachBatch(keep)
            run.trigger(availableNow=True).start().awaitTermination()
            before = day
    return spark.read.schema("slug long, date date, kind string, reason string").parquet(out).select("slug", "date", "kind", "reason")
