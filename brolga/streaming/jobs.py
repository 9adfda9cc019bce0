"""Streams: intake of session files, the job ledger and its changes, capture of windows, sliding windows on event time."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brolga.operators.enroll import CAPTURED, SEEN, Capture, observe

PROFILE = "session_id string, state string, updated_at timestamp"
FINAL, INTERRUPTED = ("completed", "failed"), "interrupted"
MACHINE = "target double, other double, opened long, deadline long, before long, frames int, other_frames int, other_closed int"
_STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def intake(spark: SparkSession, path: str) -> DataFrame:
    """Session profiles as they arrive; the query's checkpoint knows which files are done, so each is taken once."""
    return spark.readStream.schema(PROFILE).option("multiLine", True).json(path)


def latest(jobs: DataFrame) -> DataFrame:
    """The last state of each session: the latest, of equal times the first by name."""
    n = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("updated_at"), "state"))
    return jobs.withColumn("_n", n).where("_n = 1").drop("_n")


def upsert(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """The ledger after a batch: sessions in a final state stay, others take their newest state; applying it again changes nothing."""
    done = ledger.where(F.col("state").isin(*FINAL))
    open_ = ledger.join(done, "session_id", "left_anti").unionByName(batch.join(done, "session_id", "left_anti"))
    return done.unionByName(latest(open_))


class LedgerError(RuntimeError):
    """A version of the ledger that must be there is not."""


def keep_ledger(stream: DataFrame, path: str, checkpoint: str):
    """Keeps the ledger as a table that each batch writes anew under its number; a batch that is run again writes the same.

    Every batch but the first builds on the version before it; if that is lost, LedgerError is raised.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.createDataFrame([], PROFILE)
        if number:
            try:
                old = spark.read.schema(PROFILE).parquet(f"{path}/v={number - 1}")
            except AnalysisException as e:
                raise LedgerError(f"batch {number} needs {path}/v={number - 1}, which is not there") from e
        upsert(old, batch.select("session_id", "state", "updated_at")).write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def mark_interrupted(ledger: DataFrame, at: Column) -> DataFrame:
    """The ledger as a restart finds it: sessions that are neither in a final state nor marked already were interrupted, at `at`."""
    open_ = ~F.col("state").isin(*FINAL, INTERRUPTED)
    return ledger.withColumns({"updated_at": F.when(open_, at).otherwise(F.col("updated_at")), "state": F.when(open_, INTERRUPTED).otherwise(F.col("state"))})


def keyed_state(spark: SparkSession) -> None:
    """Sets the session's store of streaming state to RocksDB, which typed state, timers and times to live need."""
    if spark.conf.get(_STORE, "").rsplit(".", 1)[-1] != ROCKS.rsplit(".", 1)[-1]:
        spark.conf.set(_STORE, ROCKS)


class Changes(StatefulProcessor):
    """The session's last state, in one variable as long as it is open; a final one is forgotten some time after it came."""

    def __init__(self, forget_ms: int | None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "state string")
        self.final = handle.getValueState("final", "state string", self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.open if self.open.exists() else self.final
        last = held.get()[0] if held.exists() else None
        told = pd.concat(list(rows)).sort_values(["updated_at", "state"])
        new = told.state != told.state.shift(fill_value="" if last is None else last)
        now = told.state.iloc[-1]
        if now != last:
            self.open.clear()
            self.final.clear()
            (self.final if now in FINAL else self.open).update((now,))
        yield told.loc[new, ["session_id", "state", "updated_at"]]

    def close(self) -> None:
        pass


def changes(stream: DataFrame, forget: int | None = 7 * 86_400_000) -> DataFrame:
    """Only rows whose state differs from the session's last one that was let through.

    Rows of a batch go by time, of equal times by name. The state of a session in a final state is forgotten `forget` ms
    (of processing time) after that came, so that state does not grow with all sessions ever seen; a row after that counts as a
    change. Without `forget` it is kept; only then does a stream over what is there now (the available-now trigger) end,
    since where time decides there is always one more batch.
    """
    keyed_state(stream.sparkSession)
    rows = stream.select("session_id", "state", "updated_at").where("state is not null")
    return rows.groupBy("session_id").transformWithStateInPandas(Changes(forget), PROFILE, "Append", "ProcessingTime" if forget else "None")


class CaptureState(StatefulProcessor):
    """A file's capture machine as typed state. A timer closes a file that falls silent, and its state goes with it."""

    def __init__(self, silent_ms: int | None):
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", MACHINE)

    def _load(self) -> Capture:
        if not self.machine.exists():
            return Capture()
        target, other, opened, deadline, before, *counts = self.machine.get()
        return Capture(target=target, other=other, opened=opened, deadline=deadline, before=before, counts=list(counts))

    def _rest(self, key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in out], columns=[x.split()[0] for x in CAPTURED.split(", ")])

    def _no_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        machine, told = self._load(), pd.concat(list(rows))
        out = observe(machine, told[told.t_ms.notna()])
        if self.silent_ms:
            self._no_timers()
        if told.t_ms.isna().any():
            out += machine.finish()
            self.machine.clear()
        else:
            m = machine
            self.machine.update((m.target, m.other, m.opened, m.deadline, m.before, *m.counts))
            if self.silent_ms:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)
        yield self._rest(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._load().finish() if self.machine.exists() else []
        self.machine.clear()
        yield self._rest(key, out)

    def close(self) -> None:
        pass


def capture_stream(stream: DataFrame, silent: int | None = 600_000) -> DataFrame:
    """Capture windows of each file as observations come: the batch's state machine as keyed state.

    Observations of a file must come in order of time from batch to batch. A row with t_ms null ends its file; so does a
    silence of `silent` ms (of processing time). After either nothing of the file is kept; what comes later begins anew.
    Without `silent` only such rows end files; a stream with it has always one more batch, see changes().
    """
    keyed_state(stream.sparkSession)
    return stream.select("file_index", *SEEN).groupBy("file_index").transformWithStateInPandas(CaptureState(silent), CAPTURED, "Append", "ProcessingTime" if silent else "None")


def drained(stream: DataFrame) -> DataFrame:
    """Everything that a stream gives for what is there now, as a table written in the shared folder; the stream ends."""
    path = shared_dir(stream.sparkSession)
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share: the one that spark.checkpoint.dir names, or, only where that is
    unset and Spark runs in one process, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/brolga-{uuid.uuid4().hex}"


def sliding(stream: DataFrame, size: str = "2 seconds", hop: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Weighted means in sliding windows on event time (ts); rows later than `late` are left out, empty windows do not come."""
    w = F.coalesce("joint_confidence", F.lit(0.0))
    rows = stream.withWatermark("ts", late).groupBy("file_index", F.window("ts", size, hop))
    return rows.agg(F.count("*").alias("frame_count"), F.try_divide(F.sum(w * F.col("value")), F.sum(F.when(F.col("value").isNotNull(), w))).alias("mean")).select(
        "file_index", F.col("window.start").alias("start"), "frame_count", "mean"
    )
