"""Messages to the outside, each sent at most once by what the library does: a log of prepared, sent and committed.

Every step is written before the next begins, as a delta of a keyed table. A run that breaks off
between a send and its note leaves the message ``sending``: whether it is out is not known, so it
is held until an operator confirms or clears it. A batch that is repeated takes up where it broke off.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fingerprint
from .keyed import KeyedTable

#: The states of a message. The first two are pending.
SENDING, SENT, COMMITTED, FAILED, CLEARED = "sending", "sent_not_committed", "committed", "failed", "cleared"
COLUMNS = ["key", "state", "step", "sender", "at", "fingerprint", "message_id", "error", "body"]


@dataclass(frozen=True)
class Outbox:
    """A log at ``path`` (of the shared store) with one writer at a time; any number may read.

    ``send`` takes (key, body, fingerprint) and returns (key, message_id, error): a frame's own work,
    for example ``mapInPandas`` around a client. An error means that the message is not out; a key
    that is missing from the answer stays ``sending``. Spark may run a task again when an executor is
    lost, so a client should pass the fingerprint on as the message's own id: the log keeps
    batches, not tasks, from sending twice.
    """

    spark: SparkSession
    path: str

    @property
    def table(self) -> KeyedTable:
        return KeyedTable(self.spark, self.path, ("key",), "step")

    def states(self) -> DataFrame:
        """The newest row of every message."""
        rows = self.table.current()
        return rows if rows is not None else self.spark.createDataFrame([], "key string, state string, step long, sender long, at long, fingerprint string, message_id string, error string, body string")

    def pending(self) -> DataFrame:
        """Messages that wait for an operator or for their batch to be repeated."""
        return self.states().where(F.col("state").isin(SENDING, SENT))

    def registry(self) -> DataFrame:
        """(key, sent_at) of what was delivered, as ``not_sent`` and ``merged_registry`` take it."""
        return self.states().where(F.col("state") == COMMITTED).select("key", F.col("at").alias("sent_at"))

    def _write(self, rows: DataFrame, **values: Column) -> DataFrame:
        """Write one step and return it as written, so that a send reads the log and not its source again."""
        step = self.table.next_batch()
        out = rows.withColumns(values | {"step": F.lit(step).cast("bigint")}).select(*COLUMNS)
        self.table.upsert(out, step)
        return self.spark.read.schema(out.schema).parquet(f"{self.path}/deltas/batch={step}")

    def deliver(self, rows: DataFrame, batch: int, now: int, send: Callable[[DataFrame], DataFrame]) -> None:
        """Send the rows (key, body) of a batch that are not pending or committed, and commit them.

        Of rows of one key one is sent, that of the least body; rows whose key is null or whose body
        is blank are none's message and are left out. Failed and cleared messages may be sent again.
        """
        at, none = F.lit(now).cast("bigint"), F.lit(None).cast("string")
        known = self.states().where(F.col("state").isin(SENDING, SENT, COMMITTED)).select("key")
        whole = rows.where(F.col("key").isNotNull() & (F.trim(F.coalesce("body", F.lit(""))) != ""))
        new = whole.groupBy(F.col("key").cast("string").alias("key")).agg(F.min("body").alias("body")).join(known, "key", "left_anti")
        prepared = self._write(new, state=F.lit(SENDING), sender=F.lit(batch).cast("bigint"), at=at, fingerprint=fingerprint(F.concat_ws("|", "key", "body")), message_id=none, error=none)
        answers = send(prepared.select("key", "body", "fingerprint")).select("key", F.col("message_id").cast("string").alias("message_id"), F.col("error").cast("string").alias("error"))
        failed = F.coalesce("error", F.lit("")) != ""
        one = answers.groupBy("key").agg(F.min_by(F.struct("message_id", "error"), F.struct(failed, "message_id")).alias("_a")).select("key", "_a.*")  # a send that went through counts
        self._write(prepared.drop("message_id", "error").join(one, "key"), state=F.when(failed, FAILED).otherwise(SENT), body=none)
        self.commit(batch)

    def commit(self, batch: int) -> None:
        """Note that what a batch sent is delivered; also what an earlier run of it sent and did not commit."""
        sent = self.states().where((F.col("state") == SENT) & (F.col("sender") == batch))
        self._write(sent, state=F.lit(COMMITTED))

    def resolve(self, action: str, keys: DataFrame | None = None) -> None:
        """Confirm pending messages as delivered, or clear them so that they may be sent again; all, or those of ``keys`` (key)."""
        if action not in ("confirm", "clear"):
            raise ValueError("an operator may confirm or clear")
        rows = self.pending() if keys is None else self.pending().join(keys.select("key").distinct(), "key", "left_semi")
        self._write(rows, state=F.lit(COMMITTED if action == "confirm" else CLEARED), body=F.lit(None).cast("string"))

    def sink(self, send: Callable[[DataFrame], DataFrame], clock: Callable[[], int]) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch`` of a stream of (key, body)."""
        return lambda rows, batch: self.deliver(rows, batch, clock(), send)
