"""Deliveries from their log: which attempts took effect, which were held back, and how each channel stands.

Between a send and the note that it was sent a run may break off. Then nobody knows whether the
message is out, and sending again could send it twice. So a channel has, for each day, one of three
states. It is free; or held by an attempt whose outcome is unknown or not yet committed; or sent.
Held and sent days take no further attempt. An operator confirms a held attempt, which makes it
sent, or clears it, which frees the day. The first attempt of a new day leaves what the day before
held behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from .market import SEQ_STRETCH, carried, previous, stretch
from .places import joined_narrow

#: Outcomes of attempts that hold or end a day, and the actions of operators.
HOLDING, SENT, FAILED, ACTIONS = ("sending", "sent_not_committed"), "committed", "failed", ("confirm", "clear")


def _first(rows: DataFrame, by: list[str], value, name: str) -> DataFrame:
    """The least of ``value`` for each group, as a narrow checkpoint; partial sums, so a hot group is no single task's."""
    return checkpointed(rows.groupBy(*by).agg(F.min(value).alias(name)))


def outcomes(log: DataFrame) -> DataFrame:
    """Add ``day_of`` (the day that a row concerns), ``before`` (the state that it meets) and ``outcome``.

    ``log``: channel, seq (the order of a channel's rows, distinct in it), day (of an attempt), kind,
    due. ``kind`` is an attempt's result if it is made (sending: it broke off; sent_not_committed;
    committed; failed) or an action (confirm, clear), which concerns the day of the last attempt before
    it. Days do not go back. Attempts end as ``already_sent``, ``held``, ``waiting`` (not due; null
    is not due) or their kind; actions as ``confirmed``, ``cleared`` or ``nothing``. Rows of other or
    null kinds are ``ignored``. A null channel is a channel.

    No task holds a channel: last values are carried over stretches of ``seq``, the rest are
    aggregations whose results have one row for each day or each clearing of a channel.
    """
    kind = F.coalesce("kind", F.lit(""))
    action, attempt = kind.isin(*ACTIONS), kind.isin(*HOLDING, SENT, FAILED)
    along, at = (["channel"], stretch("seq", SEQ_STRETCH)), "seq"
    rows = carried(log.withColumn("_day", F.when(attempt, F.col("day"))), *along, at, "_day", "day_of").drop("_day")
    rows = rows.withColumn("day_of", F.when(action | attempt, F.col("day_of")))
    rows = carried(rows.withColumn("_clear", F.when(kind == "clear", F.col("seq"))), *along, at, "_clear", "_cleared")
    # rows begin anew after each clearing, which itself belongs to what it clears
    rows = checkpointed(previous(rows, *along, at, ["_cleared"]).withColumn("_part", F.col("_prev._cleared")).drop("_clear", "_cleared", "_prev"))
    day, part = ["channel", "day_of"], ["channel", "day_of", "_part"]
    made = attempt & F.coalesce(F.col("due"), F.lit(False)) & (kind != FAILED)
    held = _first(rows.where(made), part, F.struct("seq", "kind"), "_held")
    confirmed = joined_narrow(rows.where(kind == "confirm"), held, part).where((F.col("seq") > F.col("_held.seq")) & F.col("_held.kind").isin(*HOLDING))
    ends = held.where(F.col("_held.kind") == SENT).select(*day, F.col("_held.seq").alias("seq")).unionByName(confirmed.select(*day, "seq"))
    met = joined_narrow(joined_narrow(rows, held, part, "left"), _first(ends, day, F.col("seq"), "_sent"), day, "left")
    before = F.when(F.col("_sent") < F.col("seq"), "sent").when(F.col("_held.seq") < F.col("seq"), "held").otherwise("free")
    acted = F.when(F.col("before") != "held", "nothing").when(kind == "confirm", "confirmed").otherwise("cleared")
    tried = F.when(F.col("before") == "sent", "already_sent").when(F.col("before") == "held", "held").when(F.coalesce(F.col("due"), F.lit(False)), F.col("kind")).otherwise("waiting")
    return met.withColumn("before", before).withColumn("outcome", F.when(action, acted).when(attempt, tried).otherwise("ignored")).drop("_part", "_held", "_sent")


def standing(settled: DataFrame) -> DataFrame:
    """One row for each channel of ``outcomes``: the last day sent, the day that is pending and its state, attempts made, held back and failed, and whether the last attempt made failed."""
    o, seq = F.col("outcome"), F.col("seq")
    made = o.isin(*HOLDING, SENT, FAILED)
    moved = F.when(made | o.isin("confirmed", "cleared", "held", "waiting", "already_sent"), F.struct("seq", "day_of", "outcome"))
    # the last row that changes or meets a state tells how the day stands: what it met, moved by what it did
    out = settled.groupBy("channel").agg(
        F.max_by("day_of", F.when(o.isin(SENT, "confirmed"), seq)).alias("last_sent_day"), F.max_by(F.struct("day_of", "before", "outcome"), F.when(moved.isNotNull(), seq)).alias("_last"), F.max_by("outcome", F.when(o.isin(*HOLDING), seq)).alias("_open"),
        F.count_if(made).alias("attempts"), F.count_if(o == "held").alias("held_back"), F.count_if(o == FAILED).alias("failures"), F.max_by(o == FAILED, F.when(made, seq)).alias("_failed"))
    now = F.when(F.col("_last.outcome").isin(*HOLDING, "held"), F.col("_open"))
    return out.select("channel", "last_sent_day", F.when(now.isNotNull(), F.col("_last.day_of")).alias("pending_day"), now.alias("pending"), "attempts", "held_back", "failures", F.coalesce("_failed", F.lit(False)).alias("failed_last"))
