"""Health of the pipeline itself: alerts, trends, delivery windows, history, registry and tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .places import with_places

DAY = 86_400
SEVERITY = {"critical": 3, "warn": 2, "info": 1}


def severity_rank(column: str = "severity") -> Column:
    return reduce(lambda acc, kv: F.when(F.col(column) == kv[0], kv[1]).otherwise(acc), SEVERITY.items(), F.lit(0))


def alerts(health: DataFrame) -> DataFrame:
    """(run, severity, code) for every rule that a row of measures breaks.

    ``health``: run, now, running, interval_seconds, last_collect_ts, last_error, overdue, fallback_due,
    x_count, rss_count, total_count, raw_total, selected_total, summary_total, summary_fallback,
    task_failed_hours, task_running_minutes. Optional, false where absent: starting (the first collection is
    under way), fallback_attempted, model_first, model_available; and of the bridge that posts come
    through, x_configured, bridge_known, bridge_installed, bridge_stale, bridge_connected, bridge_recovers.
    """
    c = F.col
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)) if name in health.columns else F.lit(False)
    watched = flag("x_configured") & flag("bridge_known")
    absent, down = watched & ~flag("bridge_installed"), watched & flag("bridge_installed") & ~flag("bridge_connected") & ~flag("bridge_recovers")
    blocked = absent | (down & ~flag("bridge_stale"))
    slow = F.greatest(F.floor(c("interval_seconds") * 2.5), c("interval_seconds") + 1800)
    share = c("rss_count") / F.when(c("total_count") > 0, c("total_count"))
    fallback = c("summary_fallback") / F.when(c("summary_total") > 0, c("summary_total"))
    failed = F.coalesce(c("last_error"), F.lit("")) != ""
    missing = c("running") & c("last_collect_ts").isNull()
    rules = [
        ("warn", "collect_failed", failed), ("info", "collect_starting", ~failed & missing & flag("starting")), ("warn", "collect_missing", ~failed & missing & ~flag("starting")), ("warn", "collect_stale", ~failed & ~missing & (c("now") - c("last_collect_ts") > slow)),
        ("critical", "delivery_overdue", c("overdue") & (c("fallback_due") | flag("fallback_attempted"))), ("warn", "delivery_overdue", c("overdue") & ~(c("fallback_due") | flag("fallback_attempted"))),
        ("critical", "bridge_missing", absent), ("warn", "bridge_stale", down & flag("bridge_stale")), ("critical", "bridge_down", down & ~flag("bridge_stale")), ("critical", "x_source_missing", ~blocked & (c("total_count") > 0) & (c("x_count") <= 0)), ("warn", "model_unavailable", flag("model_first") & ~flag("model_available")),
        ("warn", "rss_dominant", (c("total_count") >= 6) & (share >= 0.85)), ("critical", "summary_fallback_high", (c("summary_total") >= 3) & (fallback >= 0.95)), ("warn", "summary_fallback_high", (c("summary_total") >= 3) & (fallback >= 0.6) & (fallback < 0.95)),
        ("warn", "nothing_selected", (c("raw_total") > 0) & (c("selected_total") <= 0)), ("warn", "task_failed", c("task_failed_hours") <= 12), ("warn", "task_stuck", c("task_running_minutes") > 20),
    ]
    made = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(code).alias("code"))) for s, code, cond in rules]))
    return health.select("run", "now", F.explode(made).alias("a")).select("run", "now", "a.severity", "a.code")


def levels(health: DataFrame, found: DataFrame) -> DataFrame:
    """(run, level, alerts): the worst severity of each run, ok without alerts."""
    worst = found.groupBy("run").agg(F.max_by("severity", severity_rank()).alias("level"), F.count(F.lit(1)).alias("alerts"))
    return health.select("run").join(worst, "run", "left").select("run", F.coalesce("level", F.lit("ok")).alias("level"), F.coalesce("alerts", F.lit(0)).alias("alerts"))


def ordered_alerts(found: DataFrame) -> DataFrame:
    """Add ``place``: the order of each run's alerts, the severest first, then by code, both descending."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy("run").orderBy(F.desc(severity_rank()), F.desc("code"))))


def trend_summary(history: DataFrame, now: int, window: int = DAY) -> DataFrame:
    """One row: samples and runs with issues of the last window, and the three codes that occur in most runs, two at least."""
    recent = history.where(F.col("captured_at") >= now - window).withColumn("_codes", F.filter(F.transform("alert_codes", F.lower), lambda x: x != ""))
    totals = recent.agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.size("_codes") > 0).alias("issue_runs"))
    top = trend(history, now, window).orderBy(F.desc("runs"), "code").limit(3)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("runs")).alias("n"), "code")))
    return totals.crossJoin(top.agg(F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["code"], (-x["n"]).cast("string"))), ",").alias("top_codes")))  # one row each


def trend(history: DataFrame, now: int, window: int = DAY) -> DataFrame:
    """(code, runs): in how many runs of the last window each code occurs, those in two or more."""
    recent = history.where(F.col("captured_at") >= now - window)
    codes = recent.select("run", F.explode(F.array_distinct(F.filter(F.transform("alert_codes", F.lower), lambda x: x != ""))).alias("code"))
    return codes.groupBy("code").agg(F.count(F.lit(1)).alias("runs")).where("runs >= 2")


def trend_alert(repeats: DataFrame, samples: Column, issue_runs: Column, active: list[str]) -> DataFrame:
    """One row if repeated codes are still active: critical from three runs on."""
    still = repeats.where(F.col("code").isin(active)).agg(F.max("runs").alias("runs"))
    return still.where((samples >= 3) & (issue_runs >= 2) & F.col("runs").isNotNull()).select(F.when(F.col("runs") >= 3, "critical").otherwise("warn").alias("severity"), "runs")


def source_totals(counts: DataFrame) -> DataFrame:
    """Counts by topic and source pivoted to one row for each topic, and the total."""
    pick = lambda s: F.coalesce(F.sum(F.when(F.col("source") == s, F.col("n"))), F.lit(0)).alias(s)
    return counts.groupBy("topic").agg(pick("x"), pick("rss"), pick("reddit"), F.sum("n").alias("total"))


def delivery_window(states: DataFrame, zone: str = "Asia/Shanghai", due: tuple[int, int] = (8, 30), warn: int = 300, fallback: int = 900) -> DataFrame:
    """Due, overdue and fallback flags of each state (id, now as epoch seconds, last_sent_date, fallback_date, pending_date)."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_seconds("now").cast("timestamp_ntz"))
    seconds = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local) - (due[0] * 3600 + due[1] * 60)
    out = states.withColumn("today", F.date_format(local, "yyyy-MM-dd")).withColumn("_late", F.greatest(seconds, F.lit(0)))
    pending = F.coalesce(F.col("pending_date") == F.col("today"), F.lit(False))
    sent = F.coalesce(F.col("last_sent_date") == F.col("today"), F.lit(False))
    overdue = ~sent & ~pending & (F.col("_late") >= warn)
    return out.withColumns({
        "is_due": seconds >= 0, "is_overdue": overdue, "overdue_minutes": F.when(overdue, F.floor(F.col("_late") / 60)).otherwise(0),
        "fallback_due": overdue & (F.col("_late") >= fallback) & ~F.coalesce(F.col("fallback_date") == F.col("today"), F.lit(False)),
    }).drop("_late")


def next_slot(instants: DataFrame, zone: str = "Asia/Shanghai", slots: tuple[tuple[int, int], ...] = ((8, 0), (20, 0))) -> DataFrame:
    """Add ``next_at``: the first daily slot of the zone strictly after ``now``."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_seconds("now").cast("timestamp_ntz"))
    midnight = F.date_trunc("day", local)
    ahead = [F.unix_seconds(F.convert_timezone(F.lit(zone), F.lit("UTC"), (midnight + F.make_dt_interval(F.lit(day), F.lit(h), F.lit(m))).cast("timestamp_ntz")).cast("timestamp")) for day in (0, 1) for h, m in slots]
    return instants.withColumn("next_at", F.array_min(F.filter(F.array(*ahead), lambda x: x > F.col("now"))))


def latest_by_key(rows: DataFrame, key: list[str], order: list[Column], keep: int | None = None, newest: str | None = None) -> DataFrame:
    """The first row of each key in the given order; with ``keep``, of the ``keep`` greatest values of ``newest`` alone."""
    one = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
    return one if keep is None else one.orderBy(F.desc(newest)).limit(keep)


def retained(rows: DataFrame, time: str, now: int, days: int = 3) -> DataFrame:
    """Rows with a positive time within the last days: pruned by partition where the table is partitioned by it."""
    return rows.where((F.col(time) > 0) & (F.col(time) >= now - days * DAY))


def merged_registry(registry: DataFrame, sent_now: DataFrame, now: int) -> DataFrame:
    """(key, sent_at): keys sent now overwrite older times."""
    fresh = sent_now.select(F.col("dedupe_key").alias("key"), F.lit(now).cast("long").alias("sent_at"))
    return registry.select("key", "sent_at").unionByName(fresh).groupBy("key").agg(F.max("sent_at").alias("sent_at"))


def restarted(tasks: DataFrame) -> DataFrame:
    """Tasks after a restart: those that were queued or running have failed."""
    return tasks.withColumn("status", F.when(F.col("status").isin("queued", "running"), "failed").otherwise(F.col("status")))


def parsed_time(x: Column, zone: str = "UTC") -> Column:
    """Epoch seconds of a time text in any of six forms, null if none fits; offsets count, local forms are in ``zone``."""
    plain = F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")])
    local = F.to_utc_timestamp(plain, zone)
    fixed = F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssXXX", "MMM dd HH:mm:ss Z yyyy", "dd MMM yyyy HH:mm:ss Z")])
    bare = F.regexp_replace(F.regexp_replace(x, "^[A-Za-z]{3},? ", ""), "GMT$", "+0000")
    other = F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in ("MMM dd HH:mm:ss Z yyyy", "dd MMM yyyy HH:mm:ss Z")])
    return F.unix_seconds(F.coalesce(local, fixed, other))


def source_mix(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts by source as a map, for each group."""
    counted = rows.groupBy(*by, "source").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("source_counts"))


def silent_topics(configured: DataFrame, counts: DataFrame, source: str = "x") -> DataFrame:
    """Configured topics from which a source brought nothing, so that a retry is due."""
    return configured.join(counts.where((F.col("source") == source) & (F.col("n") > 0)), "topic", "left_anti")


def tasks_by_anchor(tasks: DataFrame) -> DataFrame:
    """Tasks with ``anchor``, the latest of their times, one row for each id, newest first by (anchor, id) as ``place``."""
    anchor = F.greatest(F.coalesce("finished_at", F.lit(0)), F.coalesce("started_at", F.lit(0)), F.coalesce("submitted_at", F.lit(0)))
    one = latest_by_key(tasks.withColumn("anchor", anchor), ["id"], [F.desc("anchor"), F.desc("status")])
    return with_places(one, [], [F.desc("anchor"), F.desc("id")]).withColumn("place", (F.col("place") + 1).cast("int"))


def may_submit(tasks: DataFrame) -> DataFrame:
    """One row: whether no task is queued or running."""
    return tasks.agg((F.count_if(F.col("status").isin("queued", "running")) == 0).alias("may_submit"))


def batches(rows: DataFrame, order: str, size: int, by: list[str]) -> DataFrame:
    """Add ``batch``: rows of a group in order, ``size`` at a time; a group is placed by ranges, however large it is."""
    return with_places(rows, by, [order]).withColumn("batch", F.floor(F.col("place") / size)).drop("place")


def symbol_list(x: Column) -> Column:
    """Symbols from a text: upper case, split at spaces, commas and semicolons of either width, distinct in order."""
    return F.array_distinct(F.filter(F.split(F.upper(x), r"[\s,，;；]+"), lambda s: s != ""))


def list_changes(wanted: Column, present: Column) -> tuple[Column, Column]:
    """Symbols to add and to remove."""
    return F.array_except(wanted, present), F.array_except(present, wanted)
