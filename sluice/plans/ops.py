"""Queries about the pipeline's health over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delivery as D
from ..operators import ops as O
from ..operators import records
from ..sources.frames import table

NOW = 1_706_572_800  # the end of the tables' events


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of measures for each hour of events."""
    e = table(spark, sf_dir, "events").withColumn("run", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("long"))
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    h = e.groupBy("run").agg(n("view").alias("x_count"), n("click").alias("rss_count"), n("error").alias("errors"), n("purchase").alias("selected_total"), n("signup").alias("summary_fallback"), F.count(F.lit(1)).alias("raw_total"))
    run = F.col("run")
    return h.select(
        "run", (run * 3600).alias("now"), F.lit(True).alias("running"), F.lit(3600).alias("interval_seconds"), F.when(run % 13 != 0, run * 3600 - run % 4 * 4000).alias("last_collect_ts"), F.when(F.col("errors") > 5, "failed").alias("last_error"), (run % 7 == 0).alias("overdue"), (run % 14 == 0).alias("fallback_due"),
        "x_count", "rss_count", (F.col("x_count") + F.col("rss_count")).alias("total_count"), "raw_total", "selected_total", (F.col("selected_total") + F.col("summary_fallback")).alias("summary_total"), "summary_fallback", (run % 30).alias("task_failed_hours"), (run % 23).alias("task_running_minutes"), (run % 26 == 0).alias("starting"), (run % 21 == 0).alias("fallback_attempted"), F.lit(True).alias("x_configured"), (run % 2 == 0).alias("bridge_known"), (run % 5 != 0).alias("bridge_installed"), (run % 4 == 0).alias("bridge_stale"), (run % 3 == 0).alias("bridge_connected"), (run % 11 == 0).alias("bridge_recovers"), (run % 6 == 0).alias("model_first"), (run % 12 == 0).alias("model_available"))


_HEALTH = """
e AS (SELECT CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS run, event_type FROM events),
h0 AS (SELECT run, count_if(event_type = 'view') AS x, count_if(event_type = 'click') AS r, count_if(event_type = 'error') AS er, count_if(event_type = 'purchase') AS s, count_if(event_type = 'signup') AS f, count(*) AS n FROM e GROUP BY run),
h AS (SELECT run, run * 3600 AS now, CASE WHEN run % 13 <> 0 THEN run * 3600 - run % 4 * 4000 END AS lc, er > 5 AS failed, run % 7 = 0 AS od, run % 14 = 0 AS fd, x, r, x + r AS tot, n, s, s + f AS st, f, run % 30 AS tf, run % 23 AS tr, run % 26 = 0 AS sg, run % 21 = 0 AS fa, run % 2 = 0 AND run % 5 = 0 AS ab, run % 2 = 0 AND run % 5 <> 0 AND run % 3 <> 0 AND run % 11 <> 0 AS dn, run % 4 = 0 AS sl, run % 6 = 0 AND run % 12 <> 0 AS mu FROM h0),
a AS (SELECT run, now, 'warn' AS severity, 'collect_failed' AS code FROM h WHERE failed UNION ALL SELECT run, now, 'info', 'collect_starting' FROM h WHERE NOT failed AND lc IS NULL AND sg UNION ALL SELECT run, now, 'warn', 'collect_missing' FROM h WHERE NOT failed AND lc IS NULL AND NOT sg UNION ALL SELECT run, now, 'critical', 'bridge_missing' FROM h WHERE ab UNION ALL SELECT run, now, 'warn', 'bridge_stale' FROM h WHERE dn AND sl UNION ALL SELECT run, now, 'critical', 'bridge_down' FROM h WHERE dn AND NOT sl UNION ALL SELECT run, now, 'warn', 'model_unavailable' FROM h WHERE mu UNION ALL SELECT run, now, 'warn', 'collect_stale' FROM h WHERE NOT failed AND lc IS NOT NULL AND now - lc > 9000
 UNION ALL SELECT run, now, 'critical', 'delivery_overdue' FROM h WHERE od AND (fd OR fa) UNION ALL SELECT run, now, 'warn', 'delivery_overdue' FROM h WHERE od AND NOT (fd OR fa) UNION ALL SELECT run, now, 'critical', 'x_source_missing' FROM h WHERE tot > 0 AND x <= 0 AND NOT (ab OR (dn AND NOT sl))
 UNION ALL SELECT run, now, 'warn', 'rss_dominant' FROM h WHERE tot >= 6 AND r / tot >= 0.85 UNION ALL SELECT run, now, 'critical', 'summary_fallback_high' FROM h WHERE st >= 3 AND f / st >= 0.95 UNION ALL SELECT run, now, 'warn', 'summary_fallback_high' FROM h WHERE st >= 3 AND f / st >= 0.6 AND f / st < 0.95
 UNION ALL SELECT run, now, 'warn', 'nothing_selected' FROM h WHERE n > 0 AND s <= 0 UNION ALL SELECT run, now, 'warn', 'task_failed' FROM h WHERE tf <= 12 UNION ALL SELECT run, now, 'warn', 'task_stuck' FROM h WHERE tr > 20)"""


def ops_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.alerts(health(spark, sf_dir)).select("run", "severity", "code")


def ops_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = health(spark, sf_dir)
    return O.levels(h, O.alerts(h))


def ops_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = O.alerts(health(spark, sf_dir))
    history = found.groupBy("run").agg(F.max("now").alias("captured_at"), F.collect_list("code").alias("alert_codes"))
    return O.trend(history, NOW)


def ops_alert_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.ordered_alerts(O.alerts(health(spark, sf_dir))).select("run", "severity", "code", "place")


def ops_trend_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = O.alerts(health(spark, sf_dir))
    return O.trend_summary(found.groupBy("run").agg(F.max("now").alias("captured_at"), F.collect_list("code").alias("alert_codes")), NOW)


def ops_source_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    source = F.when(F.col("doc_id") % 3 == 0, "x").when(F.col("doc_id") % 3 == 1, "rss").otherwise("reddit")
    return O.source_totals(d.groupBy(F.col("lang").alias("topic"), source.alias("source")).agg(F.count(F.lit(1)).alias("n")))


def _instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    now = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") * 7919 % 86400
    day = F.date_format(F.timestamp_seconds(now + 28800), "yyyy-MM-dd")
    k = F.col("o_orderkey")
    return o.select(k.alias("id"), now.alias("now"), F.when(k % 5 == 0, day).alias("last_sent_date"), F.when(k % 4 == 0, day).alias("fallback_date"), F.when(k % 9 == 0, day).alias("pending_date"))


_INSTANTS = """i0 AS (SELECT o_orderkey AS id, CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey * 7919 % 86400 AS now FROM orders),
i AS (SELECT *, strftime(make_timestamp((now + 28800) * 1000000), '%Y-%m-%d') AS today, (now + 28800) % 86400 - 30600 AS s FROM i0),
d AS (SELECT *, s >= 0 AS is_due, greatest(s, 0) AS late, id % 5 <> 0 AND id % 9 <> 0 AND s >= 300 AS is_overdue FROM i)"""


def ops_delivery_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.delivery_window(_instants(spark, sf_dir)).select("id", "today", "is_due", "is_overdue", F.col("overdue_minutes").cast("long").alias("overdue_minutes"), "fallback_due")


def ops_next_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.next_slot(_instants(spark, sf_dir).select("id", "now")).select("id", "now", "next_at")


def ops_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest order of each day, of the three newest days."""
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderkey")
    return O.latest_by_key(o, ["day"], [F.desc("o_orderkey")], 3, "day")


def ops_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    old = c.select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key"), (F.lit(NOW) - F.col("c_custkey") * 600).alias("sent_at"))
    now = c.where("c_custkey % 3 = 0").select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("dedupe_key"))
    return O.retained(O.merged_registry(old, now, NOW), "sent_at", NOW)


def ops_parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, t = table(spark, sf_dir, "orders"), F.col("o_orderdate")
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).when(k % 5 == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")).when(k % 5 == 2, F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))).when(k % 5 == 3, F.concat(F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise("soon")
    return o.select(k.alias("id"), O.parsed_time(text).alias("ts"))


def ops_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id") % 50, F.col("role").alias("source")).toDF("topic", "source")
    flat = F.array_join(F.transform(F.map_entries("source_counts"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return O.source_mix(c, ["topic"]).select("topic", flat.alias("mix"))


def ops_silent_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    counts = e.groupBy((F.col("user_id") % 900).alias("topic"), F.when(F.col("event_type") == "error", "x").otherwise("rss").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return O.silent_topics(spark.range(1000).select(F.col("id").alias("topic")), counts)


def ops_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    tasks = o.select(F.floor(k / 4).alias("id"), F.concat(F.lit("s"), k.cast("string")).alias("status"), (k * 13 % 1000).alias("submitted_at"), F.when(k % 3 != 0, k * 29 % 1000).alias("started_at"), F.when(k % 4 != 0, k * 31 % 1000).alias("finished_at"))
    return O.tasks_by_anchor(tasks).select("id", "anchor", "status", "place")


def ops_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.batches(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", 4, ["o_orderpriority"])


def ops_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer")
    wanted, present = O.symbol_list(F.concat_ws(" ,", "c_mktsegment", "c_name", F.lower("c_mktsegment"))), F.array(F.upper("c_name"), F.lit("OLD"))
    add, remove = O.list_changes(wanted, present)
    return p.select("c_custkey", F.array_join(wanted, "|").alias("symbols"), F.array_join(add, "|").alias("added"), F.array_join(remove, "|").alias("removed"))


def _delivery_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the log of deliveries, each user a channel; seven in ten attempts are due."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.when(F.col("event_type") == "view", "failed").when(F.col("event_type") == "error", "sending").when(F.col("event_type") == "signup", "sent_not_committed").when(F.col("event_type") == "click", "committed").when(n % 5 < 2, "confirm").when(n % 5 < 4, "clear").otherwise("note")
    return e.select(F.col("user_id").alias("channel"), n.alias("seq"), F.date_format("ts", "yyyy-MM-dd").alias("day"), kind.alias("kind"), (n % 10 < 7).alias("due"))


def ops_delivery_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.outcomes(_delivery_log(spark, sf_dir)).select("channel", "seq", "day_of", "before", "outcome")


def ops_delivery_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.standing(D.outcomes(_delivery_log(spark, sf_dir)))


def ops_history_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loose history rows of orders, one in eleven null, put in form."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    at = F.when(k % 4 == 0, F.concat(F.lit(" "), k.cast("string"))).when(k % 4 == 1, "soon").when(k % 4 == 2, (-k).cast("string"))
    entry = F.struct(at.alias("captured_at"), F.when(k % 6 != 0, F.array("o_orderpriority", F.lit(" "), F.lit(None).cast("string"), F.lit(" X "))).alias("alert_codes"), F.when(k % 3 == 0, "WARN ").when(k % 3 == 1, " ").alias("level"), F.upper("o_orderstatus").alias("source"))
    rows = records.coerced_history(o.select(k.alias("run"), F.when(k % 11 != 0, entry).alias("entry")))
    return rows.select("run", "captured_at", F.array_join("alert_codes", ",").alias("codes"), "level", "source")


def ops_task_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks whose results are JSON texts, whole, empty, broken or absent."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    result = F.when(k % 5 == 0, F.format_string('{"digest_date": "2024-01-%02d", "counts": {"x": %d}, "build_stats": {"timings_ms": {"rank": %d}}}', k % 28 + 1, k, k * 2)).when(k % 5 == 1, "{}").when(k % 5 == 2, '{"counts": {"x"').when(k % 5 == 3, '{"digest_date": "2024-02-01"}')
    tasks = o.select(k.alias("id"), F.when(k % 8 != 0, F.concat(F.lit(" "), F.upper("o_orderstatus"))).alias("status"), F.when(k % 2 == 0, k % 4 == 0).alias("final"), F.when(k % 9 == 0, k % 18 != 0).alias("respect_sent"), result.alias("result"))
    one = lambda m, key: F.try_element_at(m, F.lit(key))
    return records.task_results(tasks).select("id", "status", "final", "respect_sent", "has_result", "result_digest_date", one("result_counts", "x").alias("n"), one("result_timings_ms", "rank").alias("ms"))


#: The rule as a machine that takes the rows of each channel one by one.
_DELIVERIES = """
dl AS (SELECT user_id AS channel, event_id AS seq, strftime(ts, '%Y-%m-%d') AS day, CASE event_type WHEN 'view' THEN 'failed' WHEN 'error' THEN 'sending' WHEN 'signup' THEN 'sent_not_committed' WHEN 'click' THEN 'committed' ELSE CASE WHEN event_id % 5 < 2 THEN 'confirm' WHEN event_id % 5 < 4 THEN 'clear' ELSE 'note' END END AS kind, event_id % 10 < 7 AS due, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
mc AS (SELECT channel, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS day, NULL::VARCHAR AS pending, NULL::VARCHAR AS sent, NULL::VARCHAR AS before, NULL::VARCHAR AS outcome, NULL::VARCHAR AS kind FROM (SELECT DISTINCT channel FROM dl)
 UNION ALL SELECT x.channel, x.n, x.seq, x.day, CASE WHEN x.outcome IN ('sending', 'sent_not_committed') THEN x.kind WHEN x.outcome IN ('confirmed', 'cleared') THEN NULL ELSE x.pending END, CASE WHEN x.outcome IN ('committed', 'confirmed') THEN x.day ELSE x.sent END, x.before, x.outcome, x.kind FROM (
  SELECT *, CASE WHEN kind = 'note' THEN 'ignored' WHEN kind IN ('confirm', 'clear') THEN CASE WHEN before <> 'held' THEN 'nothing' WHEN kind = 'confirm' THEN 'confirmed' ELSE 'cleared' END WHEN before = 'sent' THEN 'already_sent' WHEN before = 'held' THEN 'held' WHEN due THEN kind ELSE 'waiting' END AS outcome FROM (
   SELECT *, CASE WHEN kind = 'note' THEN 'free' WHEN sent = day THEN 'sent' WHEN pending IS NOT NULL THEN 'held' ELSE 'free' END AS before FROM (
    SELECT d.channel, d.n, d.seq, d.kind, d.due, m.sent, CASE WHEN d.kind IN ('confirm', 'clear', 'note') THEN m.day ELSE d.day END AS day, CASE WHEN d.kind NOT IN ('confirm', 'clear', 'note') AND d.day IS DISTINCT FROM m.day THEN NULL ELSE m.pending END AS pending FROM mc m JOIN dl d ON d.channel = m.channel AND d.n = m.n + 1))) x)"""


QUERIES = {f.__name__: f for f in (ops_alerts, ops_alert_order, ops_levels, ops_trend, ops_trend_summary, ops_source_totals, ops_delivery_window, ops_next_slot, ops_history, ops_registry, ops_parsed_times, ops_source_mix, ops_silent_topics, ops_tasks, ops_batches, ops_symbols, ops_delivery_outcomes, ops_delivery_standing, ops_history_entries, ops_task_results)}

ORACLES = {
    "ops_history_entries": "SELECT o_orderkey AS run, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey ELSE 0 END::BIGINT AS captured_at, CASE WHEN o_orderkey % 6 <> 0 THEN lower(trim(o_orderpriority)) || ',x' ELSE '' END AS codes, CASE WHEN o_orderkey % 3 = 0 THEN 'warn' ELSE 'ok' END AS level, lower(o_orderstatus) AS source FROM orders WHERE o_orderkey % 11 <> 0",
    "ops_task_results": """SELECT o_orderkey AS id, lower(o_orderstatus) AS status, o_orderkey % 2 = 0 AND o_orderkey % 4 = 0 AS final, CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey % 18 <> 0 ELSE o_orderkey % 2 = 0 AND o_orderkey % 4 = 0 END AS respect_sent, o_orderkey % 5 IN (0, 3) AS has_result,
  CASE o_orderkey % 5 WHEN 0 THEN printf('2024-01-%02d', o_orderkey % 28 + 1) WHEN 3 THEN '2024-02-01' ELSE '' END AS result_digest_date, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey END AS n, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey * 2 END AS ms FROM orders WHERE o_orderkey % 8 <> 0""",
    "ops_delivery_outcomes": f"WITH RECURSIVE {_DELIVERIES} SELECT channel, seq, CASE WHEN kind <> 'note' THEN day END AS day_of, before, outcome FROM mc WHERE n > 0",
    "ops_delivery_standing": f"""WITH RECURSIVE {_DELIVERIES}, la AS (SELECT channel, max(n) AS n FROM mc GROUP BY channel), ag AS (SELECT channel, count_if(outcome IN ('sending', 'sent_not_committed', 'committed', 'failed')) AS attempts, count_if(outcome = 'held') AS held_back, count_if(outcome = 'failed') AS failures, coalesce(arg_max(outcome, n) FILTER (outcome IN ('sending', 'sent_not_committed', 'committed', 'failed')) = 'failed', false) AS failed_last FROM mc GROUP BY channel)
  SELECT mc.channel, sent AS last_sent_day, CASE WHEN pending IS NOT NULL THEN day END AS pending_day, pending, attempts, held_back, failures, failed_last FROM mc JOIN la USING (channel, n) JOIN ag USING (channel)""",
    "ops_alerts": f"WITH {_HEALTH} SELECT run, severity, code FROM a",
    "ops_levels": f"WITH {_HEALTH}, w AS (SELECT run, max(CASE severity WHEN 'critical' THEN 3 WHEN 'warn' THEN 2 ELSE 1 END) AS w, count(*) AS n FROM a GROUP BY run) SELECT h.run, CASE w.w WHEN 3 THEN 'critical' WHEN 2 THEN 'warn' WHEN 1 THEN 'info' ELSE 'ok' END AS level, coalesce(w.n, 0) AS alerts FROM h LEFT JOIN w USING (run)",
    "ops_trend": f"WITH {_HEALTH} SELECT code, count(DISTINCT run) AS runs FROM a WHERE now >= {NOW} - 86400 GROUP BY code HAVING count(DISTINCT run) >= 2",
    "ops_alert_order": f"WITH {_HEALTH} SELECT run, severity, code, row_number() OVER (PARTITION BY run ORDER BY CASE severity WHEN 'critical' THEN 3 WHEN 'warn' THEN 2 ELSE 1 END DESC, code DESC)::INT AS place FROM a",
    "ops_trend_summary": f"WITH {_HEALTH}, r AS (SELECT * FROM a WHERE now >= {NOW} - 86400), c AS (SELECT code, count(DISTINCT run) AS n FROM r GROUP BY code HAVING count(DISTINCT run) >= 2 ORDER BY n DESC, code LIMIT 3) SELECT (SELECT count(DISTINCT run) FROM r) AS samples, (SELECT count(DISTINCT run) FROM r) AS issue_runs, coalesce((SELECT string_agg(code || ':' || n, ',' ORDER BY n DESC, code) FROM c), '') AS top_codes",
    "ops_source_totals": "SELECT lang AS topic, count_if(doc_id % 3 = 0)::BIGINT AS x, count_if(doc_id % 3 = 1)::BIGINT AS rss, count_if(doc_id % 3 = 2)::BIGINT AS reddit, count(*) AS total FROM documents GROUP BY lang",
    "ops_delivery_window": f"WITH {_INSTANTS} SELECT id, today, is_due, is_overdue, CASE WHEN is_overdue THEN late // 60 ELSE 0 END AS overdue_minutes, is_overdue AND late >= 900 AND id % 4 <> 0 AS fallback_due FROM d",
    "ops_next_slot": f"WITH {_INSTANTS} SELECT id, now, now - (now + 28800) % 86400 + CASE WHEN (now + 28800) % 86400 < 28800 THEN 28800 WHEN (now + 28800) % 86400 < 72000 THEN 72000 ELSE 115200 END AS next_at FROM i",
    "ops_history": "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 3",
    "ops_registry": f"SELECT key, sent_at FROM (SELECT 'k' || c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN {NOW} ELSE {NOW} - c_custkey * 600 END AS sent_at FROM customer) WHERE sent_at >= {NOW} - 259200",
    "ops_parsed_times": "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 4 THEN NULL WHEN 2 THEN CAST(epoch(o_orderdate) AS BIGINT) - 28800 ELSE CAST(epoch(o_orderdate) AS BIGINT) END AS ts FROM orders",
    "ops_source_mix": "SELECT topic, string_agg(role || ':' || n, ',' ORDER BY role) AS mix FROM (SELECT conv_id % 50 AS topic, role, count(*) AS n FROM conversations GROUP BY 1, 2) GROUP BY topic",
    "ops_silent_topics": "SELECT range AS topic FROM range(1000) WHERE range NOT IN (SELECT user_id % 900 FROM events WHERE event_type = 'error')",
    "ops_tasks": """WITH t AS (SELECT o_orderkey // 4 AS id, 's' || o_orderkey AS status, greatest(o_orderkey * 13 % 1000, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey * 29 % 1000 ELSE 0 END, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey * 31 % 1000 ELSE 0 END) AS anchor FROM orders),
  n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY anchor DESC, status DESC) AS rn FROM t) SELECT id, anchor, status, row_number() OVER (ORDER BY anchor DESC, id DESC)::INT AS place FROM n WHERE rn = 1""",
    "ops_batches": "SELECT o_orderkey, o_orderpriority, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 4 AS batch FROM orders",
    "ops_symbols": """WITH s AS (SELECT *, string_split_regex(upper(c_mktsegment || ' ,' || c_name || ' ,' || c_mktsegment), '[\\s,，;；]+') AS w0 FROM customer), u AS (SELECT *, list_filter(w0, lambda x, i: x <> '' AND list_position(w0, x) = i) AS w FROM s)
  SELECT c_custkey, array_to_string(w, '|') AS symbols, array_to_string(list_filter(w, lambda x: x <> upper(c_name) AND x <> 'OLD'), '|') AS added, array_to_string(list_filter([upper(c_name), 'OLD'], lambda x: NOT list_contains(w, x)), '|') AS removed FROM u""",
}
