"""A digest from ranked items: stored and live rows, summaries, sections, their text, and ad-hoc search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.values import filled
from ..sources.shared import kept
from .intel import rolled_up

#: What a stored row may hold.
TOPICS, SOURCES, LEVELS = ("crypto", "world", "hot", "custom"), ("x", "rss", "reddit"), ("ok", "info", "warn", "critical")


def fetch_limit(hint: int, least: int, most: int) -> int:
    """How many rows to ask a source for: twice the hint, between limits."""
    return min(max(2 * hint, least), most)


def first_rows(rows: DataFrame, by: list[str], order: list[Column], limit: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")


def valid(rows: DataFrame, key: str = "event_key") -> DataFrame:
    """Rows of a known topic and source with a key."""
    return rows.where(F.col("topic").isin(*TOPICS) & F.col("source").isin(*SOURCES) & (T.stripped(F.col(key)) != ""))


def searched(items: DataFrame, by: list[str], terms: list[str], limit: int) -> DataFrame:
    """Ad-hoc search: for each account its newest rows, three times the limit (12 to 36), that hold a term (all without terms);
    of these the rows with signal, or those without it where there are none; ``limit`` of them, with both counts."""
    wanted = T.normal_terms(terms)
    fetched = first_rows(items, by, [F.desc("captured_at"), F.asc("pos")], min(max(3 * limit, 12), 36))
    holds = reduce(lambda a, t: a | F.lower("text").contains(t), wanted, F.lit(not wanted))
    marked = fetched.where(holds).withColumn("low", T.low_signal(F.col("text")))
    group = Window.partitionBy(*by)
    counted = marked.withColumns({"high_count": F.count_if(~F.col("low")).over(group), "low_count": F.count_if("low").over(group)})
    return first_rows(counted.where(~F.col("low") | (F.col("high_count") == 0)), by, [F.desc("captured_at"), F.asc("pos")], limit)


def pooled(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Stored and live rows as one, rolled up by topic and key."""
    return rolled_up(stored.unionByName(live, True))


def with_bootstrap(stored: DataFrame, derived: DataFrame, by: list[str]) -> DataFrame:
    """Stored rows, and derived ones of the groups that have no stored row."""
    return stored.unionByName(derived.join(stored.select(*by).distinct(), by, "left_anti"), True)


def first_available(sources: list[DataFrame], by: list[str], order: str) -> DataFrame:
    """For each group the row of the first source that has one; of several the newest by ``order``."""
    tagged = [s.withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)]
    union = reduce(lambda a, b: a.unionByName(b, True), tagged)
    return first_rows(union, by, [F.asc("_rank"), F.desc(order)], 1).drop("_rank")


def newer(a: DataFrame, b: DataFrame, by: list[str], time: str) -> DataFrame:
    """For each group the newer row of two tables; of equal times that of ``b``."""
    both = a.withColumn("_rank", F.lit(0)).unionByName(b.withColumn("_rank", F.lit(1)), True)
    return first_rows(both, by, [F.desc(time), F.desc("_rank")], 1).drop("_rank")


def with_summaries(items: DataFrame, summaries: DataFrame, key: str) -> DataFrame:
    """Items with the summary of their key, or else the short text, and ``from_model``."""
    own = summaries.select(key, F.col("summary").alias("_summary")).dropDuplicates([key])
    out = items.join(own, key, "left").withColumn("from_model", filled(F.col("_summary")) != "")
    return out.withColumn("summary", filled(F.col("_summary"), T.shortened(F.col("text"), 120))).drop("_summary")


def summary_counts(items: DataFrame) -> DataFrame:
    """Totals: items, summaries of the model, fallbacks."""
    return items.agg(F.count(F.lit(1)).alias("total"), F.count_if("from_model").alias("from_model"), F.count_if(~F.col("from_model")).alias("fallback"))


def configured_topics(config: DataFrame) -> DataFrame:
    """Topics with at least one query that is not blank; a watch list makes ``custom`` one.

    ``config``: queries, a map of topic to queries, and watched, a list of accounts.
    """
    some = lambda x: F.exists(x, lambda q: T.stripped(q) != "")
    own = config.select(F.explode("queries").alias("topic", "queries")).where(some(F.col("queries"))).select("topic")
    return own.union(config.where(some(F.col("watched"))).select(F.lit("custom").alias("topic"))).distinct()


def section_counts(selected: DataFrame) -> DataFrame:
    """Rows of each section and of all."""
    return selected.rollup("section").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("section", F.lit("all")).alias("section"), "n")


def top_events(selected: DataFrame, by: list[str], limit: int = 3) -> DataFrame:
    """The most frequent event types of each group, ties by name, as one text."""
    counted = kept(selected.select(*by, "topic_event_type"), F.col("topic_event_type") != "").groupBy(*by, "topic_event_type").agg(F.count(F.lit(1)).alias("n"))
    most = first_rows(counted, by, [F.desc("n"), F.asc("topic_event_type")], limit)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "topic_event_type")))
    return most.groupBy(*by).agg(F.array_join(F.transform(listed, lambda e: F.concat_ws(":", e["topic_event_type"], (-e["n"]).cast("string"))), ",").alias("top_events"))


def role_label(role: Column) -> Column:
    """How the roles of sources are called."""
    return F.when(role == "confirmation", "confirmed by media").when(role == "discovery", "first seen").when(role == "community", "discussed").otherwise("source unknown")


def lines(selected: DataFrame) -> DataFrame:
    """One line of text for each selected row: its number in the section, its summary and where it comes from."""
    number = F.row_number().over(Window.partitionBy("section").orderBy("chosen", "pos"))
    return selected.withColumn("number", number).withColumn("line", F.format_string("%d. %s (%s, %s)", "number", "summary", "source", role_label(F.col("source_role"))))


def rendered(selected: DataFrame) -> DataFrame:
    """The text of each section, its lines in order. A section holds as many rows as its limit."""
    return lines(selected).groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "line"))), lambda x: x["line"]), "\n").alias("body"))
