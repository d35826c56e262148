"""Raw rows of the three kinds of sources as items, and what later steps need where a stored row lacks it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.values import filled, whole
from ..sources.shared import checkpointed, kept
from . import intel as I
from .vocabulary import Vocabulary


def _taker(rows: DataFrame) -> Callable[..., Column]:
    """The first of some columns that is filled, stripped; columns that the rows do not have are empty."""
    return lambda *names: filled(*[F.col(n).cast("string") for n in names if n in rows.columns]) if any(n in rows.columns for n in names) else F.lit("")


def _number(rows: DataFrame, *names: str) -> Column:
    """The first of some columns that is neither null nor zero, else zero."""
    return F.coalesce(*[F.nullif(F.col(n).try_cast("double"), F.lit(0.0)) for n in names if n in rows.columns], F.lit(0.0))


def laid_out(rows: DataFrame, source: str, label: str = "RSS") -> DataFrame:
    """Raw rows of x, reddit or rss (any other name) as items with one set of columns; topic and pos are the rows' own.

    Character references of texts are decoded; a title and a body are joined by a wide semicolon.
    """
    take = _taker(rows)
    title, body = T.decoded(take("title")), T.decoded(take("text"))
    joined = F.when(body == "", title).otherwise(F.concat(title, F.lit("；"), body))
    host, none = F.coalesce(F.nullif(take("domain"), F.lit("")), T.url_domain(take("url"))), F.lit("")
    if source == "x":
        own = {"source": F.lit("x"), "id": take("id"), "author": take("author"), "text": body, "score": _number(rows, "likes", "views"), "source_domain": T.url_domain(take("url")), "source_label": none}
    elif source == "reddit":
        own = {"source": F.lit("reddit"), "id": take("id", "url"), "author": take("author"), "text": joined, "score": _number(rows, "score", "upvotes"), "source_domain": host, "source_label": F.lit("Reddit"),
               "community": take("subreddit"), "external_url": take("external_url"), "external_domain": T.url_domain(take("external_url"))}
    else:
        feed = F.coalesce(F.nullif(take("feed_name"), F.lit("")), F.lit(label))
        own = {"source": F.lit("rss"), "id": take("id", "url", "title"), "author": feed, "text": joined, "score": F.lit(0.0), "source_domain": host, "source_label": feed}
    own = {"community": none, "external_url": none, "external_domain": none} | own | {"url": take("url"), "created_at": take("created_at")}
    return rows.select("pos", "topic", *[c.alias(n) for n, c in sorted(own.items())])


def topic_records(frames: dict[str, DataFrame], vocabulary: Vocabulary, label: str = "RSS") -> DataFrame:
    """Items of all sources that say something and are relevant to their topic, with what relevance adds.

    The items are written once: relevance reads the text many times, and each would decode it anew.
    """
    items = reduce(DataFrame.unionByName, [laid_out(rows, source, label) for source, rows in frames.items()])
    said = checkpointed(kept(items, ~T.url_only(F.col("text"))))
    return kept(I.with_relevance(said, vocabulary), F.col("relevant"))


def _where_blank(rows: DataFrame, key: str, columns: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    kept = rows.withColumns({f"_kept_{c}": F.col(c) for c in columns})
    blank = T.stripped(F.col(f"_kept_{key}")) == ""
    new = compute(kept)
    return new.withColumns({c: F.when(blank, F.col(c)).otherwise(F.col(f"_kept_{c}")) for c in columns}).drop(*[f"_kept_{c}" for c in columns])


#: What event class, reliability and identity add; the first of each tells whether a row has it.
EVENT = ["topic_event_type", "topic_event_score", "topic_event_matched", "entity_hits", "action_hits", "evidence_hits"]
RELIABILITY = ["source_role", "source_trust_tier", "source_authority_score", "source_discovery_weight", "source_confirmation_weight", "source_confirmed", "source_authority_key"]
IDENTITY = ["identity_key", "identity_terms"]


def hydrated(stored: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Stored rows with event class, reliability and identity; each is computed only where it is blank, whole rows pass.

    A null counts as blank. Identity is computed from what the row holds by then.
    """
    full = F.lit(True)
    for key in (EVENT[0], RELIABILITY[0], IDENTITY[0]):
        full = full & (T.stripped(F.col(key)) != "")
    rows = stored.where(~full)
    with_terms = lambda r: I.with_event_class(I.with_hits(r.withColumn("searchable", T.searchable(F.col("text"), F.col("url"), F.col("community"))), vocabulary), vocabulary).drop("_hits", "searchable")
    rows = _where_blank(rows, EVENT[0], EVENT, with_terms)
    rows = _where_blank(rows, RELIABILITY[0], RELIABILITY, lambda r: I.with_reliability(r, vocabulary))
    rows = _where_blank(rows, IDENTITY[0], IDENTITY, lambda r: I.with_identity(r, vocabulary))
    return stored.where(full).unionByName(rows.select(stored.columns))


def cluster_key() -> Column:
    """A row's cluster, or else its dedupe key."""
    return filled(F.col("cluster_id"), T.dedupe_key(F.col("url"), F.col("source"), F.col("id"), F.col("text")))


def event_group() -> Column:
    """What groups a row's event: its identity, cluster, URL or id, the first that is filled."""
    return filled(F.col("identity_key"), F.col("cluster_id"), F.col("url"), F.col("id"))


def display_text(most: int = 120) -> Column:
    """The text to show: summary, display text, original, text, the first that is filled, shortened."""
    original = T.decoded(filled(F.col("original_text"), F.col("text")))
    return T.shortened(filled(F.col("summary_text"), F.col("display_text"), original), most)


def group_keys(items: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``group_identity``, and for groups without any term the key of their first row's URL, id or first 80 characters of text."""
    own = I.group_identity(items, vocabulary)
    plain = items.select("topic", "cluster_id", F.struct("pos", filled(F.col("url"), F.col("id"), F.substring(T.decoded(T.stripped(F.col("text"))), 1, 80)).alias("term")).alias("_lead"))
    lead = plain.groupBy("topic", "cluster_id").agg(F.min("_lead").alias("_lead")).join(own, ["topic", "cluster_id"], "left_anti")
    terms = F.filter(F.array(F.col("_lead.term")), lambda t: t != "")
    raw = F.concat_ws("|", F.nullif(F.lower(T.stripped(F.col("topic"))), F.lit("")), F.array_join(terms, "|"))
    key = F.when(F.trim(F.regexp_replace(raw, r"^\|+|\|+$", "")) == "", "").otherwise(T.fingerprint(F.regexp_replace(raw, r"^\|+|\|+$", ""), 20))
    return own.unionByName(lead.select("topic", "cluster_id", terms.alias("signature"), key.alias("event_key")))


def coerced_history(rows: DataFrame) -> DataFrame:
    """History rows from loose ones: whole times from 0 on, codes and sources in lower case, blank codes out, level ok where blank.

    ``rows``: run and entry, a struct of captured_at (text), alert_codes, level and source; null entries go.
    """
    low = lambda c: F.lower(T.stripped(c))
    e = rows.where("entry IS NOT NULL").select("run", "entry.*")
    codes = F.filter(F.transform(F.coalesce("alert_codes", F.array().cast("array<string>")), low), lambda x: x != "")
    return e.select("run", whole(F.col("captured_at"), 0).alias("captured_at"), codes.alias("alert_codes"), F.coalesce(F.nullif(low(F.col("level")), F.lit("")), F.lit("ok")).alias("level"), low(F.col("source")).alias("source"))


def task_results(tasks: DataFrame) -> DataFrame:
    """Tasks with their results (JSON texts) summarised in four columns instead; tasks without a status go.

    ``final`` is false where null, ``respect_sent`` as ``final``.
    """
    r = F.from_json("result", "digest_date STRING, counts MAP<STRING, BIGINT>, build_stats STRUCT<timings_ms: MAP<STRING, BIGINT>>")
    none = F.create_map().cast("map<string,bigint>")
    has = F.try_parse_json("result").isNotNull() & (F.size(F.coalesce(F.from_json("result", "map<string,string>"), F.create_map().cast("map<string,string>"))) > 0)
    final = F.coalesce("final", F.lit(False))
    return tasks.withColumns({"status": F.lower(T.stripped(F.col("status"))), "_r": F.when(has, r), "has_result": F.coalesce(has, F.lit(False)), "respect_sent": F.coalesce("respect_sent", final), "final": final}).where("status <> ''").withColumns({
        "result_digest_date": F.coalesce("_r.digest_date", F.lit("")), "result_counts": F.coalesce("_r.counts", none), "result_timings_ms": F.coalesce("_r.build_stats.timings_ms", none)}).drop("_r", "result")
