"""Text and event queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clusters
from ..operators import intel as I
from ..operators import records
from ..operators.vocabulary import Profile, Topic, Vocabulary
from ..sources.frames import table
from ..sources.shared import checkpointed, spread
from .market import rounded

NOW = 1_700_086_400
#: A vocabulary of words of the generated prose.
VOCABULARY = Vocabulary(
    topics={
        "crypto": Topic(["erre", "eran", "thly", "onnd", "erth thnd"], ["erly", "ernd"], ["worthless", "idiot"], ["c1", "c4"], [Profile("listing", ["thor", "erin"], ["thti", "ered"], ["eror"]), Profile("outage", ["attion", "thea"], ["erble"], ["ersh", "erea"])]),
        "world": Topic(["outre", "oure", "aire", "lement"], ["ouier", "enle"], [], ["c2", "c5"], [Profile("talks", ["ouan", "enr"], ["letre", "aich"], ["aioi"]), Profile("storm", ["oument"], ["ouvi", "quer"], ["aique"], ["oueux"])]),
        "hot": Topic(["ensch", "enber", "ener"], ["erte", "entz"], [], ["c3"], [Profile("launch", ["erung", "enlich"], ["erein", "erver"], ["erch"], [], 3.0, False)]),
    },
    tiers={"example.com": 2, "feed1.example.com": 3, "example.org": 1, "news3.example.org": 3, "news5.example.org": 2},
    low_trust=["news5.example.org", "youtube.com"],
    bursts={"ther": 1.2, "thth": 0.7, "ouai": 0.9, "enst": 1.1, "raci": 2.0},
    stopwords=["the", "and", "les", "des", "der", "die", "que", "los"],
    entity_aliases={"erin": "thor", "enr": "ouan"},
    action_aliases={"ered": "thti", "aich": "letre"},
)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items of three sources; one in forty repeats the URL, one in ten the id of an earlier one."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    text = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    m, k = F.when(n % 40 == 20, n - 20).otherwise(n), F.when(n % 10 == 9, n - 3).otherwise(n)
    source = F.when(n % 3 == 0, "x").when(n % 3 == 1, "rss").otherwise("reddit")
    return d.select(
        n.alias("pos"), text("d", k).alias("id"), F.when(F.col("lang") == "en", "crypto").when(F.col("lang") == "fr", "world").when(F.col("lang") == "de", "hot").otherwise("custom").alias("topic"), source.alias("source"),
        text("u", n % 25).alias("author"), "text", F.when(n % 4 == 0, F.concat(text("https://www.site", m % 30), text(".example.com/a", m))).otherwise("").alias("url"),
        F.when(n % 3 == 2, F.concat(text("news", n % 6), F.lit(".example.org"))).otherwise("").alias("external_domain"), F.when(n % 3 == 1, F.concat(text("feed", n % 5), F.lit(".example.com"))).otherwise("").alias("source_domain"),
        F.when(n % 3 == 2, text("c", n % 7)).otherwise("").alias("community"), (n * 37 % 640).cast("double").alias("score"), (1_700_000_000 + n % 1400 * 60).alias("captured_at"), (1_700_000_000 + n % 1400 * 60 - n % 48 * 3600).alias("created_ts"),
    )


ITEMS_SQL = r"""
items AS (SELECT doc_id AS pos, 'd' || CAST(CASE WHEN doc_id % 10 = 9 THEN doc_id - 3 ELSE doc_id END AS VARCHAR) AS id, CASE lang WHEN 'en' THEN 'crypto' WHEN 'fr' THEN 'world' WHEN 'de' THEN 'hot' ELSE 'custom' END AS topic, CASE doc_id % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'rss' ELSE 'reddit' END AS source,
  'u' || CAST(doc_id % 25 AS VARCHAR) AS author, text, CASE WHEN doc_id % 4 = 0 THEN 'https://www.site' || CAST(m % 30 AS VARCHAR) || '.example.com/a' || CAST(m AS VARCHAR) ELSE '' END AS url,
  CASE WHEN doc_id % 3 = 2 THEN 'news' || CAST(doc_id % 6 AS VARCHAR) || '.example.org' ELSE '' END AS external_domain, CASE WHEN doc_id % 3 = 1 THEN 'feed' || CAST(doc_id % 5 AS VARCHAR) || '.example.com' ELSE '' END AS source_domain,
  CASE WHEN doc_id % 3 = 2 THEN 'c' || CAST(doc_id % 7 AS VARCHAR) ELSE '' END AS community, CAST(doc_id * 37 % 640 AS DOUBLE) AS score, 1700000000 + doc_id % 1400 * 60 AS captured_at, 1700000000 + doc_id % 1400 * 60 - doc_id % 48 * 3600 AS created_ts FROM (SELECT *, CASE WHEN doc_id % 40 = 20 THEN doc_id - 20 ELSE doc_id END AS m FROM documents)),
se AS (SELECT *, trim(regexp_replace(regexp_replace(lower(concat_ws(' ', trim(text), url, community)), 'https?://\S+', ' ', 'g'), '\s+', ' ', 'g')) AS searchable FROM items)"""


def _list(terms) -> str:
    return "[" + ", ".join(f"'{t}'" for t in sorted(terms)) + "]" if terms else "CAST([] AS VARCHAR[])"


def _hits(terms, text: str = "searchable") -> str:
    return f"list_filter({_list(terms)}, lambda t: regexp_matches({text}, '(^|[^a-z0-9])' || replace(t, ' ', '\\s+') || CASE WHEN contains(t, ' ') THEN '' ELSE '(s|es)?' END || '($|[^a-z0-9])'))"


def _by_topic(value, otherwise: str) -> str:
    return "CASE topic " + " ".join(f"WHEN '{k}' THEN {value(t)}" for k, t in VOCABULARY.topics.items()) + f" ELSE {otherwise} END"


def _profile(p: Profile) -> str:
    e, a, v, n = (f"len({_hits(x)})" for x in (p.entities, p.actions, p.evidence, p.negative))
    score = f"(2.8 * {e} + 2.2 * {a} + 1.3 * {v} - 2.6 * {n})"
    return f"CASE WHEN {score} >= {p.least} AND ({e} > 0 OR {not p.needs_entity}) AND ({a} > 0 OR {v} > 0) THEN {score} END"


def _event(part) -> str:
    """The value of a part for the best profile: of equal scores the later one."""

    def of(t: Topic) -> str:
        scores = [_profile(p) for p in t.profiles]
        out = part(None)
        for i, p in enumerate(t.profiles):
            better = " AND ".join([f"({scores[i]}) IS NOT NULL"] + [f"({scores[i]}) {'>=' if j < i else '>'} coalesce(({s}), -1)" for j, s in enumerate(scores) if j != i])
            out = f"CASE WHEN {better} THEN {part(p)} ELSE {out} END"
        return out

    return _by_topic(of, part(None))


_HYPE = "(^|[^a-z0-9])(buy now|lfg|100x|altseason|bag|bagged|smart ones|chase later)($|[^a-z0-9])"
_TIER = "greatest(0, " + ", ".join(f"CASE WHEN b = '{d}' OR ends_with(b, '.{d}') THEN {t} ELSE 0 END" for d, t in VOCABULARY.tiers.items()) + ")"
_LOW = ", ".join(f"'{d}'" for d in VOCABULARY.low_trust)
_REL_SQL = f"""
r0 AS (SELECT *, CASE WHEN external_domain <> '' THEN external_domain ELSE source_domain END AS b FROM se),
r1 AS (SELECT *, {_TIER} AS tier FROM r0), r2 AS (SELECT *, source = 'reddit' AND b <> '' AND b NOT IN ({_LOW}) AND tier >= 2 AS linked FROM r1),
r3 AS (SELECT *, CASE WHEN source = 'x' THEN 1 WHEN source = 'rss' THEN greatest(tier, CASE WHEN source_domain <> '' THEN 2 ELSE 1 END) WHEN linked THEN tier ELSE CAST(community <> '' AS INT) END AS source_trust_tier FROM r2),
rel AS (SELECT *, CASE WHEN source = 'x' THEN 'discovery' WHEN source = 'rss' OR linked THEN 'confirmation' ELSE 'community' END AS source_role,
  round(CASE WHEN source = 'x' THEN 0.7 WHEN source = 'rss' THEN 1.0 + 0.6 * source_trust_tier WHEN linked THEN 0.8 + 0.65 * source_trust_tier WHEN community <> '' THEN 0.6 ELSE 0.3 END, 2)::DOUBLE AS source_authority_score,
  round(CASE WHEN source = 'x' THEN 2.6 WHEN source = 'rss' THEN 1.2 WHEN linked THEN 0.7 WHEN community <> '' THEN 0.7 ELSE 0.5 END, 2)::DOUBLE AS source_discovery_weight,
  round(CASE WHEN source = 'x' THEN 0.0 WHEN source = 'rss' THEN 1.2 + 0.45 * source_trust_tier WHEN linked THEN 1.0 + 0.45 * source_trust_tier ELSE 0.0 END, 2)::DOUBLE AS source_confirmation_weight,
  source = 'rss' OR linked AS source_confirmed, CASE WHEN source = 'x' THEN 'x:' || author WHEN source = 'rss' THEN b WHEN linked THEN b WHEN community <> '' THEN 'reddit:' || community ELSE 'reddit' END AS source_authority_key FROM r3)"""
_EMPTY = "CAST([] AS VARCHAR[])"
_EVENT_SQL = f"""
ev AS (SELECT *, {_event(lambda p: f"'{p.code}'" if p else "''")} AS topic_event_type, round({_event(lambda p: _profile(p) if p else "0.0")}, 2)::DOUBLE AS topic_event_score,
  {_event(lambda p: _hits(p.entities) if p else _EMPTY)} AS entity_hits, {_event(lambda p: _hits(p.actions) if p else _EMPTY)} AS action_hits, {_event(lambda p: _hits(p.evidence) if p else _EMPTY)} AS evidence_hits FROM rel)"""
_OVER = "greatest(" + ", ".join(f"len({_hits({*VOCABULARY.topics[t].keywords, *VOCABULARY.topics[t].news})})" for t in I.CORE) + ")"
_CORE = "topic IN ('crypto', 'world')"
_LOW_SQL = r"""(length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\S+', ' ', 'g'), '@[A-Za-z0-9_]{1,32}', ' ', 'g'), '\s+', '', 'g'), '[-—_~`!@#$%^&*()+=\[\]{}|\\:;"''，。！？、,.<>/?]+', '', 'g')) < 8)"""
_RELEVANCE_SQL = f"""
v0 AS (SELECT *, topic_event_type <> '' AS topic_event_matched, {_by_topic(lambda t: f"len({_hits(t.keywords)})", "0")} AS m, {_by_topic(lambda t: f"len({_hits(t.news)})", "0")} AS topic_news_match_count, {_LOW_SQL} AS topic_low_signal,
  {_by_topic(lambda t: f"len({_hits(t.promotion)}) > 0 OR regexp_matches(searchable, '{_HYPE}') OR length(searchable) - length(replace(searchable, '@', '')) >= 3" if t.promotion else "false", "false")} AS topic_promotional,
  {_by_topic(lambda t: f"community <> '' AND list_contains({_list(t.communities)}, community)", "false")} AS community_allowed, CASE WHEN topic = 'hot' THEN {_OVER} ELSE 0 END AS ov, external_domain <> '' AND external_domain NOT IN ({_LOW}) AS ln FROM ev),
v1 AS (SELECT *, topic_news_match_count > 0 AND m >= 2 AS backed FROM v0),
v2 AS (SELECT *, CASE source WHEN 'reddit' THEN community_allowed AND NOT topic_low_signal AND (topic_event_matched OR (source_confirmed AND backed) OR (ln AND backed) OR (m >= 3 AND topic_news_match_count >= 1))
  WHEN 'rss' THEN CASE WHEN {_CORE} THEN topic_event_matched OR (source_confirmed AND backed) ELSE m > 0 OR topic_news_match_count > 0 OR topic_event_matched END
  ELSE (topic_event_matched OR topic_news_match_count > 0 OR m >= 2 OR (m >= 1 AND score >= 200 AND NOT topic_low_signal AND NOT topic_promotional) OR (m >= 1 AND score >= 80 AND regexp_matches(searchable, '(^|[^a-z0-9])(breaking|urgent|just in)($|[^a-z0-9])')))
   AND CASE WHEN topic = 'world' AND NOT topic_event_matched THEN topic_news_match_count >= 1 OR (m >= 3 AND score >= 180 AND NOT topic_low_signal) WHEN topic = 'crypto' AND NOT topic_event_matched THEN topic_news_match_count >= 1 OR (m >= 3 AND score >= 220 AND NOT topic_promotional) ELSE true END END AS gate,
  (topic_low_signal AND NOT community_allowed AND m = 0) OR (source = 'x' AND topic_low_signal AND topic_news_match_count = 0 AND score < 300) OR ov >= 2 OR (topic_promotional AND topic_news_match_count = 0) OR ({_CORE} AND source <> 'x' AND NOT topic_event_matched AND NOT source_confirmed) AS barred FROM v1),
q AS (SELECT *, CASE WHEN topic = 'custom' THEN true ELSE gate AND NOT barred END AS relevant, CASE WHEN topic = 'custom' THEN 0 ELSE m + CAST(community_allowed AS INT) END AS topic_match_count,
  CASE WHEN topic = 'custom' THEN 0.0 ELSE 4.0 * m + CASE WHEN community_allowed THEN 2.0 ELSE 0.0 END + CASE WHEN topic_low_signal THEN 0.0 ELSE 1.2 END + least(length(trim(text)), 240) / 240.0 + 1.35 * topic_event_score + 1.1 * source_authority_score + CASE WHEN source_confirmed THEN 1.6 ELSE 0.0 END
   + 6.0 * topic_news_match_count - CASE WHEN topic_promotional THEN 5.0 ELSE 0.0 END + CASE WHEN source = 'x' THEN least(score, 600.0) / 180.0 - CASE WHEN topic_low_signal THEN 3.0 ELSE 0.0 END - CASE WHEN topic_promotional THEN 6.0 ELSE 0.0 END + CASE WHEN topic_event_matched THEN 1.4 ELSE 0.0 END ELSE 0.0 END END AS topic_quality_score FROM v2)"""
_ALL = f"WITH {ITEMS_SQL},{_REL_SQL},{_EVENT_SQL},{_RELEVANCE_SQL}"


def _alias(x: str, aliases: dict[str, str]) -> str:
    return f"list_transform({x}, lambda t: CASE t " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in aliases.items()) + " ELSE t END)"


def _unique(x: str, most: int | None = None) -> str:
    """Distinct values in order of first place."""
    one = f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"
    return f"({one})[1:{most}]" if most else one


_IDENTITY_SQL = f"""
i0 AS (SELECT *, list_filter(regexp_extract_all(regexp_replace(lower(trim(text)), 'https?://\\S+', ' ', 'g'), '[a-z0-9_]{{3,}}'), lambda t: NOT regexp_full_match(t, '[0-9]+')) AS tk, {_alias("entity_hits", VOCABULARY.entity_aliases)} AS ea, {_alias("action_hits", VOCABULARY.action_aliases)} AS aa, {_alias("evidence_hits", VOCABULARY.action_aliases)} AS va,
  list_filter(string_split_regex(lower(concat_ws(' ', source_domain, external_domain, author)), '[^a-z0-9]+'), lambda t: length(t) >= 3) AS sn FROM q),
i1 AS (SELECT *, {_unique("ea", 3)} AS ents, {_unique("aa", 2)} AS acts, {_unique("va", 2)} AS evs FROM i0),
i2 AS (SELECT pos, unnest(tk) AS t, generate_subscripts(tk, 1) AS p, list_concat({_list([*VOCABULARY.stopwords, *VOCABULARY.entity_aliases, *VOCABULARY.action_aliases])}, sn, [topic, topic_event_type], ents, acts, evs) AS skip FROM i1),
i3 AS (SELECT pos, t, count(*) AS n, min(p) AS p FROM i2 WHERE NOT list_contains(skip, t) GROUP BY pos, t),
i4 AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY n DESC, p) AS rn FROM i3),
i5 AS (SELECT pos, list(t ORDER BY rn) AS ctx FROM i4 WHERE rn <= 2 GROUP BY pos),
i6 AS (SELECT i1.*, list_concat([topic_event_type], ents, acts, coalesce(ctx, {_EMPTY})) AS al FROM i1 LEFT JOIN i5 USING (pos)),
i7 AS (SELECT *, list_filter(al, lambda t, i: t <> '' AND list_position(al, t) = i) AS identity_terms FROM i6),
ident AS (SELECT *, substr(sha1(concat_ws('|', topic, CASE WHEN len(identity_terms) > 0 THEN array_to_string(identity_terms, '|') ELSE '' END)), 1, 16) AS identity_key FROM i7)"""
_BURST = " + ".join(f"CASE WHEN len({_hits([k], 'st')}) > 0 THEN {w} ELSE 0.0 END" for k, w in VOCABULARY.bursts.items())
_RANK_SQL = f"""
dk AS (SELECT *, CASE WHEN url <> '' THEN 'url::' || url ELSE 'id::' || source || '::' || id END AS dedupe_key FROM ident), d1 AS (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY pos) AS dn, count(*) OVER (PARTITION BY topic, dedupe_key) AS window_hits, round((max(captured_at) OVER (PARTITION BY topic, dedupe_key) - min(captured_at) OVER (PARTITION BY topic, dedupe_key)) / 3600.0, 2)::DOUBLE AS window_span_hours FROM dk),
one AS (SELECT * EXCLUDE (dn), identity_key AS cluster_id, trim(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')) AS st FROM d1 WHERE dn = 1 AND relevant),
s0 AS (SELECT *, score AS signal_hot, {_BURST} AS signal_burst, greatest(0.0, 1 - least(greatest(({NOW} - created_ts) / 3600.0, 0.0), 36.0) / 36.0) AS signal_novelty,
  0.55 * CASE source WHEN 'x' THEN 3.4 WHEN 'rss' THEN 2.5 ELSE 1.7 END + source_discovery_weight + 0.75 * source_authority_score + 0.55 * source_confirmation_weight + CASE WHEN topic_event_matched THEN 0.8 ELSE 0.0 END + CASE WHEN source = 'reddit' AND community_allowed THEN 0.2 ELSE 0.0 END AS sw, CAST(source_confirmed AS INT) AS conf FROM one),
s1 AS (SELECT *, row_number() OVER (PARTITION BY topic, cluster_id ORDER BY round(topic_quality_score + signal_burst + signal_novelty + sw, 9) DESC, pos) AS cluster_rank, count(*) OVER (PARTITION BY topic, cluster_id) AS cluster_size FROM s0),
sc AS (SELECT topic, cluster_id, count(DISTINCT source) AS cluster_source_count FROM s0 GROUP BY ALL), s2 AS (SELECT s1.*, cluster_source_count, cluster_source_count - 1 AS signal_cross_count FROM s1 JOIN sc USING (topic, cluster_id)),
s3 AS (SELECT *, cluster_source_count AS event_source_count, CAST(sum(conf) OVER (PARTITION BY topic, cluster_id) AS BIGINT) AS event_confirmation_count FROM s2),
s4 AS (SELECT *, sqrt(signal_hot) + 2.2 * signal_burst + 3.0 * signal_novelty + 4.0 * signal_cross_count + 2.0 * sw + 2.4 * source_authority_score + 3.4 * conf + 0.8 * least(cluster_size, 3) + 1.4 * least(cluster_source_count, 3)
  + CASE WHEN cluster_rank <= 1 THEN 1.4 ELSE greatest(0.0, 1.1 - 0.45 * (cluster_rank - 1)) END + 1.8 * least(window_hits - 1, 6) + least(window_span_hours, 18.0) / 6.0 + CASE WHEN topic_event_matched THEN 4.2 ELSE 0.0 END AS signal_total FROM s3),
s5 AS (SELECT *, round(1.45 * topic_quality_score + signal_total + 1.15 * topic_event_score, 9) AS selection_score FROM s4),
rk AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY selection_score DESC, round(topic_quality_score, 9) DESC, conf DESC, source_authority_score DESC, signal_cross_count DESC, signal_hot DESC, pos) AS place FROM s5),
wide AS (SELECT *, signal_cross_count > 0 OR cluster_source_count > 1 AS wd, event_confirmation_count >= 1 OR signal_cross_count >= 1 OR cluster_source_count >= 2 AS cw FROM rk),
ld AS (SELECT *, source = 'x' AND NOT topic_low_signal AND NOT topic_promotional AND CASE
  WHEN topic = 'crypto' THEN (topic_news_match_count >= 2 OR (topic_news_match_count >= 1 AND (topic_match_count >= 2 OR signal_hot >= 250))) OR (topic_event_matched AND topic_quality_score >= 11 AND (signal_hot >= 50 OR source_authority_score >= 1.4)) OR ((wd OR event_confirmation_count >= 1) AND topic_quality_score >= 12 AND (topic_event_matched OR topic_match_count >= 2 OR topic_news_match_count >= 1 OR signal_hot >= 200)) OR (topic_match_count >= 3 AND topic_quality_score >= 14 AND signal_hot >= 60)
  WHEN topic = 'world' THEN (topic_news_match_count >= 2 OR (topic_news_match_count >= 1 AND (topic_match_count >= 2 OR signal_hot >= 250))) OR (topic_event_matched AND topic_quality_score >= 11.5 AND (source_authority_score >= 1.4 OR signal_hot >= 80)) OR ((wd OR event_confirmation_count >= 1) AND topic_quality_score >= 12 AND (topic_event_matched OR topic_match_count >= 2 OR topic_news_match_count >= 1 OR signal_hot >= 200)) OR (topic_news_match_count >= 1 AND signal_hot >= 120 AND topic_quality_score >= 14) OR (topic_match_count >= 3 AND topic_quality_score >= 14 AND signal_hot >= 150)
  ELSE topic_event_matched OR topic_news_match_count > 0 OR wd OR topic_match_count >= 3 OR (topic_match_count >= 2 AND (signal_hot >= 80 OR topic_quality_score >= 12)) OR topic_quality_score >= 18 END AS lead FROM wide)"""


def _lanes(source: str, by: str, name: str, limit: int) -> str:
    cap = max(1, (3 * limit + 4) // 5)
    return f"""
{name}_a AS (SELECT *, row_number() OVER (PARTITION BY {by}, cluster_id ORDER BY CASE WHEN lead THEN 0 WHEN source <> 'x' THEN 1 ELSE 2 END, place) = 1 AS rep FROM {source}),
{name}_b AS (SELECT *, CASE WHEN rep AND topic_event_matched AND (event_confirmation_count >= 1 OR source_confirmed) THEN 1 WHEN rep AND source = 'x' AND topic_event_matched THEN 2 WHEN rep AND source = 'x' AND lead THEN 3 WHEN rep AND source = 'x' THEN 8 WHEN rep THEN 4 WHEN source <> 'x' THEN 5 WHEN lead THEN 7 ELSE 9 END AS l0 FROM {name}_a),
{name}_c AS (SELECT *, CASE WHEN l0 = 3 AND row_number() OVER (PARTITION BY {by}, l0 ORDER BY place) > {cap} THEN 6 ELSE l0 END AS lane FROM {name}_b),{_first(f"{name}_c", by, name, limit)}"""


def _first(source: str, by: str, name: str, limit: int) -> str:
    return f"""
{name}_d AS (SELECT *, row_number() OVER (PARTITION BY {by}, cluster_id ORDER BY lane, place) AS cn FROM {source}),
{name}_e AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY lane, place) AS chosen FROM {name}_d WHERE cn = 1), {name} AS (SELECT * FROM {name}_e WHERE chosen <= {limit})"""


def relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.with_relevance(spread(items(spark, sf_dir), "pos"), VOCABULARY)


def identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.with_identity(relevant(spark, sf_dir), VOCABULARY)


def candidates(spark: SparkSession, sf_dir: str, tokens: bool = False) -> DataFrame:
    """All items with their key and what their texts tell, the texts left behind; identity and signals are of relevant items only.

    Written once: windows and joins move narrow rows.
    """
    relevance = I.with_relevance(spread(items(spark, sf_dir), "pos"), VOCABULARY, True)
    keyed = relevance.withColumn("dedupe_key", T.dedupe_key(F.col("url"), F.col("source"), F.col("id"), F.col("text"))).drop("searchable")
    read = keyed.withColumns({"text": F.when(F.col("relevant"), F.col("text")), "plain": F.when(F.col("relevant"), F.col("plain")).otherwise(""), "bursts": F.when(F.col("relevant"), F.col("bursts")).otherwise(F.array().cast("array<string>"))})
    out = I.with_signals(I.with_identity(read, VOCABULARY), VOCABULARY, NOW)
    if tokens:
        out = out.withColumn("tokens", T.event_tokens(F.col("text"), VOCABULARY.stopwords))
    return checkpointed(out.drop("text", "plain", "bursts"))


def ranked(spark: SparkSession, sf_dir: str, greedy: bool = False) -> DataFrame:
    """Relevant items, the first of each key with the hits and span of its repeats, clustered by identity or greedily, ranked by topic."""
    repeats, cluster = Window.partitionBy("topic", "dedupe_key"), Window.partitionBy("topic", "cluster_id")
    span = F.round((F.max("captured_at").over(repeats) - F.min("captured_at").over(repeats)) / 3600.0, 2)
    keyed = candidates(spark, sf_dir, greedy).withColumns({"window_hits": F.count(F.lit(1)).over(repeats), "window_span_hours": span})
    one = I.first_of_key(keyed).where("relevant")
    if greedy:
        one = checkpointed(one.withColumn("seed", F.col("topic_quality_score") + I.source_weight() + F.sqrt("signal_hot")))
        named = one.select("topic", "pos", "seed", "tokens", F.col("identity_terms").alias("terms"), F.col("identity_key").alias("key"), F.col("topic_event_type").alias("kind"))
        found = clusters.greedy_clusters(named, ["topic"]).select("pos", F.concat(F.lit("cluster-"), F.col("cluster").cast("string")).alias("cluster_id"))
        one = one.drop("seed", "tokens").join(found, "pos")
    else:
        one = one.withColumn("cluster_id", F.col("identity_key"))
    shaped = I.with_cluster_shape(one)
    shaped = shaped.withColumns({"event_source_count": F.col("cluster_source_count"), "event_confirmation_count": F.sum("signal_confirmation").over(cluster)})
    return I.ranked(checkpointed(I.scored(shaped)), ["topic"])


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked candidates as a table of their own: what follows is planned from it alone."""
    return checkpointed(ranked(spark, sf_dir))


def intel_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.with_reliability(items(spark, sf_dir), VOCABULARY)
    return out.select("pos", "source_role", "source_trust_tier", "source_authority_score", "source_discovery_weight", "source_confirmation_weight", "source_confirmed", "source_authority_key")


def intel_event_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relevant(spark, sf_dir)
    return out.select("pos", "topic_event_type", "topic_event_score", *[F.array_join(c, ",").alias(c) for c in ("entity_hits", "action_hits", "evidence_hits")])


def intel_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relevant(spark, sf_dir).select("pos", "relevant", "topic_match_count", "topic_news_match_count", "topic_low_signal", "topic_promotional", "community_allowed", "topic_quality_score"))


def intel_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(spark, sf_dir).select("pos", F.array_join("identity_terms", "|").alias("terms"), "identity_key")


def intel_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranked(spark, sf_dir).select("topic", "pos", "place", "cluster_rank", "cluster_size", "cluster_source_count", "signal_cross_count", "signal_burst", "signal_novelty", "signal_total", "selection_score"))


def intel_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.first_of_key(items(spark, sf_dir)).select("pos", "dedupe_key")


def intel_sent_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of every fifth item were sent, at times around the cutoff."""
    keyed = I.first_of_key(items(spark, sf_dir))
    sent = keyed.where("pos % 5 = 0").select(F.col("dedupe_key").alias("key"), F.col("captured_at").alias("sent_at"))
    return I.not_sent(keyed, sent, 1_700_030_000).select("pos", "dedupe_key")


def intel_select_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.select_preferred(pool(spark, sf_dir), ["topic"], 10).select("topic", "pos", "lane", "chosen")


def intel_select_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.select_world(pool(spark, sf_dir), ["topic"], 6).select("topic", "pos", "lane", "chosen")


def intel_select_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.select_hot(pool(spark, sf_dir), ["topic"], 8).select("topic", "pos", "lane", "chosen")


def intel_select_persistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.select_persistent(pool(spark, sf_dir), ["topic"], 3).select("topic", "pos", "lane", "chosen")


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pool(spark, sf_dir)
    lanes = [("preferred", I.select_preferred(rows.where("topic = 'crypto'"), ["topic"], 10)), ("world", I.select_world(rows.where("topic = 'world'"), ["topic"], 6)), ("hot", I.select_hot(rows.where("topic = 'hot'"), ["topic"], 8))]
    named = [df.withColumn("lane_name", F.lit(name)) for name, df in lanes]
    return named[0].unionByName(named[1], True).unionByName(named[2], True)


def intel_lane_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.lane_diagnostics(selected(spark, sf_dir))


def intel_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool(spark, sf_dir).select("pos", F.concat_ws(",", I.reason_chips()).alias("reasons"))


def intel_owner_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.owner_quota(pool(spark, sf_dir), 3).select("author", "pos")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool as clusters of snapshots of two hours."""
    return pool(spark, sf_dir).withColumn("cluster_id", F.concat_ws("-", "identity_key", F.floor(F.col("captured_at") / 7200).cast("string")))


def intel_group_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.group_identity(snapshots(spark, sf_dir), VOCABULARY).select("topic", "cluster_id", F.array_join("signature", "|").alias("signature"), "event_key")


def entries(rows: DataFrame) -> DataFrame:
    return I.event_entries(rows, 1_700_050_000)


def intel_event_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    best = F.array_join(F.transform(F.map_entries("representatives"), lambda e: F.concat_ws(":", e["key"], e["value"]["pos"].cast("string"))), ",")
    return entries(snapshots(spark, sf_dir)).select("topic", "cluster_id", "evidence_count", "first_seen_at", "last_seen_at", "confirmation_count", "authority_score", F.array_join("authority_keys", ",").alias("authority_keys"), flat(F.col("source_counts")).alias("source_counts"), best.alias("representatives"))


def intel_merged_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of all snapshots by event key, as items again."""
    rows = snapshots(spark, sf_dir)
    keyed = entries(rows).join(I.group_identity(rows, VOCABULARY).select("topic", "cluster_id", "event_key"), ["topic", "cluster_id"])
    out = I.pool_items(I.merged_entries(keyed))
    return rounded(out.select("topic", "event_key", "snapshot_hits", "event_source_count", "event_confirmation_count", "authority_score", "window_span_hours", "source", "rows"))


def intel_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = items(spark, sf_dir).withColumn("dedupe_key", T.dedupe_key(F.col("url"), F.col("source"), F.col("id"), F.col("text")))
    return I.rolled_up(keyed).withColumn("text", F.sha1(F.col("text").cast("binary")))


def intel_greedy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked items of each topic in greedy clusters (order-dependent, so without SQL)."""
    return rounded(ranked(spark, sf_dir, greedy=True).select("topic", "pos", "cluster_id", "cluster_rank", "cluster_size", "cluster_source_count", "signal_cross_count", "selection_score", "place"))


def fuzzy_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event entries of snapshots in order of time, with the group's signature and the key of the kept entry that each merges into."""
    rows = snapshots(spark, sf_dir)
    keyed = entries(rows).join(I.group_identity(rows, VOCABULARY), ["topic", "cluster_id"])
    placed = checkpointed(I.canonical(keyed.withColumn("captured_at", F.col("last_seen_at"))))
    merged = clusters.fuzzy_merge(placed.select("topic", "event_key", "pos", "signature")).select("pos", "merged_key")
    return placed.join(merged, "pos")


def intel_fuzzy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of all snapshots merged by key or signature (order-dependent, so without SQL)."""
    out = I.united_entries(fuzzy_entries(spark, sf_dir).withColumn("event_key", F.col("merged_key")))
    return rounded(out.select("topic", "event_key", "snapshot_hits", "evidence_count", F.array_join("signature", "|").alias("signature"), F.size("source_counts").alias("sources"), F.size("representatives").alias("rows")))


def intel_united_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of all snapshots by event key: tokens in order of their first place, the best representative of each source, as items."""
    rows = snapshots(spark, sf_dir)
    keyed = entries(rows).join(I.group_identity(rows, VOCABULARY), ["topic", "cluster_id"])
    placed = checkpointed(I.canonical(keyed.withColumn("captured_at", F.col("last_seen_at"))))
    out = I.expanded_entries(I.united_entries(placed))
    return rounded(out.select("topic", "event_key", F.array_join("signature", "|").alias("signature"), "source", F.col("representative.pos").alias("pos"), "event_confirmation_count", "event_authority_score", "event_authority_count"))


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    plain = T.without_html(F.col("html"))
    return p.select("page_id", T.url_domain(F.col("url")).alias("domain"), F.sha1(plain.cast("binary")).alias("plain_sha1"), T.shortened(plain, 80).alias("short"), T.fingerprint(F.col("url")).alias("fingerprint"), T.secret_mask(F.col("url")).alias("masked"), F.sha1(T.escaped(F.col("html")).cast("binary")).alias("escaped_sha1"))


def text_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.low_signal(x).alias("low_signal"), T.url_only(x).alias("url_only"), T.has_han(x).alias("has_han"), T.needs_translation(x).alias("needs_translation"), T.promotional(F.lower(x), ["erin", "thor"]).alias("promotional"))


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(T.chunked(F.col("text"), 1000)).alias("part", "chunk"))


_SHORT = r"CASE WHEN length(x) <= 80 THEN x ELSE rtrim(substr(x, 1, 79)) || '…' END"
_UN = lambda x: f"replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&')"
_WS = r"trim(regexp_replace({x}, '[ \t\n\r\f\x0B]+', ' ', 'g'), ' ')"

def _raw_records(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Documents as raw rows of three sources, each with its own columns and gaps."""
    d, n = spread(table(spark, sf_dir, "documents"), "doc_id"), F.col("doc_id")
    text = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    topic = F.when(F.col("lang") == "en", "crypto").when(F.col("lang") == "fr", "world").when(F.col("lang") == "de", "hot").otherwise("custom").alias("topic")
    url, body = F.concat(text("https://www.site", n % 30), text(".example.com/a", n)), F.when(n % 7 != 0, F.col("text"))
    some = lambda every, x: F.when(n % every != 0, x)
    x = d.where("doc_id % 3 = 0").select(n.alias("pos"), topic, text("d", n).alias("id"), text("u", n % 25).alias("author"), F.when(n % 21 == 0, url).otherwise(F.col("text")).alias("text"), some(4, url).alias("url"), some(2, n * 37 % 640).alias("likes"), (n * 11 % 500).alias("views"))
    rss = d.where("doc_id % 3 = 1").select(n.alias("pos"), topic, some(5, text("d", n)).alias("id"), text("Title ", n).alias("title"), body.alias("text"), url.alias("url"), some(4, text("Desk ", n % 9)).alias("feed_name"), some(5, F.concat(text("feed", n % 5), F.lit(".example.com"))).alias("domain"))
    forum = d.where("doc_id % 3 = 2").select(n.alias("pos"), topic, some(5, text("d", n)).alias("id"), text("u", n % 25).alias("author"), text("Thread ", n).alias("title"), body.alias("text"), url.alias("url"), F.concat(text("https://news", n % 6), F.lit(".example.org/x")).alias("external_url"), some(2, n % 90).alias("score"), (n % 70).alias("upvotes"), text("c", n % 7).alias("subreddit"))
    return {"x": x, "rss": rss, "reddit": forum}


def intel_topic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.topic_records(_raw_records(spark, sf_dir), VOCABULARY, "feed")
    return found.select("pos", "source", "id", "author", "score", "community", "source_domain", "external_domain", "source_label", "topic_match_count", F.length("text").alias("n_text"), F.round("topic_quality_score", 6).alias("quality"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as stored rows, of which some lack their event class, reliability or identity."""
    base, n = I.with_reliability(spread(items(spark, sf_dir), "pos"), VOCABULARY), F.col("pos")
    none = F.array().cast("array<string>")
    event = {"topic_event_type": F.when(n % 2 == 1, "stored"), "topic_event_score": F.lit(1.5), "topic_event_matched": F.lit(True), "entity_hits": none, "action_hits": none, "evidence_hits": none}
    return base.withColumns(event | {"source_role": F.when(n % 5 != 0, F.lit("kept")).otherwise(" "), "identity_key": F.when(n % 6 < 2, "key").otherwise(""), "identity_terms": F.when(n % 6 < 2, F.array(F.lit("kept")))})


def intel_hydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.hydrated(_stored(spark, sf_dir), VOCABULARY).select("pos", "topic_event_type", F.round("topic_event_score", 2).alias("topic_event_score"), "source_role", "identity_key", F.concat_ws("|", "identity_terms").alias("terms"))


def intel_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display texts, cluster keys and event groups of items with gaps."""
    n = F.col("pos")
    gaps = items(spark, sf_dir).withColumns({"summary_text": F.when(n % 4 == 0, F.concat(F.lit(" summary "), n.cast("string"))), "display_text": F.when(n % 3 == 0, F.col("text")).otherwise(" "), "original_text": F.when(n % 5 == 0, "original &amp; first"), "cluster_id": F.when(n % 6 == 0, F.concat(F.lit("c"), n.cast("string"))), "identity_key": F.when(n % 9 == 0, "k")})
    return gaps.select("pos", records.display_text(60).alias("shown"), records.cluster_key().alias("cluster_key"), records.event_group().alias("event_group"))


_TOPIC_SQL = "CASE lang WHEN 'en' THEN 'crypto' WHEN 'fr' THEN 'world' WHEN 'de' THEN 'hot' ELSE 'custom' END"
_RECORDS_SQL = rf"""
rw AS (SELECT doc_id AS pos, doc_id AS n, {_TOPIC_SQL} AS topic, trim(text) AS text, 'https://www.site' || doc_id % 30 || '.example.com/a' || doc_id AS u FROM documents),
items AS (SELECT pos, topic, 'x' AS source, 'd' || n AS id, 'u' || n % 25 AS author, CASE WHEN n % 21 = 0 THEN u ELSE text END AS text, CASE WHEN n % 4 <> 0 THEN u ELSE '' END AS url, '' AS external_domain, CASE WHEN n % 4 <> 0 THEN 'site' || n % 30 || '.example.com' ELSE '' END AS source_domain, '' AS community, '' AS source_label, CAST(CASE WHEN n % 2 <> 0 AND n * 37 % 640 <> 0 THEN n * 37 % 640 ELSE n * 11 % 500 END AS DOUBLE) AS score FROM rw WHERE n % 3 = 0
 UNION ALL SELECT pos, topic, 'rss', CASE WHEN n % 5 <> 0 THEN 'd' || n ELSE u END, CASE WHEN n % 4 <> 0 THEN 'Desk ' || n % 9 ELSE 'feed' END, 'Title ' || n || CASE WHEN n % 7 <> 0 AND text <> '' THEN '；' || text ELSE '' END, u, '', CASE WHEN n % 5 <> 0 THEN 'feed' || n % 5 || '.example.com' ELSE 'site' || n % 30 || '.example.com' END, '', CASE WHEN n % 4 <> 0 THEN 'Desk ' || n % 9 ELSE 'feed' END, 0.0 FROM rw WHERE n % 3 = 1
 UNION ALL SELECT pos, topic, 'reddit', CASE WHEN n % 5 <> 0 THEN 'd' || n ELSE u END, 'u' || n % 25, 'Thread ' || n || CASE WHEN n % 7 <> 0 AND text <> '' THEN '；' || text ELSE '' END, u, 'news' || n % 6 || '.example.org', 'site' || n % 30 || '.example.com', 'c' || n % 7, 'Reddit', CAST(CASE WHEN n % 2 <> 0 AND n % 90 <> 0 THEN n % 90 ELSE n % 70 END AS DOUBLE) FROM rw WHERE n % 3 = 2),
se AS (SELECT *, trim(regexp_replace(regexp_replace(lower(concat_ws(' ', trim(text), url, community)), 'https?://\S+', ' ', 'g'), '\s+', ' ', 'g')) AS searchable FROM items WHERE text <> '' AND NOT regexp_full_match(text, 'https?://\S+'))"""
_HYDRATED_SQL = f"""
q AS (SELECT * REPLACE (CASE WHEN pos % 2 = 1 THEN 'stored' ELSE topic_event_type END AS topic_event_type, CASE WHEN pos % 2 = 1 THEN 1.5 ELSE topic_event_score END AS topic_event_score, CASE WHEN pos % 2 = 1 THEN {_EMPTY} ELSE entity_hits END AS entity_hits, CASE WHEN pos % 2 = 1 THEN {_EMPTY} ELSE action_hits END AS action_hits, CASE WHEN pos % 2 = 1 THEN {_EMPTY} ELSE evidence_hits END AS evidence_hits) FROM ev)"""


QUERIES = {f.__name__: f for f in (intel_topic_records, intel_hydrated, intel_display, intel_reliability, intel_event_class, intel_relevance, intel_identity, intel_rank, intel_dedupe, intel_sent_filter, intel_select_preferred, intel_select_world, intel_select_hot, intel_select_persistent, intel_lane_diagnostics, intel_reasons, intel_owner_quota, intel_group_identity, intel_event_entries, intel_merged_entries, intel_rollup, intel_greedy_clusters, intel_fuzzy_merge, intel_united_entries, text_pages, text_predicates, text_chunks)}

_RANKED = f"{_ALL},{_IDENTITY_SQL},{_RANK_SQL}"
_WORLD = lambda source, name, limit: f"""
{name}_k AS (SELECT *, CASE WHEN cw AND topic_event_matched THEN 1 WHEN cw THEN 2 WHEN topic_event_matched THEN 3 ELSE 4 END AS bucket FROM {source}),{_lanes(f"{name}_k", "topic, bucket", f"{name}_i", limit)},
{name}_p AS (SELECT * EXCLUDE (lane, place, chosen, cn), bucket AS lane, chosen AS place FROM {name}_i),{_first(f"{name}_p", "topic", name, limit)}"""  # noqa: E731
_HOT = lambda source, name, limit: f"""
{name}_h AS (SELECT *, CASE WHEN cw AND topic_event_matched THEN 1 WHEN cw THEN 2 WHEN source = 'rss' THEN 3 WHEN source = 'reddit' THEN 4 WHEN lead THEN 5 ELSE 6 END AS lane FROM {source}),{_first(f"{name}_h", "topic", name, limit)}"""  # noqa: E731
_DIAG = "count(*) AS total, count_if(topic_event_matched)::BIGINT AS event_matched, count_if(event_confirmation_count >= 1 OR source_confirmed)::BIGINT AS confirmed, count_if(source = 'x')::BIGINT AS from_x, count_if(source = 'rss')::BIGINT AS from_rss, count_if(source = 'reddit')::BIGINT AS from_reddit, round(avg(CASE WHEN source_authority_score > 0 THEN source_authority_score END), 2) AS mean_authority"
_DCOLS = "topic_event_matched, event_confirmation_count, source_confirmed, source, source_authority_score"
_K = "rkk AS (SELECT * EXCLUDE (cluster_id), identity_key || '-' || CAST(captured_at // 7200 AS VARCHAR) AS cluster_id FROM rk)"
_GROUP = f"""g1 AS (SELECT topic, cluster_id, topic_event_type, unnest(identity_terms) AS term FROM rkk),
  g2 AS (SELECT topic, cluster_id, CASE WHEN list_contains({_list(VOCABULARY.action_aliases)}, term) THEN 2 WHEN list_contains({_list(VOCABULARY.entity_aliases.values())}, term) THEN 1 ELSE 3 END AS kind, term FROM g1 WHERE term <> topic_event_type OR topic_event_type = '' UNION ALL SELECT topic, cluster_id, 0, topic_event_type FROM rkk WHERE topic_event_type <> ''),
  g3 AS (SELECT topic, cluster_id, kind, term, row_number() OVER (PARTITION BY topic, cluster_id, kind ORDER BY count(*) DESC, term) AS place FROM g2 GROUP BY topic, cluster_id, kind, term),
  g4 AS (SELECT topic, cluster_id, list(term ORDER BY kind, place) AS l FROM g3 WHERE place <= CASE kind WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END GROUP BY ALL), g5 AS (SELECT topic, cluster_id, array_to_string(list_filter(l, lambda t, i: list_position(l, t) = i), '|') AS signature FROM g4),
  g6 AS (SELECT topic, cluster_id, signature, substr(sha1(topic || '|' || signature), 1, 20) AS event_key FROM g5)"""
_ENTRY = f"""{_K},
eb AS (SELECT topic, cluster_id, count(*) AS evidence_count, least(min(created_ts), 1700050000) AS first_seen_at, greatest(max(created_ts), 1700050000) AS last_seen_at, count_if(source_confirmed)::BIGINT AS confirmation_count, round(max(source_authority_score), 2) AS authority_score,
  list_sort(list_distinct(list(source_authority_key) FILTER (WHERE source_confirmed))) AS ak FROM rkk GROUP BY ALL),
ec AS (SELECT topic, cluster_id, source, count(*) AS n, arg_max(pos, {{"a": selection_score, "b": topic_quality_score, "c": signal_hot, "d": -pos}}) AS best FROM rkk GROUP BY ALL),
ed AS (SELECT topic, cluster_id, string_agg(source || ':' || n, ',' ORDER BY source) AS source_counts, string_agg(source || ':' || best, ',' ORDER BY source) AS representatives FROM ec GROUP BY ALL)""".replace('{"a":', "{'a':").replace('"b"', "'b'").replace('"c"', "'c'").replace('"d"', "'d'")

PERSISTENT = f"""ps AS (SELECT *, CASE WHEN event_source_count >= 2 OR cw AND (event_confirmation_count >= 1 OR signal_cross_count >= 1) OR window_span_hours >= 3 THEN 1 ELSE 2 END AS lane FROM ld WHERE NOT topic_low_signal AND NOT topic_promotional AND topic_quality_score >= 10 AND window_hits >= 2
  AND (NOT ({_CORE}) OR topic_event_matched OR event_confirmation_count >= 1) AND (window_span_hours >= 1 OR event_source_count >= 2 OR signal_cross_count >= 1 OR event_confirmation_count >= 1 OR topic_event_matched OR topic_news_match_count >= 1 OR topic_match_count >= 2 OR signal_hot >= 120))"""

ORACLES = {
    "intel_topic_records": f"WITH {_RECORDS_SQL},{_REL_SQL},{_EVENT_SQL},{_RELEVANCE_SQL} SELECT pos, source, id, author, score, community, source_domain, external_domain, source_label, CAST(topic_match_count AS INT) AS topic_match_count, CAST(length(text) AS INT) AS n_text, round(topic_quality_score, 6) AS quality FROM q WHERE relevant",
    "intel_hydrated": f"WITH {ITEMS_SQL},{_REL_SQL},{_EVENT_SQL},{_HYDRATED_SQL},{_IDENTITY_SQL} SELECT pos, topic_event_type, topic_event_score, CASE WHEN pos % 5 <> 0 THEN 'kept' ELSE source_role END AS source_role, CASE WHEN pos % 6 < 2 THEN 'key' ELSE identity_key END AS identity_key, CASE WHEN pos % 6 < 2 THEN 'kept' WHEN len(identity_terms) > 0 THEN array_to_string(identity_terms, '|') ELSE '' END AS terms FROM ident",
    "intel_display": rf"""WITH {ITEMS_SQL}, t AS (SELECT *, trim(regexp_replace(CASE WHEN pos % 4 = 0 THEN 'summary ' || pos WHEN pos % 3 = 0 AND trim(text) <> '' THEN text WHEN pos % 5 = 0 THEN 'original & first' ELSE text END, '\s+', ' ', 'g')) AS s FROM items)
  SELECT pos, CASE WHEN length(s) <= 60 THEN s ELSE rtrim(substr(s, 1, 59)) || '…' END AS shown, CASE WHEN pos % 6 = 0 THEN 'c' || pos WHEN url <> '' THEN 'url::' || url ELSE 'id::' || source || '::' || id END AS cluster_key, CASE WHEN pos % 9 = 0 THEN 'k' WHEN pos % 6 = 0 THEN 'c' || pos WHEN url <> '' THEN url ELSE id END AS event_group FROM t""",
    "intel_reliability": f"WITH {ITEMS_SQL},{_REL_SQL} SELECT pos, source_role, CAST(source_trust_tier AS INT) AS source_trust_tier, source_authority_score, source_discovery_weight, source_confirmation_weight, source_confirmed, source_authority_key FROM rel",
    "intel_event_class": f"WITH {ITEMS_SQL},{_REL_SQL},{_EVENT_SQL} SELECT pos, topic_event_type, topic_event_score, array_to_string(entity_hits, ',') AS entity_hits, array_to_string(action_hits, ',') AS action_hits, array_to_string(evidence_hits, ',') AS evidence_hits FROM ev",
    "intel_relevance": f"{_ALL} SELECT pos, relevant, topic_match_count::INT AS topic_match_count, topic_news_match_count::INT AS topic_news_match_count, topic_low_signal, topic_promotional, community_allowed, round(topic_quality_score, 6) AS topic_quality_score FROM q",
    "intel_identity": f"{_ALL},{_IDENTITY_SQL} SELECT pos, coalesce(array_to_string(identity_terms, '|'), '') AS terms, identity_key FROM ident",
    "intel_rank": f"{_RANKED} SELECT topic, pos, place::INT AS place, cluster_rank::INT AS cluster_rank, cluster_size, cluster_source_count::INT AS cluster_source_count, signal_cross_count::INT AS signal_cross_count, round(signal_burst, 6)::DOUBLE AS signal_burst, round(signal_novelty, 6)::DOUBLE AS signal_novelty, round(signal_total, 6)::DOUBLE AS signal_total, round(selection_score, 6)::DOUBLE AS selection_score FROM rk",
    "intel_dedupe": f"WITH {ITEMS_SQL}, k AS (SELECT pos, CASE WHEN url <> '' THEN 'url::' || url ELSE 'id::' || source || '::' || id END AS dedupe_key FROM items) SELECT min(pos) AS pos, dedupe_key FROM k GROUP BY dedupe_key",
    "intel_sent_filter": f"WITH {ITEMS_SQL}, k AS (SELECT pos, captured_at, CASE WHEN url <> '' THEN 'url::' || url ELSE 'id::' || source || '::' || id END AS dedupe_key FROM items), o AS (SELECT min(pos) AS pos, min_by(captured_at, pos) AS captured_at, dedupe_key FROM k GROUP BY dedupe_key) SELECT pos, dedupe_key FROM o WHERE NOT (pos % 5 = 0 AND captured_at <= 1700030000)",
    "intel_select_preferred": f"{_RANKED},{_lanes('ld', 'topic', 'pf', 10)} SELECT topic, pos, lane, chosen::INT AS chosen FROM pf",
    "intel_select_world": f"{_RANKED},{_WORLD('ld', 'wl', 6)} SELECT topic, pos, lane, chosen::INT AS chosen FROM wl",
    "intel_select_hot": f"{_RANKED},{_HOT('ld', 'ht', 8)} SELECT topic, pos, lane, chosen::INT AS chosen FROM ht",
    "intel_select_persistent": f"{_RANKED}, {PERSISTENT},{_first('ps', 'topic', 'pt', 3)} SELECT topic, pos, lane, chosen::INT AS chosen FROM pt",
    "intel_lane_diagnostics": f"{_RANKED}, lc AS (SELECT * FROM ld WHERE topic = 'crypto'), lw AS (SELECT * FROM ld WHERE topic = 'world'), lh AS (SELECT * FROM ld WHERE topic = 'hot'),{_lanes('lc', 'topic', 'pf', 10)},{_WORLD('lw', 'wl', 6)},{_HOT('lh', 'ht', 8)}, al AS (SELECT 'preferred' AS lane_name, {_DCOLS} FROM pf UNION ALL SELECT 'world', {_DCOLS} FROM wl UNION ALL SELECT 'hot', {_DCOLS} FROM ht) SELECT coalesce(lane_name, 'overall') AS lane_name, {_DIAG} FROM al GROUP BY GROUPING SETS ((lane_name), ())",
    "intel_reasons": f"{_RANKED} SELECT pos, array_to_string(list_filter([CASE WHEN topic_event_matched THEN 'event:' || topic_event_type END, CASE WHEN source_confirmed THEN 'confirmed' END, CASE WHEN signal_cross_count > 0 THEN 'cross:' || signal_cross_count END, CASE WHEN cluster_size > 1 THEN 'cluster:' || cluster_size END, CASE WHEN topic_news_match_count > 0 THEN 'news' END, CASE WHEN signal_hot >= 250 THEN 'engagement' END, CASE WHEN community_allowed THEN 'community' END], lambda x: x IS NOT NULL)[1:6], ',') AS reasons FROM rk",
    "intel_owner_quota": f"{_RANKED}, o AS (SELECT author, pos, row_number() OVER (PARTITION BY author ORDER BY place, pos) AS rn FROM rk) SELECT author, pos FROM o WHERE rn <= 3",
    "intel_event_entries": f"{_RANKED}, {_ENTRY} SELECT topic, cluster_id, evidence_count, first_seen_at, last_seen_at, confirmation_count, authority_score, coalesce(array_to_string(ak, ','), '') AS authority_keys, source_counts, representatives FROM eb JOIN ed USING (topic, cluster_id)",
    "intel_merged_entries": f"""{_RANKED}, {_ENTRY}, {_GROUP}, ek AS (SELECT eb.*, event_key FROM eb JOIN g6 USING (topic, cluster_id)), em AS (SELECT topic, event_key, count(*) AS snapshot_hits, sum(confirmation_count) AS cc, max(authority_score) AS authority_score, min(first_seen_at) AS fs, max(last_seen_at) AS ls FROM ek GROUP BY ALL),
  ea2 AS (SELECT topic, event_key, count(DISTINCT k) AS nk FROM (SELECT topic, event_key, unnest(ak) AS k FROM ek) GROUP BY ALL), es AS (SELECT ek.topic, event_key, source, CAST(sum(n) AS BIGINT) AS rows FROM ec JOIN ek ON ec.topic = ek.topic AND ec.cluster_id = ek.cluster_id GROUP BY ALL), en AS (SELECT topic, event_key, count(*) AS event_source_count FROM es GROUP BY ALL)
  SELECT topic, event_key, snapshot_hits, event_source_count::INT AS event_source_count, CAST(greatest(cc, coalesce(nk, 0)) AS BIGINT) AS event_confirmation_count, round(authority_score, 6) AS authority_score, round((greatest(ls, fs) - fs) / 3600.0, 2)::DOUBLE AS window_span_hours, source, rows FROM es JOIN em USING (topic, event_key) JOIN en USING (topic, event_key) LEFT JOIN ea2 USING (topic, event_key)""",
    "intel_united_entries": f"""{_RANKED}, {_ENTRY}, {_GROUP}, ue AS (SELECT eb.*, event_key, signature, row_number() OVER (ORDER BY last_seen_at, topic, event_key, cluster_id) AS p FROM eb JOIN g6 USING (topic, cluster_id)),
  ut AS (SELECT topic, event_key, token, min(p * 1000 + i) AS f FROM (SELECT topic, event_key, p, unnest(string_split(signature, '|')) AS token, generate_subscripts(string_split(signature, '|'), 1) AS i FROM ue) WHERE token <> '' GROUP BY ALL), us AS (SELECT topic, event_key, string_agg(token, '|' ORDER BY f) AS signature FROM ut GROUP BY ALL),
  ub AS (SELECT ue.topic, event_key, ec.source, rkk.pos, rkk.source_confirmed, rkk.source_authority_key, rkk.source_authority_score, row_number() OVER (PARTITION BY ue.topic, event_key, ec.source ORDER BY selection_score DESC, topic_quality_score DESC, signal_hot DESC, captured_at DESC, p DESC) AS n FROM ue JOIN ec ON ec.topic = ue.topic AND ec.cluster_id = ue.cluster_id JOIN rkk ON rkk.pos = ec.best),
  ur AS (SELECT * FROM ub WHERE n = 1), uk AS (SELECT topic, event_key, count(DISTINCT k) AS keys FROM (SELECT topic, event_key, unnest(ak) AS k FROM ue UNION ALL SELECT topic, event_key, lower(trim(source_authority_key)) FROM ur WHERE source_confirmed) WHERE k <> '' GROUP BY ALL),
  ud AS (SELECT topic, event_key, count_if(source_confirmed) AS sure, max(source_authority_score) AS best FROM ur GROUP BY ALL), um AS (SELECT topic, event_key, sum(confirmation_count) AS cc, max(authority_score) AS score FROM ue GROUP BY ALL)
  SELECT topic, event_key, coalesce(signature, '') AS signature, source, pos, CAST(greatest(cc, coalesce(keys, 0), sure) AS BIGINT) AS event_confirmation_count, round(greatest(score, best), 6) AS event_authority_score, CAST(coalesce(keys, 0) AS INT) AS event_authority_count
  FROM ur JOIN um USING (topic, event_key) JOIN ud USING (topic, event_key) LEFT JOIN us USING (topic, event_key) LEFT JOIN uk USING (topic, event_key)""",
    "intel_group_identity": f"{_RANKED}, {_K}, {_GROUP} SELECT topic, cluster_id, signature, event_key FROM g6",
    "intel_rollup": f"WITH {ITEMS_SQL}, k AS (SELECT *, CASE WHEN url <> '' THEN 'url::' || url ELSE 'id::' || source || '::' || id END AS dedupe_key FROM items) SELECT topic, dedupe_key, count(*) AS window_hits, min(captured_at) AS window_first_seen_at, max(captured_at) AS window_last_seen_at, round((max(captured_at) - min(captured_at)) / 3600.0, 2)::DOUBLE AS window_span_hours, sha1(arg_max(text, [length(trim(text)), -pos])) AS text, min_by(url, pos) FILTER (WHERE url <> '') AS url, min_by(author, pos) AS author, min_by(created_ts, pos) AS created_ts, max(score) AS score FROM k GROUP BY topic, dedupe_key",
    "text_pages": f"""WITH s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS h FROM pages), u AS (SELECT *, {_WS.format(x=_UN("trim(h, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))"))} AS x0 FROM s), x AS (SELECT *, x0 AS x FROM u)
  SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS domain, sha1(x) AS plain_sha1, {_SHORT.replace('x', 'x2', 0)} AS short, substr(sha1(url), 1, 20) AS fingerprint, CASE WHEN length(url) <= 8 THEN repeat('*', length(url)) ELSE substr(url, 1, 4) || repeat('*', length(url) - 8) || right(url, 4) END AS masked,
  sha1(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped_sha1 FROM x""",
    "text_predicates": rf"""SELECT conv_id, turn, length(c) < 8 OR (regexp_matches(text, 'https?://\S+') AND length(c) < 15) AS low_signal, trim(text) = '' OR regexp_full_match(trim(text), 'https?://\S+') AS url_only, regexp_matches(text, '[\x{{4e00}}-\x{{9fff}}]') AS has_han, regexp_matches(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\S+', ' ', 'g'), '@[A-Za-z0-9_]{{1,32}}', ' ', 'g'), '#[^\s#]+', ' ', 'g'), '\pL') AND NOT regexp_matches(text, '[\x{{4e00}}-\x{{9fff}}]') AS needs_translation,
  len({_hits(["erin", "thor"], "lower(text)")}) > 0 OR regexp_matches(lower(text), '{_HYPE}') OR length(text) - length(replace(text, '@', '')) >= 3 AS promotional FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\S+', ' ', 'g'), '@[A-Za-z0-9_]{{1,32}}', ' ', 'g'), '\s+', '', 'g'), '[-—_~`!@#$%^&*()+=\[\]{{}}|\\:;"''，。！？、,.<>/?]+', '', 'g') AS c FROM conversations)""",
}
