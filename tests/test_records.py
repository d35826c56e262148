import json

from pyspark.sql import functions as F

from sluice.operators import records as R
from sluice.operators.vocabulary import Profile, Topic, Vocabulary

WORDS = Vocabulary(topics={"t": Topic(["alpha", "beta"], ["gamma"], [], ["c"], [Profile("launch", ["acme"], ["ships"], [])])}, tiers={"a.org": 2}, low_trust=[], bursts={}, stopwords=["the"])


def test_layouts_fill_from_other_columns(spark):
    x = spark.createDataFrame([(1, "t", None, "https://www.a.org/1", 0, 7, "fish &amp; chips")], "pos long, topic string, id string, url string, likes long, views long, text string").withColumn("extra", F.lit(1))
    one = R.laid_out(x, "x").head()
    assert (one.source, one.id, one.author, one.text, one.score, one.source_domain, one.community) == ("x", "", "", "fish & chips", 7.0, "a.org", "")
    raw = spark.createDataFrame([(2, "t", "Head", "Body", "https://b.org/2", None), (3, "t", "Head", " ", "", " c.org ")], "pos long, topic string, title string, text string, url string, domain string")
    rss = R.laid_out(raw, "rss", "desk").orderBy("pos").collect()
    assert [(r.id, r.text, r.author, r.source_domain, r.score) for r in rss] == [("https://b.org/2", "Head；Body", "desk", "b.org", 0.0), ("Head", "Head", "desk", "c.org", 0.0)]
    forum = R.laid_out(raw.withColumn("external_url", F.lit("https://www.d.org/x")).withColumn("upvotes", F.lit("12")), "reddit").orderBy("pos").head()
    assert (forum.id, forum.external_domain, forum.score, forum.source_label) == ("https://b.org/2", "d.org", 12.0, "Reddit")


def test_only_relevant_rows_with_text_pass(spark):
    schema = "pos long, topic string, id string, text string, url string"
    rows = [(1, "t", "a", "acme ships the alpha and beta release", ""), (2, "t", "b", "nothing of the kind is said here", ""), (3, "t", "c", "https://a.org/only", ""), (4, "t", "d", None, "")]
    assert [r.pos for r in R.topic_records({"x": spark.createDataFrame(rows, schema)}, WORDS).collect()] == [1]
    assert R.topic_records({"x": spark.createDataFrame([], schema)}, WORDS).count() == 0


def test_hydration_keeps_what_is_there(spark):
    base = spark.createDataFrame([(1, "t", "x", "u", "acme ships alpha today", "", "", "", "")], "pos long, topic string, source string, author string, text string, url string, community string, source_domain string, external_domain string")
    blank = {"topic_event_type": None, "topic_event_score": F.lit(None).cast("double"), "topic_event_matched": F.lit(None).cast("boolean")} | {c: F.lit(None).cast("array<string>") for c in ("entity_hits", "action_hits", "evidence_hits", "identity_terms")}
    blank["topic_event_type"] = F.lit(None).cast("string")
    blank |= {"source_role": F.lit(" "), "source_trust_tier": F.lit(0), "source_authority_score": F.lit(0.0), "source_discovery_weight": F.lit(0.0), "source_confirmation_weight": F.lit(0.0), "source_confirmed": F.lit(False), "source_authority_key": F.lit(""), "identity_key": F.lit(None).cast("string")}
    stored = base.withColumns(blank)
    one = R.hydrated(stored, WORDS).head()
    assert (one.topic_event_type, one.source_role, one.source_authority_key, one.identity_terms) == ("launch", "discovery", "x:u", ["launch", "acme", "ships", "alpha", "today"])
    kept = R.hydrated(stored.withColumns({"topic_event_type": F.lit("old"), "identity_key": F.lit("k")}), WORDS).head()
    assert (kept.topic_event_type, kept.entity_hits, kept.identity_key, kept.identity_terms, kept.source_role) == ("old", None, "k", None, "discovery")
    whole = R.hydrated(stored.withColumns({"topic_event_type": F.lit("old"), "identity_key": F.lit("k"), "source_role": F.lit("r")}), WORDS).head()
    assert (whole.source_role, whole.identity_key) == ("r", "k")


def test_groups_without_terms_take_their_first_row(spark):
    rows = [(1, "t", "g1", "", [], "https://u", "i", "x"), (2, "t", "g1", "", [], "", "", "y"), (3, "t", "g2", "launch", ["launch", "acme"], "", "", "z"), (4, "T ", "g3", "", [], "", "", "w" * 90), (5, "", "g4", "", [], "", "", "")]
    got = {r.cluster_id: r for r in R.group_keys(spark.createDataFrame(rows, "pos long, topic string, cluster_id string, topic_event_type string, identity_terms array<string>, url string, id string, text string"), WORDS).collect()}
    assert got["g1"].signature == ["https://u"] and got["g2"].signature == ["launch", "acme"] and got["g3"].signature == ["w" * 80]
    assert got["g4"].signature == [] and got["g4"].event_key == ""
    import hashlib

    assert got["g1"].event_key == hashlib.sha1(b"t|https://u").hexdigest()[:20] and got["g3"].event_key == hashlib.sha1(b"t|" + b"w" * 80).hexdigest()[:20]


def test_task_results_and_history(spark):
    result = {"digest_date": "2024-01-01", "counts": {"x": 3}, "build_stats": {"timings_ms": {"rank": 5}}}
    tasks = spark.createDataFrame([("1", " DONE", None, True, json.dumps(result)), ("2", "failed", True, None, "not json"), ("3", " ", None, None, None), ("4", "queued", None, None, None), ("5", "done", None, None, "{}")], "id string, status string, final boolean, respect_sent boolean, result string")
    got = {r.id: r for r in R.task_results(tasks).collect()}
    assert set(got) == {"1", "2", "4", "5"} and "result" not in R.task_results(tasks).columns
    assert (got["1"].status, got["1"].final, got["1"].respect_sent, got["1"].has_result, got["1"].result_counts, got["1"].result_timings_ms) == ("done", False, True, True, {"x": 3}, {"rank": 5})
    assert (got["2"].respect_sent, got["2"].has_result, got["2"].result_counts) == (True, False, {}) and not got["5"].has_result
    entry = "struct<captured_at:string, alert_codes:array<string>, level:string, source:string>"
    rows = spark.createDataFrame([(1, ("7.9", [" A", "", None], None, "Web")), (2, None), (3, (None, None, " Warn", None))], f"run long, entry {entry}")
    assert [tuple(r) for r in R.coerced_history(rows).orderBy("run").collect()] == [(1, 7, ["a"], "ok", "web"), (3, 0, [], "warn", "")]


def test_noise_words_are_no_context(spark):
    from dataclasses import replace

    from sluice.operators import intel as I

    row = spark.createDataFrame([("t", "launch", "alpha alpha today update update update", "", "", "", [], [], [])], "topic string, topic_event_type string, text string, source_domain string, external_domain string, author string, entity_hits array<string>, action_hits array<string>, evidence_hits array<string>")
    terms = lambda v: I.with_identity(row, v).head().identity_terms
    assert terms(WORDS) == ["launch", "update", "alpha"] and terms(replace(WORDS, noise=["update"])) == ["launch", "alpha", "today"]
