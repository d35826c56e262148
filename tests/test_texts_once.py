"""Work on texts is done once for each row, and texts do not travel with what was read from them."""

import random
import re

from pyspark.sql import functions as F

from sluice.functions import text as T
from sluice.operators import digest as D
from sluice.operators import intel as I
from sluice.plans import intel as P


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_do_not_compute_relevance_anew(spark, sf_dir):
    assert len(re.findall(r"altseason\|bag", _plan(P.intel_topic_records(spark, sf_dir)))) == 1
    assert len(re.findall("erth thnd", _plan(D.top_events(P.relevant(spark, sf_dir), ["topic"])))) == len(re.findall("erth thnd", _plan(P.intel_event_class(spark, sf_dir))))


def test_ranked_rows_leave_their_texts_behind(spark, sf_dir):
    assert not {"text", "searchable"} & set(P.ranked(spark, sf_dir).columns)


def test_texts_without_need_are_as_the_plain_patterns_have_them(spark):
    pick = random.Random(3)
    parts = ["a", "bc ", " ", "  ", "\t", "\n", "\r\n", " ", " ", "\x0b", "é", "你好", "&amp;", "&lt;b", "&nbsp;", "&", "http", "https://x.y/z", "http://", "@name", "@" + "n" * 40, "...", "，", "\x85", "word" * 5]
    texts = ["", None, "  ", "\n", *["".join(pick.choices(parts, k=pick.randint(1, 90))) for _ in range(1500)]]
    strip = F.regexp_replace(F.coalesce("t", F.lit("")), r"(?U)^\s+|\s+$", "")
    plain = strip
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(character))
    core = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, T.URL, " "), r"@[A-Za-z0-9_]{1,32}", " "), r"\s+", ""), r"[-—_~`!@#$%^&*()+=\[\]{}|\\:;\"'，。！？、,.<>/?]+", "")
    want = {"stripped": strip, "unescaped": plain, "collapsed": F.trim(F.regexp_replace("t", r"\s+", " ")), "low": (F.length(core) < 8) | (plain.rlike(T.URL) & (F.length(core) < 15)),
            "searchable": F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws(" ", plain)), T.URL, " "), r"\s+", " "))}
    got = {"stripped": T.stripped(F.col("t")), "unescaped": T.unescaped(F.col("t")), "collapsed": T.collapsed(F.col("t")), "low": T.low_signal(F.col("t")), "searchable": T.searchable(F.col("t"))}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[w.eqNullSafe(got[n]).alias(n) for n, w in want.items()])
    assert [r for r in rows.collect() if not all(r[1:])] == []


def test_identity_and_signals_take_what_relevance_read(spark, sf_dir, monkeypatch):
    """The text ends with relevance, and what follows finds the same in the plain form as in the text."""
    monkeypatch.setattr(P, "checkpointed", lambda df: df)
    after = _plan(P.candidates(spark, sf_dir)).split("ArrowEvalPython")[0]
    assert not re.search(r"\btext#", after)
    items = P.items(spark, sf_dir).limit(40).withColumns({"community": F.when(F.col("pos") % 4 < 2, "ther").otherwise(""), "url": F.when(F.col("pos") % 3 == 0, "enst/raci").otherwise("https://a.b/ouai")})
    items = items.withColumn("text", F.when(F.col("pos") % 5 < 3, F.concat(F.lit("Aus \t"), F.substring("text", 1, 60))).otherwise(F.col("text")))
    follow = lambda df: I.with_signals(I.with_identity(df, P.VOCABULARY), P.VOCABULARY, P.NOW).select("pos", "identity_terms", "signal_burst")
    read, plain = (sorted(follow(df).collect()) for df in (I.with_relevance(items, P.VOCABULARY, True), I.with_relevance(items, P.VOCABULARY)))
    assert read == plain and len(read) == 40
