import html
import random

from pyspark.sql import functions as F

from sluice.functions import text as T


def test_references_as_the_standard_has_them(spark):
    texts = [
        None, "", "plain & simple", "&amp;&lt;&gt;&quot;&#39;&nbsp;x", "&eacute;t&eacute", "&notit; &notin; &not", "&CounterClockwiseContourIntegral;", "&#8364;&#x20AC;&#x20ac", "&#128;&#150;&#x9d;", "&#0;&#xD800;&#1114112;", "&#99999999999999999999999999999999999999999999;", "&#xfffffffffffffffff;",
        "&#1;&#11;&#127;&#xFDD0;&#x1FFFF;|", "&#13;&#10;&#9;", "&bogus; &b;", "&amp;lt;", "&&amp;&", "a &#x1F600; b", "&#x;&#;&;", "tail &copy", "&NotEqualTilde;", "&#x00041;",
    ]
    rng = random.Random(4)
    parts = ["&", "#", "x", "amp", ";", "lt", "12", "eacute", " ", "not", "in", "é", "\n", "8211"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.decoded(F.col("t")).alias("d")).collect()
    assert {r.i: r.d for r in got} == {i: html.unescape(t or "") for i, t in enumerate(texts)}
