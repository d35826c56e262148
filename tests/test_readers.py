import json

import pytest

from sluice.sources import readers as R


def lines(tmp_path, name, *rows):
    (tmp_path / name).write_text("\n".join(json.dumps(r) for r in rows))
    return str(tmp_path / name)


def test_snapshot_limit_is_kept_between_bounds(spark, tmp_path):
    path = lines(tmp_path, "d.json", {"symbol": "A", "lastUpdateId": 7, "bids": [[str(9000 - i), "1"] for i in range(6000)], "asks": [[str(9001 + i), "1"] for i in range(150)]})
    counted = lambda limit: {r.side: r["count"] for r in R.depth_snapshot_json(spark, path, limit).groupBy("side").count().collect()}
    assert counted(1) == {"bid": 100, "ask": 100} and counted(120) == {"bid": 120, "ask": 120} and counted(9999) == {"bid": 5000, "ask": 150}


def test_wanted_symbols_must_trade(spark, tmp_path):
    tick = {"filterType": "PRICE_FILTER", "tickSize": "0.01"}
    path = lines(tmp_path, "s.json", {"symbol": "AB", "status": "TRADING", "baseAsset": "A", "filters": [tick]}, {"symbol": "CD", "status": "BREAK", "filters": []})
    assert [tuple(r) for r in R.symbol_info_json(spark, path, ["ab", "AB"], with_assets=True).collect()] == [("AB", "A", "USDT", 0.01, 0.0)]
    assert R.symbol_info_json(spark, path).count() == 1
    for wrong, why in (("CD", "not trading: CD"), ("EF", "unknown symbol EF")):
        with pytest.raises(Exception, match=why):
            R.symbol_info_json(spark, path, ["AB", wrong]).collect()


def test_feed_limit_and_tags(spark, tmp_path):
    item = lambda i: f"<item><title>T{i} &amp;amp; x</title>{'<guid> g%d </guid>' % i if i % 2 else ''}<link>https://www.a.org/{i}</link><content:encoded><![CDATA[<b>body</b> {i}]]></content:encoded><dc:date>d{i}</dc:date></item>"
    for f in ("a", "b"):
        (tmp_path / f"{f}.xml").write_text('<rss xmlns:dc="d" xmlns:content="c"><channel>' + "\n".join(map(item, range(20))) + "</channel></rss>")
    got = R.feed_xml(spark, str(tmp_path / "*.xml"), limit=3, name="desk").collect()
    assert len(got) == 6 and {r.id for r in got} == {"https://www.a.org/0", "g1", "https://www.a.org/2"}
    one = next(r for r in got if r.id == "g1")
    assert (one.author, one.title, one.body, one.source_domain, one.created_at) == ("desk", "T1 & x", "body 1", "a.org", "d1")
    assert R.feed_xml(spark, str(tmp_path / "a.xml"), limit=50).count() == 12 and R.feed_xml(spark, str(tmp_path / "a.xml")).count() == 20


def harvested(node):
    """The rule on a parsed document."""
    first = lambda o, *names: next((str(o[n]).strip() for n in names if o.get(n)), "")
    post = lambda o: (first(o, "id", "tweet_id", "rest_id"), first(o, "full_text", "text", "content"), first(o, "url", "permalink"), first(o, "created_at", "time", "date"), first(o, "author", "user", "username"), o.get("likes"))
    if isinstance(node, list) and all(isinstance(x, dict) for x in node):
        return [p for p in map(post, node) if p[0] or p[1] or p[2]]
    out, todo = [], [node]
    while todo:
        x = todo.pop(0)
        if isinstance(x, dict):
            out += [post(x)] if post(x)[1] else []
            todo += x.values()
        elif isinstance(x, list):
            todo += x
    return out


def test_nested_posts_as_the_rule(spark):
    deep = {"content": "d0", "id": 4, "k": [{"text": "d1", "username": "u", "k": {"full_text": "d2", "text": "no", "likes": 3}}, {"a": {"b": {"rest_id": "9", "text": "d3", "time": "t"}}}]}
    docs = [[{"id": "1", "text": "in list", "inner": {"text": "not harvested"}}, {"permalink": "p", "likes": 2}, {"other": 1}], [deep, [deep]], [{"text": "x"}, "plain"], deep, [], {}, 5]
    for doc in docs:
        raw = spark.createDataFrame([(json.dumps(doc),), (None,), ("no json",)], "j string")
        got = sorted((r.id, r.text, r.url, r.created_at, r.author, r.likes or 0) for r in R.nested_posts(raw, "j").collect())
        want = {(p[0], p[1]): p for p in reversed(harvested(doc))}
        assert got == sorted((*p[:5], p[5] or 0) for p in want.values()), doc


def test_documents_that_are_missing_or_broken(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"n": 1,\n "s": "x"}')
    (tmp_path / "b.json").write_text('{"n": 1,')
    got = {r.file[-6:]: r.document and tuple(r.document) for r in R.json_documents(spark, str(tmp_path / "*.json"), "n int, s string").collect()}
    assert got == {"a.json": (1, "x"), "b.json": None}
    none = R.json_documents(spark, str(tmp_path / "none.json"), "n int, s string")
    assert none.count() == 0 and none.select("document.n").columns == ["n"]
