"""Readers of landed files: exchange JSON, forum search JSON, feeds, nested posts. Schemas are declared."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from .shared import checkpointed


def candles_json(spark: SparkSession, path: str, now_ms: int, limit: int = 1000) -> DataFrame:
    """Kline arrays, one JSON line {symbol, rows: [[...]]}: closed candles, the last ``limit`` of each symbol (1 to 1000)."""
    raw = spark.read.schema("symbol STRING, rows ARRAY<ARRAY<STRING>>").json(path)
    one = raw.select("symbol", F.explode("rows").alias("r"))
    typed = one.select("symbol", F.get("r", F.lit(0)).cast("long").alias("open_time"), F.get("r", F.lit(6)).cast("long").alias("close_time"), F.get("r", F.lit(7)).cast("double").alias("quote_volume"), F.get("r", F.lit(8)).cast("long").alias("trade_count"))
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("open_time")))
    return typed.where(F.col("close_time") <= now_ms).withColumn("_n", place).where(F.col("_n") <= min(max(limit, 1), 1000)).drop("_n").withColumn("is_closed", F.lit(True))


def depth_snapshot_json(spark: SparkSession, path: str, limit: int = 1000) -> DataFrame:
    """Order book snapshots {symbol, lastUpdateId, bids, asks} as level updates (symbol, seq, side, price, qty); the first ``limit`` levels of a side (100 to 5000)."""
    raw = spark.read.schema("symbol STRING, lastUpdateId BIGINT, bids ARRAY<ARRAY<STRING>>, asks ARRAY<ARRAY<STRING>>").json(path)
    sides = [raw.select("symbol", F.col("lastUpdateId").alias("seq"), F.lit(side).alias("side"), F.explode(F.slice(column, 1, min(max(limit, 100), 5000))).alias("l")) for side, column in (("bid", "bids"), ("ask", "asks"))]
    return sides[0].unionByName(sides[1]).select("symbol", "seq", "side", F.get("l", F.lit(0)).cast("double").alias("price"), F.get("l", F.lit(1)).cast("double").alias("qty"))


def symbol_info_json(spark: SparkSession, path: str, wanted: list[str] | None = None, with_assets: bool = False) -> DataFrame:
    """Trading symbols with tick and step sizes from their filter lists (0 where there are none), and their two assets if wanted.

    With ``wanted``, one row for each of these symbols: one that is missing or does not trade is an error.
    """
    raw = spark.read.schema("symbol STRING, status STRING, baseAsset STRING, quoteAsset STRING, filters ARRAY<STRUCT<filterType: STRING, tickSize: STRING, stepSize: STRING>>").json(path)
    raw = raw.withColumn("symbol", F.upper("symbol"))
    if wanted is None:
        raw = raw.where("status = 'TRADING'")
    else:
        names = spark.createDataFrame([(w.strip().upper(),) for w in dict.fromkeys(wanted)], "symbol string").distinct()
        raw = names.join(raw, "symbol", "left")
        wrong = F.when(F.col("status").isNull(), F.concat(F.lit("unknown symbol "), "symbol")).when(F.col("status") != "TRADING", F.concat(F.lit("not trading: "), "symbol"))
        raw = raw.withColumn("symbol", F.when(wrong.isNotNull(), F.raise_error(wrong).cast("string")).otherwise(F.col("symbol")))
    last = lambda kind, field: F.coalesce(F.try_element_at(F.filter("filters", lambda f: f["filterType"] == kind), F.lit(-1))[field].try_cast("double"), F.lit(0.0))
    assets = [] if not with_assets else [F.coalesce("baseAsset", F.lit("")).alias("base_asset"), F.coalesce("quoteAsset", F.lit("USDT")).alias("quote_asset")]
    return raw.select("symbol", *assets, last("PRICE_FILTER", "tickSize").alias("tick"), last("LOT_SIZE", "stepSize").alias("step"))


def forum_json(spark: SparkSession, path: str, limit: int = 25) -> DataFrame:
    """Forum search results {data: {children: [{data: {...}}]}} as items."""
    post = "id STRING, title STRING, selftext STRING, author STRING, subreddit STRING, permalink STRING, url STRING, score DOUBLE, created_utc DOUBLE"
    raw = spark.read.schema(f"data STRUCT<children: ARRAY<STRUCT<data: STRUCT<{post.replace(' STRING', ': STRING').replace(' DOUBLE', ': DOUBLE')}>>>>").json(path)
    d = F.col("c.data")
    own = F.col("url").contains("reddit.com") | (F.col("url") == "")
    one = raw.select(F.explode(F.slice("data.children", 1, min(max(limit, 1), 25))).alias("c")).select(*[d[k].alias(k) for k in ("id", "title", "selftext", "author", "subreddit", "permalink", "url", "score", "created_utc")])
    return one.select(
        F.lit("reddit").alias("source"), "id", "author", T.without_html(F.concat_ws(" ", "title", "selftext"), whole=True).alias("text"), F.concat(F.lit("https://www.reddit.com"), "permalink").alias("url"), F.when(own, "").otherwise(F.col("url")).alias("external_url"),
        F.when(own, "").otherwise(T.url_domain(F.col("url"))).alias("external_domain"), F.col("subreddit").alias("community"), F.coalesce("score", F.lit(0.0)).alias("score"), F.col("created_utc").cast("long").alias("created_ts"))


def feed_xml(spark: SparkSession, path: str, row: str = "item", limit: int | None = None, name: str = "") -> DataFrame:
    """Feed entries as items: the first that is filled of alternative tags; with ``limit``, the first entries of each file (1 to 12).

    ``name`` is the feed's, the items' author. Entries without any id take their link or their title.
    """
    names = ["guid", "id", "title", "description", "content:encoded", "atom:summary", "summary", "link", "pubDate", "dc:date", "atom:updated", "updated"]
    raw = spark.read.format("xml").option("rowTag", row).schema(", ".join(f"`{n}` STRING" for n in names)).load(path)
    if limit is not None:
        # a file is read from its start to its end, part after part
        placed = raw.withColumns({"_file": F.input_file_name(), "_at": F.monotonically_increasing_id()})
        place = F.row_number().over(Window.partitionBy("_file").orderBy("_at"))
        raw = placed.withColumn("_n", place).where(F.col("_n") <= min(max(limit, 1), 12))
    first = lambda *tags: F.coalesce(*[F.nullif(T.stripped(F.col(f"`{t}`")), F.lit("")) for t in tags], F.lit(""))
    return raw.select(
        F.lit("rss").alias("source"), first("guid", "id", "link", "title").alias("id"), F.lit(name).alias("author"), T.without_html(first("title"), whole=True).alias("title"), T.without_html(first("description", "content:encoded", "atom:summary", "summary"), whole=True).alias("body"),
        first("link").alias("url"), T.url_domain(first("link")).alias("source_domain"), first("pubDate", "dc:date", "atom:updated", "updated").alias("created_at")).withColumn("text", F.trim(F.concat_ws(" ", "title", "body")))


def tolerant_json(column) -> object:
    """A VARIANT of a text that is JSON, or is JSON from its first bracket on; null otherwise."""
    return F.coalesce(F.try_parse_json(column), F.try_parse_json(F.regexp_extract(column, r"[\{\[][\s\S]*", 0)))


def nested_posts(raw: DataFrame, column: str) -> DataFrame:
    """Posts of a JSON column: id, author, text, url, created_at, likes, retweets; distinct by id and text.

    A document that is a list of objects alone is a list of posts: each with an id, a URL or a text is
    one, and nothing inside it is. Of any other document every object with a text is a post, at any
    depth; each level of nesting is one pass, until no row has a deeper one. Character references are
    decoded. Of equal posts the least nested stays, of those the one that is least in the order of its fields.
    """
    spark = raw.sparkSession

    def spread(rows: DataFrame, sql: str) -> DataFrame:
        name = f"sluice_level_{uuid.uuid4().hex}"
        rows.createOrReplaceTempView(name)
        out = checkpointed(spark.sql(sql.format(name)))
        spark.catalog.dropTempView(name)
        return out

    def posts(rows: DataFrame, depth: int) -> DataFrame:
        pick = lambda *names: F.coalesce(*[F.nullif(T.stripped(F.try_variant_get("v", f"$.{n}", "string")), F.lit("")) for n in names], F.lit(""))
        number = lambda name: F.try_variant_get("v", f"$.{name}", "double")
        return rows.select(pick("id", "tweet_id", "rest_id").alias("id"), pick("author", "user", "username").alias("author"), T.decoded(pick("full_text", "text", "content")).alias("text"), pick("url", "permalink").alias("url"), pick("created_at", "time", "date").alias("created_at"), number("likes").alias("likes"), number("retweets").alias("retweets"), F.lit(depth).alias("_depth"))

    docs = checkpointed(raw.select(F.monotonically_increasing_id().alias("d"), tolerant_json(F.col(column)).alias("v")).where("v IS NOT NULL"))
    entries = spread(docs.where("schema_of_variant(v) LIKE 'ARRAY%'"), "SELECT d, e.value AS v, schema_of_variant(e.value) LIKE 'OBJECT%' AS plain FROM {}, LATERAL variant_explode_outer(v) AS e WHERE e.value IS NOT NULL")
    mixed = entries.groupBy("d").agg(F.bool_and("plain").alias("plain")).where("plain")
    listed = entries.join(mixed.select("d"), "d", "left_semi")
    found = [posts(listed, 0).where("id <> '' OR url <> '' OR text <> ''")]
    level, depth = checkpointed(docs.join(mixed.select("d"), "d", "left_anti")), 0
    while not level.isEmpty():
        found.append(posts(level, depth).where("text <> ''"))
        level, depth = spread(level, "SELECT e.value AS v FROM {}, LATERAL variant_explode_outer(v) AS e WHERE e.value IS NOT NULL AND schema_of_variant(e.value) RLIKE '^(OBJECT|ARRAY)'"), depth + 1
    rest = ["author", "url", "created_at", "likes", "retweets"]
    one = reduce(DataFrame.unionByName, found).groupBy("id", "text").agg(F.min(F.struct("_depth", *rest)).alias("_r"))
    return one.select("id", "_r.author", "text", *[f"_r.{c}" for c in rest[1:]])


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole files as one document each: (file, document), null where the file is no JSON of the schema; a path without files is an empty table."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    found = jvm.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jvm.Path(path))
    if not found:
        return spark.createDataFrame([], f"file string, document struct<{_fields(schema)}>")
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return text.select("file", F.when(F.try_parse_json("value").isNotNull(), F.from_json("value", schema)).alias("document"))


def _fields(schema: str) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields)
