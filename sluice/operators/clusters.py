"""Clusters and merges whose every choice depends on those before it: greedy clusters, fuzzy merge.

Both put rows in order, and each row joins what rows before it have become, or founds something
of its own. A group that is small is settled in one task. Larger ones of greedy clusters are settled
block by block: each block's task gets of earlier clusters what its rows may meet. Larger ones of the
fuzzy merge are settled in rounds: from the homes that rows have so far, each row's choice is computed anew, by joins and aggregations over
all rows at once, as if the rows before it were right. After each round at least one more row is
right for good, in truth many are, and homes that a round leaves as they are are the rule's own:
the first row has nothing before it, and each further one stands on rows that are right.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Collection, Hashable, Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import Scratch, checkpointed
from .components import components
from .places import joined_narrow, with_places

#: Rows of a group, and tokens of all of them, that one task may settle.
TASK_ROWS, TASK_TOKENS = 20_000, 2_000_000
#: Values that a block of a larger group may bring, and rows of its order that it has at least.
BLOCK_FACTS, LEAST_ROWS = 1_000_000, 16
#: Rows of an order that one group of a walk along it spans.
STRETCH = 1 << 14


def _sized(rows: DataFrame, group: list[str], tokens: str, task_rows: int) -> DataFrame:
    """Add ``_small``: whether one task may settle the row's group."""
    held = checkpointed(rows.groupBy(*group).agg(((F.count(F.lit(1)) <= task_rows) & (F.sum(F.size(tokens)) <= TASK_TOKENS)).alias("_small")))
    return joined_narrow(rows, held, group)


def _before(steps: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (g, home, ord, ...) with ``size``: the sum of ``added`` over steps (g, home, ord, added) of its home before ord.

    Walks go by stretches of ord, and stretches' sums are carried on, so no task holds a home's history.
    """
    by = ["g", "home"]
    line = steps.withColumn("_asks", F.lit(0)).unionByName(asked.withColumns({"added": F.lit(0).cast("long"), "_asks": F.lit(1)}), True).withColumn("_part", F.floor(F.col("ord") / STRETCH))
    sums = line.groupBy(*by, "_part").agg(F.sum("added").alias("_sum"))
    earlier = F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("added").over(Window.partitionBy(*by, "_part").orderBy("ord", F.desc("_asks")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = line.join(sums.select(*by, "_part", earlier.alias("_earlier")), [*by, "_part"]).withColumn("size", F.col("_earlier") + inside)
    return met.where("_asks = 1").drop("_part", "_earlier", "_asks", "added")


def _since(values: DataFrame, homes: DataFrame) -> DataFrame:
    """(g, home, value, since): the first row that brought each value to its home; ``values``: g, ord, value."""
    return values.join(homes, ["g", "ord"]).groupBy("g", "home", "value").agg(F.min("ord").alias("since"))


def _settled(homes: DataFrame, choose: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """Homes (g, ord, home) that ``choose`` leaves as they are."""
    while True:
        chosen = choose(homes).select("g", "ord", F.col("home").alias("_home"))
        both = scratch.table(homes.join(chosen, ["g", "ord"], "left").withColumn("_home", F.coalesce("_home", "ord")))
        homes = both.select("g", "ord", F.col("_home").alias("home"))
        if both.where("home <> _home").isEmpty():
            return homes


# --- greedy clusters ---


def _nearest(sims: np.ndarray, kin: np.ndarray) -> tuple[int, float]:
    """The place of the cluster that an item is held to be nearest to, and how near, from clusters in the order of their founding.

    The last kindred one (same kind, two common terms) counts as 0.72 at least and yields only to a
    later one that is nearer than all up to it; without any, the first of the most similar.
    """
    start, floor = 0, 0.0
    if kin.any():
        start = int(np.flatnonzero(kin)[-1])
        floor = max(0.72, float(sims[: start + 1].max()))
        later = sims[start + 1 :]
        if not len(later) or later.max() <= floor:
            return start, floor
        start += 1
    at = start + int(sims[start:].argmax())
    return at, float(sims[at])


class _Clusters:
    """Clusters founded so far: what each token and term belongs to, how many tokens each has, its kinds; and what was added since."""

    def __init__(self, known: Iterable[tuple[str, Hashable, int]] = (), sizes: dict[int, int] | None = None) -> None:
        self.index: dict[str, dict[Hashable, set[int]]] = {"token": defaultdict(set), "term": defaultdict(set), "kind": defaultdict(set)}
        self.sizes = dict(sizes or {})
        for what, value, cluster in known:
            self.index[what][value].add(cluster)
        self.added: list[tuple[str, Hashable, int]] = []
        self.touched: set[int] = set()

    def home(self, tokens: Collection, terms: Collection, kind: Hashable, least: float, alone: int = 0) -> int:
        """The cluster that an item joins, or a new one; ``alone``: how many more tokens it has, which no cluster can know."""
        common, common_terms = (Counter(c for x in own for c in self.index[what].get(x, ())) for own, what in ((tokens, "token"), (terms, "term")))
        kinds = self.index["kind"].get(kind, ())
        near = sorted(common.keys() | {c for c, n in common_terms.items() if n >= 2 and c in kinds})
        if near:
            sims = np.array([common[c] / (len(tokens) + alone + self.sizes[c] - common[c]) if common[c] else 0.0 for c in near])
            place, likeness = _nearest(sims, np.array([c in kinds and common_terms[c] >= 2 for c in near], bool))
            c = near[place]
            if likeness >= least or common[c] >= 3 or common_terms[c] >= 2:
                return c
        self.touched.add(new := len(self.sizes))
        self.sizes[new] = 0
        return new

    def put(self, home: int, what: str, values: Iterable[Hashable]) -> None:
        held, before = self.index[what], len(self.added)
        for x in values:
            if home not in held[x]:
                held[x].add(home)
                self.added.append((what, x, home))
        if what == "token":
            self.grow(home, len(self.added) - before)

    def grow(self, home: int, n: int) -> None:
        self.sizes[home] += n
        self.touched.add(home)


def _ordered(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["seed", "pos"], ascending=[False, True])


def _clusters_of_task(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    found, of_key, out = _Clusters(), {}, []
    for r in _ordered(rows).itertuples():
        tokens, terms = set(r.tokens), set(r.terms)
        home = of_key.get(r.key) if r.key else None
        if home is None:
            home = found.home(tokens, terms, r.kind or None, least)
            of_key[r.key] = home
        for what, own in (("token", tokens), ("term", terms), ("kind", {r.kind} - {""})):
            found.put(home, what, own)
        found.added.clear()
        out.append((r.pos, home + 1))
    return pd.DataFrame(out, columns=["pos", "cluster"])


def _facts(items: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(pos, gid, ord, unit) of items, and what each unit brings: (gid, unit, since, what, value, n).

    Rows of a key follow the first of them, whose ord names their unit; others are units of their own.
    A value is told once for a unit (or part of one of very many rows), at its first row, as a number. Tokens that one unit alone has
    are only counted (what ``alone``), other values of one unit left out: no choice can meet them.
    The first row of each unit has an ``alone``, if of none.
    """
    ids = checkpointed(items.groupBy("g").agg(F.count(F.lit(1)).alias("_n")).select("g", F.monotonically_increasing_id().alias("gid")))
    placed = with_places(joined_narrow(items.select("g", "pos", "seed", "key"), ids, ["g"]).drop("g"), ["gid"], [F.desc("seed"), F.asc("pos")], "ord").drop("seed")
    first = placed.where("key <> ''").groupBy("gid", "key").agg(F.min("ord").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    part = F.when(F.col("_rows") > STRETCH, F.floor(F.col("ord") / STRETCH)).otherwise(0)  # no task holds a unit of very many rows
    units = scratch.table(placed.join(first, ["gid", "key"], "left").select("pos", "gid", "ord", F.coalesce("_first", "ord").alias("unit"), part.alias("_part")))
    one = lambda what, values: F.transform(values, lambda v: F.struct(F.lit(what).alias("what"), v.alias("word")))
    flat = F.concat(one("token", F.col("tokens")), one("term", F.col("terms")), one("kind", F.filter(F.array("kind"), lambda v: v != "")))
    by = ["gid", "unit", "_part"]
    near = items.select("pos", "tokens", "terms", "kind").join(units, "pos").repartition(*by)  # lists are dealt, not their values
    told = scratch.table(near.select(*by, "ord", F.explode(flat).alias("x")).select(*by, "ord", "x.*").groupBy(*by, "what", "word").agg(F.min("ord").alias("since")))
    words = told.groupBy("gid", "what", "word").agg(F.count(F.lit(1)).alias("n"))
    words = scratch.table(words.where("n > 1").select("gid", "what", "word", F.monotonically_increasing_id().alias("value")))
    met = told.join(words, ["gid", "what", "word"], "left")
    shared = met.where("value IS NOT NULL").select("gid", "unit", "since", "what", "value", F.lit(0).cast("long").alias("n"))
    rest = met.where("value IS NULL AND what = 'token'").select("gid", "unit", "since", F.lit(1).alias("n")).union(units.where("unit = ord").select("gid", "unit", "ord", F.lit(0)))
    alone = rest.groupBy("gid", "unit", "since").agg(F.sum("n").alias("n")).select("gid", "unit", "since", F.lit("alone").alias("what"), F.lit(0).cast("long").alias("value"), "n")
    return units, scratch.table(shared.union(alone))


def _clusters_in_blocks(items: DataFrame, least: float, task_rows: int, scratch: Scratch) -> DataFrame:
    """(pos, cluster) of items (g, pos, seed, tokens, terms, key, kind) of groups of any size.

    The rule is a chain, so blocks of rows in its order follow one another; those of all groups go
    on side by side. A row whose key is known makes no choice, and a block's task gets numbers only:
    what its rows bring for the first time, and of the clusters before it what that may meet, found
    by a join over all that these know.
    """
    units, facts = _facts(items, scratch)
    bins = facts.groupBy("gid", F.floor(F.col("since") / LEAST_ROWS).alias("_bin")).agg((F.count(F.lit(1)) / F.lit(BLOCK_FACTS) + F.countDistinct("since") / F.lit(max(task_rows, LEAST_ROWS))).alias("_full"))
    full = F.coalesce(F.sum("_full").over(Window.partitionBy("gid").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    blocks = checkpointed(bins.select("gid", "_bin", F.floor(full).alias("block")))
    rows = joined_narrow(facts.withColumn("_bin", F.floor(F.col("since") / LEAST_ROWS)), blocks, ["gid", "_bin"]).drop("_bin")
    rows = scratch.table(rows.repartition("block", "gid").sortWithinPartitions("block", "gid"))

    def settle(block: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        of = {what: list(zip(part["value"].tolist(), part["cluster"].tolist(), strict=True)) for what, part in known.groupby("what")}
        homes, sizes = dict(of.pop("home", [])), {c: n for n, c in of.pop("size", [])}
        found = _Clusters(((what, x, c) for what, pairs in of.items() for x, c in pairs), sizes)
        out, block = [], block.sort_values("since", kind="stable")
        since, what, value, n, unit = (block[c].to_numpy() for c in ("since", "what", "value", "n", "unit"))
        cuts = [0, *(np.flatnonzero(np.diff(since)) + 1).tolist(), len(since)]
        for lo, hi in zip(cuts, cuts[1:]):
            own = {"token": [], "term": [], "kind": [], "alone": []}
            for w, x in zip(what[lo:hi], value[lo:hi].tolist(), strict=True):
                own[w].append(x)
            alone, u = int(n[lo:hi].sum()), int(unit[lo])
            if u == since[lo]:
                homes[u] = found.home(own["token"], own["term"], next(iter(own["kind"]), None), least, alone)
                out.append(("home", u, homes[u]))
            for w in ("token", "term", "kind"):
                found.put(homes[u], w, own[w])
            found.grow(homes[u], alone)
        out += [*found.added, *[("size", found.sizes[c], c) for c in found.touched]]
        return pd.DataFrame([(block["gid"].iloc[0], *x) for x in out], columns=["gid", "what", "value", "cluster"])

    schema, done = "gid long, what string, value long, cluster long", []
    for k in range((blocks.agg(F.max("block")).head()[0] or 0) + 1):
        part = rows.where(F.col("block") == k)
        known = reduce(DataFrame.union, done, items.sparkSession.createDataFrame([], schema))
        wanted = part.where("what <> 'alone'").select("gid", "what", "value").union(part.select("gid", F.lit("home"), "unit")).distinct()
        met = known.where("what <> 'size'").join(wanted, ["gid", "what", "value"], "left_semi").select("gid", "what", "value", "cluster")
        sizes = known.where("what = 'size'").groupBy("gid", "what", "cluster").agg(F.max("value").alias("value")).select("gid", "what", "value", "cluster")  # they only grow
        known = met.union(sizes).join(part.select("gid").distinct(), "gid", "left_semi")  # groups may end before others
        done.append(scratch.table(part.groupBy("gid").cogroup(known.groupBy("gid")).applyInPandas(settle, schema)))
    homes = reduce(DataFrame.union, done).where("what = 'home'").select("gid", F.col("value").alias("unit"), (F.col("cluster") + 1).cast("int").alias("cluster"))
    return units.join(homes, ["gid", "unit"]).select("pos", "cluster")


def greedy_clusters(items: DataFrame, by: list[str], least: float = 0.32, task_rows: int = TASK_ROWS) -> DataFrame:
    """(pos, cluster): clusters that items join in descending ``seed``, ties by pos, or else found.

    ``items``: ``by``, pos, seed, tokens, terms, key, kind; pos is a key. An item whose key a cluster knows
    joins that one. Else it joins the nearest by Jaccard of its tokens with the cluster's united
    ones, if these reach ``least``, share three tokens or two terms. Groups of ``by`` with more than
    ``task_rows`` rows, or very many tokens, are settled block by block. A null key or kind is none;
    null lists are empty ones.
    """
    empty = F.array().cast("array<string>")
    rows = items.select(F.struct(*by).alias("g"), "pos", "seed", F.coalesce("tokens", empty).alias("tokens"), F.coalesce("terms", empty).alias("terms"), F.coalesce("key", F.lit("")).alias("key"), F.coalesce("kind", F.lit("")).alias("kind"))
    with Scratch(items.sparkSession) as scratch:
        rows = _sized(scratch.table(rows), ["g"], "tokens", task_rows)
        settle = lambda frame: _clusters_of_task(frame, least)
        out = rows.where("_small").drop("_small").groupBy("g").applyInPandas(settle, "pos long, cluster int")
        large = rows.where("NOT _small").drop("_small")
        return checkpointed(out if large.isEmpty() else out.union(_clusters_in_blocks(large, least, task_rows, scratch)))


# --- fuzzy merge ---


def mergeable(a: Column, b: Column) -> Column:
    """Whether two signatures name one event: same first token, and one holds the other with 3 or more shared, or 4 shared and Jaccard 0.8."""
    shared = F.size(F.array_intersect(a, b))
    return (F.try_element_at(a, F.lit(1)) == F.try_element_at(b, F.lit(1))) & (((shared >= 3) & (shared == F.least(F.size(a), F.size(b)))) | ((shared >= 4) & (T.jaccard(a, b) >= 0.8)))


def kindred(entries: DataFrame) -> DataFrame:
    """Add ``_group``: entries of one group and topic share a key, or a first token and another one, directly or by way of others.

    Entries of different groups can never merge, whatever their signatures grow to. What entries
    share leads each to the smallest pos that shares it, without pairs; groups are the components.
    """
    rest = F.filter("signature", lambda t: t != F.try_element_at("signature", F.lit(1)))
    shared = F.concat(F.array(F.concat(F.lit("k"), F.coalesce("event_key", F.lit("")))), F.transform(rest, lambda t: F.concat(F.lit("t"), F.try_element_at("signature", F.lit(1)), F.lit("|"), t)))
    nodes = checkpointed(entries.select("topic", "pos", F.explode(F.array_distinct(shared)).alias("node")))
    hubs = nodes.groupBy("topic", "node").agg(F.min("pos").alias("hub"))
    edges = nodes.join(hubs, nodes["topic"].eqNullSafe(hubs["topic"]) & (nodes["node"] == hubs["node"])).select(F.col("pos").alias("a"), F.col("hub").alias("b")).distinct()
    return entries.join(components(edges).select(F.col("id").alias("pos"), F.col("label").alias("_group")), "pos")


def _merged_of_task(rows: pd.DataFrame) -> pd.DataFrame:
    of_key, holders, kept, out = {}, defaultdict(set), [], []
    for r in rows.sort_values("pos").itertuples():
        own = set(r.signature)
        head = r.signature[0] if len(own) else None
        shared = Counter(c for t in own for c in holders[t])
        fits = [c for c, n in shared.items() if kept[c][1] == head and ((n >= 3 and n == min(len(own), len(kept[c][2]))) or (n >= 4 and n >= 0.8 * (len(own) + len(kept[c][2]) - n)))]
        home = min([*fits, *([of_key[r.event_key]] if r.event_key in of_key else [])], default=None)
        if home is None:
            home = len(kept)
            kept.append([r.pos, head, set()])
            of_key.setdefault(r.event_key, home)
        for t in own - kept[home][2]:
            holders[t].add(home)
        kept[home][1] = head if kept[home][1] is None else kept[home][1]
        kept[home][2].update(own)
        out.append((r.pos, kept[home][0]))
    return pd.DataFrame(out, columns=["ord", "home"])


def _merged_in_rounds(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(ord, home) of rows (g, ord, event_key, signature) of groups of any size.

    Which homes a signature may merge into is asked once for all rows that have it, by its rarest
    tokens: a home that holds it, or most of it, has one of these. A home that it holds was opened by
    a part of it, and is found by the rarest token of that. So no row meets all homes of a common token.
    """
    rows = rows.withColumn("own", F.array_distinct("signature"))
    tokens = scratch.table(rows.select("g", "ord", F.explode("own").alias("value")))
    heads = scratch.table(rows.where(F.size("own") > 0).select("g", "ord", F.try_element_at("own", F.lit(1)).alias("head"), F.size("own").alias("opening")))
    often = scratch.table(tokens.groupBy("g", "value").agg(F.count(F.lit(1)).alias("n")))
    told = rows.where(F.size("own") >= 3)
    kinds = scratch.table(told.select("g", "own").distinct().select("g", F.col("own").alias("_own"), F.monotonically_increasing_id().alias("sid")))
    asking = scratch.table(told.join(kinds.withColumnRenamed("_own", "own"), ["g", "own"]).select("g", "ord", "sid", F.size("own").alias("own")))
    sids = scratch.table(kinds.select("g", "sid", F.size("_own").alias("own"), F.try_element_at("_own", F.lit(1)).alias("head"), F.explode("_own").alias("value")).join(often, ["g", "value"]))
    rank = F.row_number().over(Window.partitionBy("g", "sid").orderBy("n", "value"))
    asked = scratch.table(sids.withColumn("rare", rank <= F.floor(F.col("own") / 5) + 1).drop("n"))
    keys = rows.select("g", "ord", "event_key")

    def choose(homes: DataFrame) -> DataFrame:
        founded = homes.where("ord = home").select("g", "home").join(keys.withColumnRenamed("ord", "home"), ["g", "home"])
        of_key = keys.join(founded.groupBy("g", "event_key").agg(F.min("home").alias("at_key")), ["g", "event_key"]).where("at_key < ord").select("g", "ord", "at_key")
        since = scratch.table(_since(tokens, homes))
        steps = since.groupBy("g", "home", F.col("since").alias("ord")).agg(F.count(F.lit(1)).alias("added"))
        first = scratch.table(heads.join(homes, ["g", "ord"]).groupBy("g", "home").agg(F.min(F.struct("ord", "head", "opening")).alias("f")).select("g", "home", "f.*"))
        anchors = first.join(tokens, ["g", "ord"]).join(often, ["g", "value"]).groupBy("g", "home").agg(F.min(F.struct("n", "value"))["value"].alias("value"))
        pairs = asked.where("rare").join(since, ["g", "value"]).select("g", "sid", "head", "home").union(asked.join(anchors, ["g", "value"]).select("g", "sid", "head", "home")).distinct()
        pairs = pairs.join(first.withColumnRenamed("ord", "opened"), ["g", "home", "head"]).drop("head")
        both = pairs.join(asked.select("g", "sid", "own", "value"), ["g", "sid"]).join(since, ["g", "home", "value"])
        shared = both.groupBy("g", "sid", "home", "own", "opening").agg(F.collect_list("since").alias("at"), F.max("since").alias("last"), F.count_if(F.col("since") == F.col("opened")).alias("of_opening"))
        shared = scratch.table(shared.where(F.size("at") >= 3))
        # homes that hold it whole from some row on: of these only one that comes before all that hold it earlier
        sooner = F.min("home").over(Window.partitionBy("g", "sid").orderBy("last", "home").rowsBetween(Window.unboundedPreceding, -1))
        held = shared.where(F.size("at") == F.col("own")).select("g", "sid", "home", "last").withColumn("_sooner", sooner).where("_sooner IS NULL OR home < _sooner")
        holding = asking.join(held, ["g", "sid"]).where("last < ord").select("g", "ord", "home")
        part = shared.where((F.col("of_opening") == F.col("opening")) | ((F.col("own") >= 5) & (F.size("at") >= 0.8 * F.col("own"))))
        met = asking.drop("own").join(part.select("g", "sid", "home", "own", "at"), ["g", "sid"]).withColumn("common", F.size(F.filter("at", lambda x: x < F.col("ord")))).where("common >= 3").drop("at", "sid")
        n, a, b = F.col("common"), F.col("own"), F.col("size")
        near = _before(steps, met).where((n == F.least(a, b)) | ((n >= 4) & (n >= 0.8 * (a + b - n)))).select("g", "ord", "home").union(holding).groupBy("g", "ord").agg(F.min("home").alias("near"))
        return homes.select("g", "ord").join(of_key, ["g", "ord"], "left").join(near, ["g", "ord"], "left").select("g", "ord", F.coalesce(F.least("at_key", "near"), "ord").alias("home"))

    return _settled(rows.select("g", "ord", F.col("ord").alias("home")), choose, scratch).select("ord", "home")


def fuzzy_merge(entries: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """(topic, event_key, pos, merged_key): the first kept entry, in order of ``pos``, that each entry merges into.

    Entries merge by key, or by signature as in ``mergeable``; a kept signature grows by what it
    takes in. ``kindred`` groups are settled apart: small ones by an index of tokens in one task,
    those of more than ``task_rows`` rows in rounds. A null signature is an empty one; ``pos`` is a key.
    """
    rows = entries.select("topic", "event_key", "pos", F.coalesce("signature", F.array().cast("array<string>")).alias("signature"))
    with Scratch(entries.sparkSession) as scratch:
        rows = scratch.table(rows)
        grouped = _sized(scratch.table(kindred(rows)), ["_group"], "signature", task_rows)
        found = grouped.where("_small").select("_group", "pos", "event_key", "signature").groupBy("_group").applyInPandas(_merged_of_task, "ord long, home long")
        large = scratch.table(grouped.where("NOT _small").select(F.col("_group").alias("g"), F.col("pos").alias("ord"), "event_key", "signature"))
        found = scratch.table(found if large.isEmpty() else found.union(_merged_in_rounds(large, scratch)))
        keys = rows.select(F.col("pos").alias("home"), F.col("event_key").alias("merged_key"))
        out = rows.join(found.withColumnRenamed("ord", "pos"), "pos").join(keys, "home").select("topic", "event_key", "pos", "merged_key")
        return checkpointed(out)
