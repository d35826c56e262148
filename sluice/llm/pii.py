"""Personal data spans, from DataFrame functions alone.

Strict patterns with their checks give the base spans of four kinds, which always stay. Wider
generators propose further, overlapping candidates: addresses spelled with "at" and "dot" or
in letters of any script, numbers with other separators, phone numbers without a plus.

Gradient boosted trees tell which of these look like the real ones. Their labels come from
checks alone (Luhn, octets, top level names, lengths, the plus of a phone); their features
are format and context alone, and none of them tells the outcome of a check. A free-standing
wide candidate that passes its own check is unlabelled: for cards and addresses of machines,
whose checks fail often enough to teach, it is only scored; for mail and phones it counts
against the strict ones, so a loose form is taken only where strict ones outnumber it among
candidates alike. The threshold of each kind is calibrated on held-out patterns.

One pass reads the texts and leaves a narrow table of candidates; overlaps are found by
windows over its rows, so a text full of numbers costs n log n. The model is a column
expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, table
from .fingerprint import let

KINDS = ("email", "ip", "card", "phone")
_CHUNK, _PART = 256, 4096
_LOCAL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++"
#: A cheap test that a text can hold a match, and the pattern. All loops are possessive or of
#: one character class or short, so that very long texts neither backtrack nor recurse.
BASE = {
    "email": ("@", _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9][0-9 -]{12}", r"[0-9](?:[ -]?+[0-9]){12,}+"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
}
_AT, _DOT = r"(?:@| ?[\[({][Aa][Tt][\])}] ?| at )", r"(?: ?[\[({][Dd][Oo][Tt][\])}] ?| dot |\. ?)"
_POINT = r"(?: ?[\[({]\.[\])}] ?| ?\. ?|[,_-])"
WIDE = {
    "email": (r"@|[\[({][Aa][Tt][\])}]| at ", r"(?:(?<![\p{L}\p{N}._%+-])|\G)[\p{L}\p{N}._%+-]++" + _AT + r"[\p{L}\p{N}-]++(?:" + _DOT + r"[\p{L}\p{N}-]++)++"),
    "ip": (r"[0-9](?: ?[\[({]?\.|[,_-][0-9])", rf"(?<![0-9.])[0-9]{{1,3}}(?:{_POINT}[0-9]{{1,3}}){{3}}(?![0-9.])"),
    "card": (r"[0-9][ ./_-]{0,2}[0-9]{2}[ ./_-]{0,2}[0-9]", r"(?<![0-9])[0-9](?:[ ./_-]{0,2}+[0-9]){11,}+"),
    "phone": (r"[0-9]\)?[ ./-]{1,2}\(?[0-9]", r"(?<![0-9+.])\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![0-9])"),
}
#: Words before a candidate, by what they speak of.
CUES = ("tel|phone|call|fax|mobile|appel|anruf", "mail|contact|write|schreib", "ip|host|server|addr|login", "card|visa|pay|account|konto|compte|cuenta|tarjeta|karte|carte", "order|ref|version|build|isbn|id|no|nr|date|serial")
#: How often a number without meaning passes the check of its kind; None where the check is too weak to teach.
CHANCE = {"email": None, "ip": 0.3, "card": 0.1, "phone": None}
FEATURES = ("cue", "digits", "last", "prior", "bracket", "name", "labels", "capital", "before", "after", "near")
_SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, y: a + y)


def _upto(values: Column, whole: Callable[[Column], Column], body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``body`` of a function i -> whole(the first i values), which looks at 256 values and at the sums of earlier chunks."""
    chunk = lambda i: F.floor(i / _CHUNK).cast("int")
    return let(values, lambda v: let(
        F.transform(F.sequence(F.lit(0), chunk(F.size(v))), lambda c: whole(F.slice(v, c * _CHUNK + 1, _CHUNK))),
        lambda sums: body(lambda i: whole(F.array(whole(F.slice(sums, 1, chunk(i))), whole(F.slice(v, chunk(i) * _CHUNK + 1, i % _CHUNK))))),
    ))


def found(text: Column, test: str, pattern: str) -> Column:
    """Matches of a pattern with code point positions, the 24 characters before and the one after."""

    def of(matches: Column, pieces: Column) -> Column:
        lengths = F.transform(matches, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))
        return _upto(lengths, _total, lambda before: F.transform(matches, lambda m, i: let(
            before(i) + F.length(F.get(pieces, i)),
            lambda at: F.struct(at.alias("start"), (at + F.length(m)).alias("end"), m.alias("value"), F.right(F.get(pieces, i), F.lit(24)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(1)).alias("after")),
        )))

    spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(F.split(text, pattern, -1), lambda p: of(m, p)))
    return F.when(text.rlike(test), spans).otherwise(F.array().cast(_SPAN))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The Luhn check of a string of digits."""

    def weight(i: Column, n: Column) -> Column:
        d = F.substr(number, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), lambda a, i: a + weight(i, F.length(number))) % 10 == 0


def domain_labels(value: Column) -> Column:
    """The labels of a mail address' domain, however at and dot are spelled."""
    domain = F.regexp_replace(value, "^.*?" + _AT, "")
    return F.split(F.regexp_replace(domain, _DOT, "."), r"\.")


def checked(kind: str, value: Column) -> Column:
    """Whether a candidate's value passes the check of its kind; strict mail addresses stay whatever it says."""
    if kind == "ip":
        parts = F.filter(F.split(value, "[^0-9]+"), lambda p: p != "")
        return F.forall(parts, lambda p: F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255).otherwise(F.lit(False)))
    if kind == "card":
        return let(digits(value), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return named_top(value)


def named_top(value: Column) -> Column:
    return F.coalesce(F.try_element_at(domain_labels(value), F.lit(-1)).rlike(r"^\p{L}{2,}$"), F.lit(False))


def _class(c: Column) -> Column:
    """0 none, 1 space, 2 letter, 3 digit, 4 quote or bracket, 5 other."""
    return F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^\p{L}"), 2).when(c.rlike("^[0-9]"), 3).when(c.rlike("^[\"'`(\\[{<]"), 4).otherwise(5)


def of_kind(*pairs: tuple[str, Column], otherwise: Column) -> Column:
    """A value by the row's kind."""
    return reduce(lambda acc, kv: F.when(F.col("kind") == KINDS.index(kv[0]), kv[1]).otherwise(acc), pairs, otherwise)


def described(rows: DataFrame) -> DataFrame:
    """Add the features of candidates, small whole numbers with bounded values; none tells a check's outcome."""
    value, before, zero = F.col("value"), F.col("before"), F.lit(0)
    rows = rows.withColumn("_groups", F.filter(F.split(value, "[^0-9]+"), lambda g: g != ""))
    size = lambda i: F.coalesce(F.least(F.length(F.try_element_at("_groups", F.lit(i))), F.lit(6)), zero)
    mail = lambda x: of_kind(("email", x), otherwise=zero)
    number = lambda x: of_kind(("ip", x), ("phone", x), otherwise=zero)  # noqa: E731  # how a card's digits are grouped tells nothing
    local = F.regexp_extract(value, r"^[^@\[({ ]+", 0)
    length = F.least(F.length(digits(value)), F.lit(20))
    cue = reduce(lambda acc, kv: F.when(before.rlike(rf"(?i)(?<!\p{{L}})(?:{kv[1]})\p{{L}}{{0,6}}[^\p{{L}}0-9]{{0,4}}$"), kv[0] + 1).otherwise(acc), reversed(list(enumerate(CUES))), zero)
    return rows.withColumns({
        "digits": of_kind(("card", length), ("ip", length), otherwise=zero),
        "last": number(size(-1)),
        "prior": number(size(-2)),
        "bracket": of_kind(("phone", value.contains("(").cast("int")), otherwise=zero),
        "name": mail(local.rlike("[0-9]").cast("int") + 2 * local.rlike("[._+-]").cast("int")),
        "labels": mail(F.least(F.size(domain_labels(value)), F.lit(5))),
        "capital": mail(F.regexp_replace(value, "^.*?" + _AT, "").rlike(r"\p{Lu}").cast("int")),
        "before": _class(F.right(before, F.lit(1))),
        "after": _class(F.col("after")),
        "cue": cue,
    }).drop("_groups")


def may_hold(text: Column) -> Column:
    """A cheap test that is true for every text with a candidate."""
    return reduce(lambda a, b: a | b, [F.coalesce(text, F.lit("")).rlike(t) for t, _ in (*BASE.values(), *WIDE.values())])


def candidates(text: Column) -> Column:
    """All candidates of a text, as one array: start, end, value, before, after, kind, wide."""
    whole = F.coalesce(text, F.lit(""))

    def of(kind: str, wide: bool, patterns: tuple[str, str]) -> Column:
        return F.transform(found(whole, *patterns), lambda x: F.struct(*[x[c].alias(c) for c in ("start", "end", "value", "before", "after")], F.lit(KINDS.index(kind)).alias("kind"), F.lit(wide).alias("wide")))

    return F.concat(*[of(kind, wide, patterns[kind]) for wide, patterns in ((False, BASE), (True, WIDE)) for kind in KINDS])


def keys(doc_id: str | None, text: str) -> tuple[Column, Column]:
    """128 bits that stand for a row's id and text; rows that agree in both have the same spans."""
    own = [F.col(doc_id), F.col(text)] if doc_id else [F.col(text)]
    return F.xxhash64(*own), F.xxhash64(F.lit("spans"), *own)


@dataclass(frozen=True)
class Found:
    """``rows``: k1, k2, any (whether the text has candidates) and the columns asked for; ``candidates``: see ``spot``."""

    rows: DataFrame
    candidates: DataFrame


def spot(documents: DataFrame, text: str = "text", doc_id: str | None = "doc_id", keep: tuple[str, ...] = ()) -> Found:
    """One pass over the texts: their candidates as rows (k1, k2, start, end, base, label, features).

    label is 1 or 0 where a check teaches it, -1 for a wide candidate that stands free and passes
    its check. Wide candidates that repeat a strict one or overlap a base span of their own kind
    are left out: such a form may well be right where it stands free. ``near`` is 2 if a base
    span of another kind lies within 200 characters, 1 if the text has one, else 0.
    """
    k1, k2 = keys(doc_id, text)
    kept = checkpointed(documents.select(*[F.col(c) for c in keep], k1.alias("k1"), k2.alias("k2"), candidates(F.col(text)).alias("c")))
    rows = kept.where(F.size("c") > 0).groupBy("k1", "k2").agg(F.first("c").alias("c")).select("k1", "k2", F.explode("c").alias("c")).select("k1", "k2", "c.*")
    passes = of_kind(*[(kind, checked(kind, F.col("value"))) for kind in KINDS], otherwise=F.lit(False))
    loose = F.col("wide") & (F.col("kind") == KINDS.index("phone")) & F.length(digits(F.col("value"))).between(7, 15)  # no country's digits
    rows = rows.withColumn("_check", passes | loose).withColumn("base", ~F.col("wide") & (F.col("_check") | (F.col("kind") == KINDS.index("email"))))
    own = Window.partitionBy("k1", "k2")
    upto = own.orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    beyond = own.orderBy("start").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    nearest = {}
    for i, kind in enumerate(KINDS):
        its = F.col("base") & (F.col("kind") == i)
        nearest[f"_l_{kind}"], nearest[f"_r_{kind}"] = F.max(F.when(its, F.col("end"))).over(upto), F.min(F.when(its, F.col("start"))).over(beyond)
    rows = rows.withColumns(nearest)
    other = lambda side, pick: pick(*[F.when(F.col("kind") != i, F.col(f"_{side}_{k}")) for i, k in enumerate(KINDS)])
    same = lambda side: F.coalesce(*[F.when(F.col("kind") == i, F.col(f"_{side}_{k}")) for i, k in enumerate(KINDS)])
    meets = lambda left, right: F.coalesce(left > F.col("start"), F.lit(False)) | F.coalesce(right < F.col("end"), F.lit(False))
    rows = rows.withColumns({"_ol": other("l", F.greatest), "_or": other("r", F.least), "_within": meets(same("l"), same("r"))})
    close = F.coalesce(F.col("start") - F.col("_ol") <= 200, F.lit(False)) | F.coalesce(F.col("_or") - F.col("end") <= 200, F.lit(False))
    near = F.when(close, 2).when(F.coalesce("_ol", "_or").isNotNull(), 1).otherwise(0)
    label = F.when(~F.col("wide"), F.col("_check").cast("int")).when(~F.col("_check"), 0).when(meets(F.col("_ol"), F.col("_or")), 0).otherwise(-1)
    rows = rows.withColumns({"near": near, "label": label})
    twin = F.min("wide").over(Window.partitionBy("k1", "k2", "kind", "start", "end"))
    rows = rows.withColumn("_twin", twin).where(~F.col("wide") | (F.col("_twin") & ~F.col("_within")))
    return Found(kept.withColumn("any", F.size("c") > 0).drop("c"), checkpointed(described(rows).select("k1", "k2", "start", "end", "kind", "base", "label", *FEATURES)))


@dataclass(frozen=True)
class Boosted:
    """The trees of one kind: each is (feature, limit, low, high), where low and high are such tuples or leaf values."""

    prior: float = 0.0
    trees: tuple = ()
    threshold: float = 2.0

    def score(self) -> Column:
        """The probability as an expression over the feature columns."""

        def of(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            feature, limit, low, high = tree
            return F.when(F.col(feature) <= limit, of(low)).otherwise(of(high))

        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, [of(t) for t in self.trees], F.lit(self.prior))))

    def used(self) -> set[str]:
        """The features that the trees split on."""
        out, todo = set(), list(self.trees)
        while todo:
            tree = todo.pop()
            if isinstance(tree, tuple):
                out.add(tree[0])
                todo += tree[2:]
        return out


#: A model is a ``Boosted`` for each kind; this one adds nothing.
NOTHING = tuple(Boosted() for _ in KINDS)


def boost(x: np.ndarray, share: np.ndarray, weight: np.ndarray, rounds: int, depth: int, rate: float) -> tuple[float, tuple, np.ndarray]:
    """(prior, trees, score of every pattern) of trees boosted on patterns with a share of positives and a weight."""
    mean = np.clip((weight * share).sum() / max(weight.sum(), 1e-9), 0.01, 0.99)
    prior = float(np.log(mean / (1 - mean)))
    score, trees, everything = np.full(len(x), prior), [], np.ones(len(x), bool)

    def grow(rows: np.ndarray, level: int, g: np.ndarray, h: np.ndarray):
        best = (1e-6, None)
        if level:
            for j in range(x.shape[1]):  # of equal gains the first feature's counts
                for limit in np.unique(x[rows, j])[:-1]:
                    low = rows & (x[:, j] <= limit)
                    high = rows & ~low
                    gain = sum(g[r].sum() ** 2 / (h[r].sum() + 1) for r in (low, high)) - g[rows].sum() ** 2 / (h[rows].sum() + 1)
                    if gain > best[0] + 1e-9:
                        best = (gain, (j, int(limit), low, high))
        if best[1] is None:
            return rate * float(g[rows].sum() / (h[rows].sum() + 1))
        j, limit, low, high = best[1]
        return (FEATURES[j], limit, grow(low, level - 1, g, h), grow(high, level - 1, g, h))

    def apply(tree, rows: np.ndarray) -> None:
        if not isinstance(tree, tuple):
            score[rows] += tree
            return
        name, limit, low, high = tree
        under = x[:, FEATURES.index(name)] <= limit
        apply(low, rows & under)
        apply(high, rows & ~under)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(everything, depth, weight * (share - p), weight * p * (1 - p)))
        apply(trees[-1], everything)
    return prior, tuple(trees), 1 / (1 + np.exp(-score))


def fit(x: np.ndarray, counts: np.ndarray, chance: float | None, rounds: int = 40, depth: int = 4, rate: float = 0.3, folds: int = 4, precision: float = 0.85, least: float = 0.5) -> Boosted:
    """Boosted trees of one kind from feature patterns and their ``counts`` (label 1, label 0, unlabelled).

    The threshold comes from scores that each fold of the patterns gets from trees of the other
    folds: it lies below the lowest score from which the patterns are right often enough. Where
    a check passes by ``chance`` at a known rate, the share of lucky ones follows from those that
    fail it; elsewhere the strict must make up ``least`` of all, unlabelled ones included.
    """
    positive, negative = counts[:, 0], counts[:, 1] + (counts[:, 2] if chance is None else 0)
    total = positive + negative
    if not positive.sum():
        return Boosted()
    share, weight = positive / np.maximum(total, 1), np.sqrt(total)  # a frequent pattern does not drown the others
    fold, p = np.random.default_rng(5).permutation(len(x)) % folds, np.zeros(len(x))
    for k in range(folds):
        p[fold == k] = boost(x, share, np.where(fold == k, 0.0, weight), rounds, depth, rate)[2][fold == k]

    def right(rows: np.ndarray) -> bool:
        yes, no = positive[rows].sum(), negative[rows].sum()
        return bool(yes) and (yes >= least * (yes + no) if chance is None else yes - no * chance / (1 - chance) >= precision * yes)

    own = total > 0
    good = [t for t in np.unique(p[own]) if right(own & (p >= t))]
    prior, trees, _ = boost(x, share, weight, rounds, depth, rate)
    if not good:
        return Boosted(prior, trees)
    below = p[own & (p < good[0])].max(initial=0.0)  # halfway between the lowest good score and the next lower one
    return Boosted(prior, trees, max(0.3, float(good[0] + below) / 2))


def train(found: Found) -> tuple[Boosted, ...]:
    """Learn from the candidates of all documents, as counts by kind and feature pattern; reruns agree.

    Features take few values, so there are at most some ten thousand patterns on any corpus.
    """
    count = lambda v: F.count_if(F.col("label") == v)
    rows = sorted(tuple(r) for r in found.candidates.groupBy("kind", *FEATURES).agg(count(1), count(0), count(-1)).collect())
    values = np.array(rows, float).reshape(-1, len(FEATURES) + 4)
    own = [values[values[:, 0] == k, 1:] for k in range(len(KINDS))]
    return tuple(fit(v[:, :-3], v[:, -3:], CHANCE[kind]) for kind, v in zip(KINDS, own, strict=True))


def select(found: Found, model: tuple[Boosted, ...]) -> DataFrame:
    """(k1, k2, base, spans): sorted arrays of (kind, start, end), kinds by place in KINDS, for each text that has any.

    Added spans reach their kind's threshold and overlap no base span; of added spans that overlap,
    those that begin first, or are longer, stay.
    """
    passes = of_kind(*[(kind, m.score() >= m.threshold) for kind, m in zip(KINDS, model, strict=True)], otherwise=F.lit(False))
    rows = found.candidates.where(F.col("base") | ((F.col("label") == -1) & passes))
    ahead = Window.partitionBy("k1", "k2", "base").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_reach", F.max("end").over(ahead)).where(F.col("base") | F.col("_reach").isNull() | (F.col("_reach") <= F.col("start")))
    span = F.struct("kind", "start", "end")
    return rows.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans"))


_NONE = "array<struct<kind:int,start:int,end:int>>"


def attach(rows: DataFrame, spans: DataFrame, some: Column, k: tuple[Column, Column], names: tuple[str, str]) -> DataFrame:
    """``rows`` with the arrays of ``select`` under ``names``; rows where ``some`` is false have no candidates and are not shuffled."""
    here = tuple(fresh(rows, "k1", "k2"))
    named = spans.select(F.col("k1").alias("_s1"), F.col("k2").alias("_s2"), F.col("base").alias("_s3"), F.col("spans").alias("_s4"))
    with_key = rows.where(some).select(F.struct("*").alias("row"), k[0].alias(here[0]), k[1].alias(here[1]))
    joined = with_key.join(named, (F.col(here[0]) == F.col("_s1")) & (F.col(here[1]) == F.col("_s2")), "left")
    hit = joined.select("row", *[F.coalesce(c, F.array().cast(_NONE)).alias(n) for c, n in (("_s3", "_b"), ("_s4", "_a"))])
    rest = rows.where(~some).select(F.struct("*").alias("row"), F.array().cast(_NONE).alias("_b"), F.array().cast(_NONE).alias("_a"))
    both = hit.unionByName(rest)
    return both.select(*[F.col("row")[c].alias(c) for c in rows.columns if c not in names], F.col("_b").alias(names[0]), F.col("_a").alias(names[1]))


def find(documents: DataFrame, model: tuple[Boosted, ...] | None = None, text: str = "text", doc_id: str | None = "doc_id", names: tuple[str, str] = ("base", "spans")) -> DataFrame:
    """``documents`` with two arrays of (kind, start, end): the base spans, and all spans; the model is learned here if none is given.

    Null and empty texts have none. Repeated rows give the same spans, ties in order go by start,
    then length, then kind. Very long texts are read in whole; their spans are one row's array.
    An empty table gives an empty one. Other columns pass through; columns that bear ``names``
    are replaced, so choose others to keep them.
    """
    found = spot(documents, text, doc_id)
    spans = select(found, model or train(found))
    return attach(documents, spans, may_hold(F.col(text)), keys(doc_id, text), names)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(documents: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Replace each span of ``text`` by its kind in angle brackets; overlapping spans count as one.

    The text is cut into parts of 4,096 characters first, so that a span costs no more than its
    surroundings. A row without spans keeps its text; null stays null.
    """
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    most = lambda x: F.coalesce(F.array_max(x), F.lit(0))

    def between(parts: Column, lo: Column, hi: Column) -> Column:
        first, last = F.floor(lo / _PART).cast("int"), F.floor(hi / _PART).cast("int")
        within = lambda p, a, n: F.coalesce(F.substr(F.get(parts, p), a + 1, n), F.lit(""))
        middle = F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        return F.when(first == last, within(first, lo % _PART, hi - lo)).otherwise(F.concat(within(first, lo % _PART, F.lit(_PART)), middle, within(last, F.lit(0), hi % _PART)))

    def cut(parts: Column, s: Column) -> Column:
        def pieces(reach: Callable[[Column], Column]) -> Column:
            piece = lambda x, i: F.when(x["start"] >= reach(i), F.concat(between(parts, reach(i), x["start"]), F.get(names, x["kind"]))).otherwise(F.lit(""))
            return F.concat(F.array_join(F.transform(s, piece), ""), between(parts, reach(F.size(s)), F.length(F.col(text))))

        return _upto(F.transform(s, lambda x: x["end"]), most, pieces)

    parts = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_PART}}}"), F.lit(0))
    return documents.withColumn(text, F.when(F.size(spans) > 0, let(parts, lambda p: let(by_start, lambda s: cut(p, s)))).otherwise(F.col(text)))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document; nulls, long texts, ties and repeated rows as ``find`` says. n_* count base spans, n_spans all."""
    found = spot(table(spark, sf_dir, "documents"), keep=("doc_id",))
    spans = attach(found.rows, select(found, train(found)), F.col("any"), (F.col("k1"), F.col("k2")), ("base", "spans"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return spans.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
