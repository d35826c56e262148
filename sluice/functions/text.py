"""Text, URL and keyword column functions."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scripts and address forms that the text rules name.
HAN = r"[\x{4e00}-\x{9fff}]"
URL = r"https?://\S+"


def once(x: Column, form: Callable[[Column], Column]) -> Column:
    """``form(x)`` with x computed once, however often the form names it."""
    return F.get(F.transform(F.array(x), form), F.lit(0))


def stripped(x: Column) -> Column:
    """Null as empty, white space of any script cut from both ends; only texts that begin or end with some are searched."""
    ends = lambda t: F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1))
    return once(F.coalesce(x, F.lit("")), lambda t: F.when(ends(t).rlike(r"(?U)\s"), F.regexp_replace(t, r"(?U)^\s+|\s+$", "")).otherwise(t))


def unescaped(x: Column) -> Column:
    """The five XML entities and the no-break space."""

    def plain(out: Column) -> Column:
        for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            out = F.replace(out, F.lit(entity), F.lit(character))
        return out

    return once(stripped(x), lambda t: F.when(F.contains(t, F.lit("&")), plain(t)).otherwise(t))


#: A character reference as HTML reads it: decimal, hexadecimal or named, the semicolon left out or not.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def _code_point(code: Column) -> Column:
    """The character of a numeric reference: those of 128 to 159 as Windows 1252 has them, none for controls and non-characters."""
    plain = F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 8, "0")), "UTF-32")
    windows = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}
    named = F.create_map(*[F.lit(x) for pair in windows.items() for x in pair])
    barred = ((code < 32) & ~code.isin(9, 10, 12, 13)) | (code == 127) | code.between(0xFDD0, 0xFDEF) | ((code % 65536) >= 65534)
    lost = code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    return F.when(lost, "\ufffd").when(code.between(128, 159), F.try_element_at(named, code.cast("int"))).when(barred, "").otherwise(plain)


def _reference(e: Column, names: Column) -> Column:
    digits, hexes, body = F.regexp_extract(e, "^&#([0-9]+)", 1), F.regexp_extract(e, "^&#[xX]([0-9a-fA-F]+)", 1), F.substring(e, 2, 64)
    short = F.regexp_replace(hexes, "^0+(?=.)", "")
    code = F.when(digits != "", digits.try_cast("decimal(38,0)")).when(F.length(short) <= 8, F.conv(short, 16, 10).cast("decimal(38,0)"))
    found = lambda n: F.try_element_at(names, F.substring(body, F.lit(1), n))
    longest = F.get(F.filter(F.transform(F.sequence(F.length(body), F.lit(1), F.lit(-1)), lambda n: F.concat(found(n), F.substring(body, n + 1, F.lit(64)))), lambda x: x.isNotNull()), 0)
    return F.when((digits != "") | (hexes != ""), _code_point(code)).otherwise(F.coalesce(longest, e))


def decoded(x: Column) -> Column:
    """All character references of HTML replaced, named ones by the longest known name, null as empty.

    The names are those of the HTML standard, as Python's library lists them. Texts without an
    ampersand are not looked at further.
    """
    text, names = F.coalesce(x, F.lit("")), F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    between, references = F.split(text, _REFERENCE, -1), F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    parts = F.zip_with(between, F.transform(references, lambda e: _reference(e, names)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(parts, "")).otherwise(text)


def escaped(x: Column) -> Column:
    out = x
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def collapsed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"[\t\n\x0B\f\r]\s*| \s+", " "))  # single spaces stay, so they are no matches


def _without_urls(x: Column) -> Column:
    return once(x, lambda t: F.when(F.contains(t, F.lit("://")), F.regexp_replace(t, URL, " ")).otherwise(t))


def searchable(*parts: Column) -> Column:
    """Parts joined, lower-cased, without URLs, spaces collapsed."""
    return collapsed(_without_urls(F.lower(F.concat_ws(" ", *[unescaped(p) for p in parts]))))


def plain_text(x: Column) -> Column:
    """Lower case without URLs."""
    return _without_urls(F.lower(unescaped(x)))


def without_html(x: Column, whole: bool = False) -> Column:
    """Text of HTML; ``whole``: with all character references decoded and white space of any script collapsed, as landed posts need it."""
    out = x
    for pattern in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"<[^>]+>"):
        out = F.regexp_replace(out, pattern, " ")
    return stripped(F.regexp_replace(decoded(out), r"(?U)\s+", " ")) if whole else collapsed(unescaped(out))


def url_domain(x: Column) -> Column:
    """The host of a URL, lower case, without www; port and user stay."""
    return F.regexp_replace(F.lower(F.regexp_extract(stripped(x), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def shortened(x: Column, most: int = 120) -> Column:
    one = collapsed(unescaped(x))
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.rtrim(F.substring(one, 1, most - 1)), F.lit("…")))


def url_only(x: Column) -> Column:
    return (stripped(x) == "") | stripped(x).rlike(r"^https?://\S+$")


def low_signal(x: Column) -> Column:
    """Hardly any text beside URLs, mentions, spaces and punctuation: under 8 characters, or 15 with a URL.

    Fixed values: the patterns of mentions and punctuation, and the two lengths.
    """

    def core(clean: Column) -> Column:
        return F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(clean, URL, " "), r"@[A-Za-z0-9_]{1,32}", " "), r"\s+", ""), r"[-—_~`!@#$%^&*()+=\[\]{}|\\:;\"'，。！？、,.<>/?]+", ""))

    def low(clean: Column) -> Column:
        return once(core(clean), lambda n: (n < 8) | (clean.rlike(URL) & (n < 15)))

    # a cut address or reference leaves at most ten letters of its own, so a start with 32 says enough
    return once(unescaped(x), lambda t: F.when((F.length(t) > 400) & (core(F.substring(t, 1, 400)) >= 32), False).otherwise(low(t)))


def has_han(x: Column) -> Column:
    return x.rlike(HAN)


def is_chinese(x: Column) -> Column:
    """Han without kana or hangul."""
    return has_han(x) & ~x.rlike(r"[\x{3040}-\x{30ff}\x{31f0}-\x{31ff}\x{ac00}-\x{d7af}]")


def needs_translation(x: Column) -> Column:
    """A letter is left without URLs, mentions and tags, and the text is not Chinese."""
    clean = unescaped(x)
    core = clean
    for pattern in (URL, r"@[A-Za-z0-9_]{1,32}", r"#[^\s#]+"):
        core = F.regexp_replace(core, pattern, " ")
    return core.rlike(r"\p{L}") & ~is_chinese(clean)


#: Phrases of hype.
HYPE = r"(?<![a-z0-9])(?:buy now|lfg|100x|altseason|bag(?:ged)?|smart ones|chase later)(?![a-z0-9])"
_HYPE_PARTS = ("buy now", "lfg", "100x", "altseason", "bag", "smart ones", "chase later")


def promotional_marks(text: Column) -> Column:
    """Promotion by wallet addresses, many mentions, hash tags, cash tags or phrases of hype.

    Fixed values: the patterns and how many of each it takes.
    """
    has = lambda t, part: F.contains(t, F.lit(part))
    counted = lambda t, pattern: F.regexp_count(t, F.lit(pattern))

    def marks(t: Column) -> Column:
        hype = reduce(lambda a, b: a | b, [has(t, part) for part in _HYPE_PARTS]) & t.rlike(HYPE)
        wallet = has(t, "0x") & t.rlike(r"\b0x[a-f0-9]{8,}\b")
        return hype | wallet | (has(t, "@") & (counted(t, "@") >= 3)) | (has(t, "#") & (counted(t, r"#[a-z0-9_]{2,}") >= 4)) | (has(t, "$") & (counted(t, r"\$[a-z][a-z0-9_]{1,9}") >= 2))

    return once(text, marks)


def promotional(text: Column, terms: list[str]) -> Column:
    """Promotion by terms or marks."""
    marks = promotional_marks(text)
    return (F.size(keyword_hits(text, terms)) > 0) | marks if terms else marks


def words(text: Column) -> Column:
    return F.array_distinct(F.split(text, "[^a-z0-9]+"))


def normal_terms(terms: Iterable[str]) -> list[str]:
    """Terms stripped and lower-cased, without empty ones, sorted."""
    return sorted({t.strip().lower() for t in terms} - {""})


def is_word(term: str) -> bool:
    """A term that is found between boundaries and also with s or es: two or more ASCII letters or digits."""
    return re.fullmatch("[a-z0-9]{2,}", term) is not None


def is_phrase(term: str) -> bool:
    """A term of ASCII words joined by spaces, underscores or hyphens: found between boundaries, without s or es.

    Fixed value: the pattern.
    """
    return not is_word(term) and re.fullmatch(r"[a-z0-9][a-z0-9_\- ]*[a-z0-9]", term) is not None


def keyword_hits(text: Column, terms: Iterable[str]) -> Column:
    """The terms that a lower-case text holds, sorted; any other than a word or phrase is found anywhere, as it stands.

    Words are found by one intersection with the text's words, however many there are.
    """
    wanted = normal_terms(terms)
    forms = {v: t for t in wanted if is_word(t) for v in (t + "es", t + "s")} | {t: t for t in wanted if is_word(t)}
    # a word that is another one's plural stands for both
    plural = {v: sorted({t for t in wanted if is_word(t) and v in (t, t + "s", t + "es")}) for v in forms}
    parts = []
    if forms:
        known = F.create_map(*[x for v, ts in plural.items() for x in (F.lit(v), F.array(*[F.lit(t) for t in ts]))])
        met = F.array_intersect(words(text), F.array(*[F.lit(v) for v in forms]))
        parts.append(F.flatten(F.transform(met, lambda w: F.element_at(known, w))))
    phrase = lambda x, t: x.contains(t.split(" ")[0]) & x.rlike(r"(?<![a-z0-9])" + r"\s+".join(t.split(" ")) + r"(?![a-z0-9])") if is_phrase(t) else x.contains(t)
    other = [t for t in wanted if not is_word(t)]
    if other:
        parts.append(once(text, lambda x: F.array_compact(F.array(*[F.when(phrase(x, t), F.lit(t)) for t in other]))))
    return F.array_sort(F.array_distinct(F.concat(*parts))) if parts else F.array().cast("array<string>")


def dedupe_key(url: Column, source: Column, item_id: Column, text: Column) -> Column:
    by_url = F.when(stripped(url) != "", F.concat(F.lit("url::"), stripped(url)))
    by_id = F.when((stripped(source) != "") & (stripped(item_id) != ""), F.concat(F.lit("id::"), stripped(source), F.lit("::"), stripped(item_id)))
    return F.coalesce(by_url, by_id, F.concat(F.lit("text::"), F.substring(F.lower(collapsed(unescaped(text))), 1, 180)))


def event_tokens(text: Column, stopwords: list[str]) -> Column:
    """Distinct ASCII tokens of three or more without stopwords, and Han runs of two to four."""
    latin = F.array_except(F.array_distinct(F.regexp_extract_all(plain_text(text), F.lit("[a-z0-9_]{3,}"), F.lit(0))), F.array(*[F.lit(s) for s in stopwords]))
    return F.array_union(latin, F.array_distinct(F.regexp_extract_all(unescaped(text), F.lit(HAN + "{2,4}"), F.lit(0))))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def secret_mask(x: Column) -> Column:
    n = F.length(x)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(x, F.lit(4)), F.repeat(F.lit("*"), n - 8), F.right(x, F.lit(4))))


def fingerprint(x: Column, digits: int = 20) -> Column:
    return F.substring(F.sha1(x.cast("binary")), 1, digits)


def chunked(x: Column, limit: int = 3500) -> Column:
    """Parts of at most ``limit`` characters, cut at the last line end if that is past the middle."""

    def step(acc: Column, _: Column) -> Column:
        rest = acc["rest"]
        head = F.left(rest, F.lit(limit))
        at = F.length(head) - F.coalesce(F.nullif(F.position(F.lit("\n"), F.reverse(head)), F.lit(0)), F.length(head) + 1)
        cut = F.when(F.length(rest) <= limit, F.length(rest)).when(at > limit // 2, at).otherwise(F.lit(limit))
        done = F.length(rest) == 0
        return F.struct(F.when(done, acc["parts"]).otherwise(F.concat(acc["parts"], F.array(F.left(rest, cut)))).alias("parts"), F.when(done, rest).otherwise(F.regexp_replace(F.substr(rest, cut + 1), r"^\n+", "")).alias("rest"))

    start = F.struct(F.array().cast("array<string>").alias("parts"), stripped(x).alias("rest"))
    most = F.floor(F.length(stripped(x)) * 2 / limit).cast("int") + 1
    return F.aggregate(F.sequence(F.lit(0), most), start, step, lambda acc: acc["parts"])
