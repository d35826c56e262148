"""Personal data: base spans against plain patterns, learned spans against forms that were hidden on purpose."""

import hashlib
import re

from helpers import prose
from pyspark.sql import functions as F

from sluice.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TRICKY = [
    "a@b@c.d e@f", "a@b.c_x@d.e.f a@b.c.@d.e", "1.2.3.4.5.6.7.8 001.02.3.4 256.1.1.1 1.2.3", "4111-1111 1111-1111  4111  1111 1111 1111", "+1 2 3 4 5 6 7 8 9 +12345678 +1234567890123456 ++1-2-3-4-5-6-7-8-9",
    "4111111111111111 4111 1111 1111 1111 1234567890123456789012345", "x" * 5000 + "@a.b", ("9 " * 4000), "+" + "(1)" * 3000, "a.b.c.d" * 900 + "@x.y", "1.1.1.1" * 800, "é@a.b 😀+49 170 1234567.",
]


def test_base_spans(spark, odd_rows, nothing):
    rows = [(i, t) for i, t in enumerate([r[1] for r in odd_rows] + TRICKY)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), pii.NOTHING)
    got = {r.doc_id: (r.base, r.spans) for r in found.select("doc_id", pii.listed(F.col("base")).alias("base"), pii.listed(F.col("spans")).alias("spans")).collect()}
    for i, t in rows:
        assert got[i][0] == ",".join(base_spans(t)), t
        assert got[i][1] == got[i][0]
    assert pii.find(nothing).count() == 0


def test_query_against_plain_patterns(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = pii.op5_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in PATTERNS]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        spans = [x for x in r.spans.split(",") if x]
        assert set(want) <= set(spans) and r.n_spans == len(spans)


def test_callers_columns_stay(spark, odd, odd_rows):
    docs = odd.withColumns({c: F.lit(c) for c in ("base", "spans", "more", "row", "k1", "_k1", "wide", "_s1", "near")})
    out = pii.find(docs, names=("own", "all")).collect()
    assert len(out) == len(odd_rows) and all(r[c] == c for r in out for c in ("base", "spans", "more", "row", "k1", "_k1", "wide", "_s1", "near"))


def hidden(text):
    """The text with its base spans in forms that the strict patterns miss, and where these lie."""
    forms = {
        "email": lambda v: v.partition("@")[0] + " [at] " + v.partition("@")[2].replace(".", " [dot] "), "ip": lambda v: v.replace(".", " . "),
        "card": lambda v: ".".join(v[i : i + 4] for i in range(0, len(v), 4)), "phone": lambda v: v[v.find("(") :],
    }
    spans = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in base_spans(text)))
    out, at, where = "", 0, []
    for lo, hi, kind in spans:
        if lo < at or (kind == "phone" and "(" not in text[lo:hi]):
            continue
        out += text[at:lo]
        form = forms[kind](text[lo:hi])
        where.append((kind, len(out), len(out) + len(form)))
        out, at = out + form, hi
    return out + text[at:], where


def test_learned_spans_find_hidden_forms(spark):
    """One text in six has its data hidden: most must be found, and hardly anything else."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text RLIKE '[0-9@]'").collect()]
    want, docs = {}, []
    for n, (i, text) in enumerate(rows):
        if n % 6 == 0:
            text, want[i] = hidden(text)
        docs.append((i, text))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    found = pii.spot(frame)
    model = pii.train(found)
    assert {"name", "last", "after"} <= set.union(*[m.used() for m in model])
    added = {}
    for r in pii.find(frame, model).collect():
        base = {tuple(x) for x in r.base}
        added[r.doc_id] = {(pii.KINDS[k], a, b) for k, a, b in map(tuple, r.spans) if (k, a, b) not in base}
    planted = {(i, *s) for i, spans in want.items() for s in spans}
    given = {(i, *s) for i, spans in added.items() for s in spans}
    meets = lambda a, b: a[0] == b[0] and a[1] == b[1] and a[2] < b[3] and b[2] < a[3]
    caught = [p for p in planted if any(meets(p, g) for g in given)]
    wrong = [g for g in given if not any(meets(p, g) for p in planted)]
    print(f"planted {len(planted)}, caught {len(caught)}, added {len(given)}, wrong {len(wrong)}, by kind", {k: (sum(p[1] == k for p in caught), sum(p[1] == k for p in planted)) for k in pii.KINDS})
    assert len(planted) > 20 and len(caught) >= 0.8 * len(planted) and len(wrong) <= 0.1 * len(given)


def test_adds_spans_and_redacts(spark):
    rows = [(i, f"card 4111111111111111 mail me{i}@x.org ip 10.0.0.{i % 250} and +1 (555) 010-9{i:03d}") for i in range(60)] + [(100 + i, f"order 411111111111{1000 + i} and 300.1.1.{i}") for i in range(60)]
    rows += [(500, "pay card 4111.1111.1111.1111 now"), (501, "nothing at all"), (502, None)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
    spans = {r.doc_id: r.s for r in found.select("doc_id", pii.listed(F.col("spans")).alias("s")).collect()}
    assert spans[500] == "card:9:28" and spans[501] == ""
    text = {r.doc_id: r.text for r in pii.redact(found).collect()}
    assert text[500] == "pay card <card> now" and text[501] == "nothing at all" and text[502] is None
    assert text[3] == "card <card> mail <email> ip <ip> and <phone>"


def test_learns_phones_without_plus(spark):
    """National numbers inside longer base spans say nothing against the same form where it stands free."""
    rows = [(i, f"call me on +1 (555) 010-9{i:03d} or write me{i}@x.org today") for i in range(80)] + [(100 + i, f"code 300.1.1.{i} or +{i} 55 of 10.0.0.{i}") for i in range(80)]
    rows += [(500, "please call (017) 555-7713 today"), (501, "nothing at all"), (502, "call +1 (017) 555-7713 today")]
    spans = {r.doc_id: r.s for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.listed(F.col("spans")).alias("s")).collect()}
    assert spans[500] == "phone:12:26" and spans[501] == "" and spans[502] == "phone:5:22"


def test_redaction_of_long_texts(spark):
    """Spans at the borders of parts and thousands of spans in one text."""
    text = "x" * 4090 + " 10.0.0.1 " + prose(5, 3000) + " " + " ".join(f"n{i}@mail.example.com and 10.1.{i % 250}.7" for i in range(3000)) + " 😀" * 5000
    row = pii.redact(pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), pii.NOTHING)).head()
    want = re.sub(r"[0-9]+(\.[0-9]+){3}", "<ip>", re.sub(PATTERNS["email"], "<email>", text))
    assert row.text == want and len(row.spans) == 6001
