import pytest
from helpers import prose

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, block string, kept string"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and blank texts, a long text, ties, repeated rows, wide characters."""
    base = prose(1, 120)
    rows = [
        (1, base, "en", "a", None), (2, base, "en", "a", None), (2, base, "en", "a", None), (3, base.replace("er", "er", 1) + " tail", "en", None, 5), (4, None, None, None, None),
        (5, "", "en", "b", 0), (6, " \t\n ", "fr", "b", 4), (None, base, "en", "a", None), (7, "x", "en", "c", 1), (8, "ERIN thon", "de", "c", 9), (9, "erin thon", "de", "c", 9),
        (10, prose(2, 6000), "en", "a", None), (11, "日本語 テスト 😀 naïve", None, "é", 3), (12, prose(3, 80) + " mail a.b@c.example.com and 10.0.0.255 or +1 (555) 010-9999, card 4111 1111 1111 1111", "en", "b", None),
        (13, "😀 x@y.z 1.2.3.4.5.6.7.8 300.1.1.1 4111111111111112", "en", "b", None), (-5, prose(2, 6000) + " more words here", "en", "a", None), (14, "a" * 3000, "en", "a", None), (15, "1" * 3000 + "@" + "b." * 1000, "en", "a", None),
    ]
    return [(*r, "s", "t", "u", "v") for r in rows]


@pytest.fixture()
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCUMENTS)


@pytest.fixture()
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)
