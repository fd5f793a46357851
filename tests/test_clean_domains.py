"""Cleaning and domain rules on the edge rows worked out by hand."""

from pyspark.sql import functions as F

from sardonyx import config as C
from sardonyx.functions.text import url_domain
from sardonyx.operators.domains import domain_name, with_domain_index, with_lookup_domain
from sardonyx.plans.corpus import flag_forum, flag_headlines

NBSP = " "
ROWS = [
    (1, "  hello world  ", "1", "hello world"),
    (2, NBSP + "hello world\t", "0", "hello world"),
    (3, "12345", "1", None),
    (4, "123456", "1", "123456"),
    (5, "   123   ", "1", None),
    (6, "😀" * 6, "0", "😀" * 6),
    (7, None, "1", None),
    (8, "hello world", None, None),
    (9, "[deleted]", "0", "FORUM_DROP"),
    (10, " [removed] ", "1", "FORUM_DROP"),
    (11, "[Deleted] text", "1", "[Deleted] text"),
    (12, "hello world", "2", "HEADLINE_ONLY"),
    (13, "hello world", "x", None),
]


def _kept(df):
    return {r["row_id"]: r["text"] for r in df.filter("kept").collect()}


def test_headline_cleaning(spark):
    rows = spark.createDataFrame([(i, t, lab) for i, t, lab, _ in ROWS],
                                 "row_id bigint, headline string, is_sarcastic string")
    kept = _kept(flag_headlines(rows))
    for i, t, lab, exp in ROWS:
        if exp is None:
            assert i not in kept, (i, t)
        elif exp == "FORUM_DROP":
            assert kept[i] == t.strip()
        elif exp == "HEADLINE_ONLY":
            assert kept[i] == "hello world"
        else:
            assert kept[i] == exp


def test_forum_cleaning_and_placeholders(spark):
    rows = spark.createDataFrame([(i, lab, t, "politics") for i, t, lab, _ in ROWS],
                                 "row_id bigint, label string, comment string, subreddit string")
    kept = _kept(flag_forum(rows))
    for i, t, lab, exp in ROWS:
        if exp in (None, "FORUM_DROP", "HEADLINE_ONLY"):
            assert i not in kept, (i, t)
        else:
            assert kept[i] == exp


def test_url_rules_in_order(spark):
    cases = [
        ("https://news.example.com/entry/politics/rally-report", "politics"),
        ("https://x.com/SPORTS/game", "sports"),
        ("https://x.com/sports/world-cup", "politics"),
        ("https://x.com/biotech", "technology"),
        ("https://x.com/lifestyle/a", "lifestyle"),
        ("https://x.com/unbalanced", "sports"),
        ("https://x.com/weird-news/a", "humor"),
        ("https://x.com/weirdnews/a", "general"),
        ("", "general"),
        (None, "general"),
    ]
    df = spark.createDataFrame(cases, "url string, expected string")
    got = df.select("expected", url_domain("url").alias("d")).collect()
    assert all(r["d"] == r["expected"] for r in got), got


def test_lookup_and_index(spark):
    cases = [("politics", "politics"), (" politics ", "politics"), ("Politics", "general"),
             ("MMA", "sports"), ("mma", "general"), ("AskReddit", "humor"), (None, "general"),
             ("unknown", "general")]
    df = spark.createDataFrame(cases, "sub string, expected string")
    d = with_domain_index(with_lookup_domain(df, "sub", "domain"), "domain", "domain_idx")
    rows = d.select("expected", "domain", "domain_idx", domain_name("domain_idx").alias("back")).collect()
    for r in rows:
        assert r["domain"] == r["expected"]
        assert C.DOMAIN_LABELS[r["domain_idx"]] == r["domain"] == r["back"]


def test_unknown_domain_falls_back_to_general_index(spark):
    df = spark.createDataFrame([("nonsense",), (None,)], "domain string")
    assert {r[0] for r in with_domain_index(df).select("domain_idx").collect()} == {C.GENERAL_INDEX}


def test_whitespace_set():
    assert len(C.WHITESPACE) == 29 and NBSP in C.WHITESPACE and "　" in C.WHITESPACE


def test_no_cap_unless_asked(spark):
    rows = spark.range(200_000).selectExpr("id AS row_id", "cast(id % 2 AS string) AS label",
                                           "concat('a comment with number ', id) AS comment", "'x' AS subreddit")
    assert flag_forum(rows).filter("sampled AND kept").count() == 200_000
    capped = flag_forum(rows, max_samples=1000, unique_keys=True).filter("sampled")
    assert sorted(r["count"] for r in capped.groupBy("label_raw").count().collect()) == [500, 500]
