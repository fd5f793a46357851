import random
import time
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from sardonyx.llm import url_rules as U
from tests.llm.frames import LABEL_SCHEMA


def _plain(url):
    """Host, path, rule and verdict by plain string work."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host):].split("?", 1)[0].split("#", 1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = max(((h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)),
               key=lambda r: len(r[0]), default=(None, None))
    return host, path, *best


URLS = ["http://a.example.net/en/1", "https://EXAMPLE.net/de/", "http://net/", "http://net", "http://example.com/de/x?y#z",
        "http://notexample.com/de/", "https://b.org/fr/#a", "https://b.org/FR/", "ftp://x.Net?q=/en/", None, "",
        "no scheme", "://", "http://://x", "http://é.net/ü", "http://a.net/\nline/en/", "http://u@h.net:80/p",
        "http://example.net/en", "HTTP://sub.example.com/de/ü?x", "http://" + "a" * 50_000 + ".org/fr/" + "b" * 50_000]


def test_list_rules(spark):
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(URLS)] + [(0, URLS[0], "again"), (None, None, "")],
                                  "page_id bigint, url string, rule string")
    got = U.judge(pages, spark.createDataFrame([], LABEL_SCHEMA)).collect()
    want = []
    for k, u in [*enumerate(URLS), (0, URLS[0]), (None, None)]:
        host, path, rule, verdict = _plain(u)
        want.append((repr(k), host, path, repr(rule), verdict or "allow"))
    assert sorted((repr(r["page_id"]), r["host"], r["path"], repr(r["rule"]), r["verdict"]) for r in got) == sorted(want)
    assert U.judge(pages.limit(0), spark.createDataFrame([], LABEL_SCHEMA)).count() == 0


def _mined(transactions, least, confidence):
    """Every block rule by counting all token sets, pruned in the same way."""
    sets = {}
    for bad, tokens in transactions:
        for n in range(1, len(tokens) + 1):
            for s in combinations(sorted(tokens), n):
                a, b = sets.get(s, (0, 0))
                sets[s] = a + 1, b + bad
    rules = {s: b / a for s, (a, b) in sets.items() if b >= least and b / a >= confidence}
    return {s: c for s, c in rules.items()
            if not any(rules.get(tuple(x for x in s if x != t), -1) >= c for t in s)}


def test_mining_against_all_token_sets(spark):
    rows = [(int(k % 5 < 2 or k % 7 == 0), ["a"] * (k % 5 < 2) + ["b"] * (k % 7 == 0) + ["c"] * (k % 2) + ["d"] * (k % 3 == 0))
            for k in range(300)]
    rows = [(b, t or ["e"]) for b, t in rows]
    frame = spark.createDataFrame([(t + [U.BLOCK] * b,) for b, t in rows], "items array<string>")
    got = U.mine(frame, support=0.01, least=5, confidence=0.9).collect()
    want = _mined(rows, 5, 0.9)
    assert {tuple(r["tokens"]): round(r["rule_confidence"], 9) for r in got} == {s: round(c, 9) for s, c in want.items()}
    assert all(r["key"] in r["tokens"] for r in got) and ("a",) in want


def test_random_mining_against_all_token_sets(spark):
    """Equal tokens, tokens of every url, and tokens that block alone are left out without changing a rule."""
    rng = random.Random(4)
    for round_ in range(3):
        rows = []
        for _ in range(250):
            t = {"all"} | {x for x in "abcdef" if rng.random() < 0.4}
            t |= {"a2", "a3"} if "a" in t else set()
            bad = rng.random() < (0.9 if {"b", "c"} <= t else 0.95 if {"d", "e", "f"} <= t else 0.1)
            rows.append((int(bad or "p" in t), sorted(t)))
        rows += [(1, ["all", "p", "b", "q"])] * 30 + [(1, ["all", "p", "d"])] * 20
        frame = spark.createDataFrame([(t + [U.BLOCK] * b,) for b, t in rows], "items array<string>")
        got = {}
        for r in U.mine(frame, support=0.01, least=6, confidence=0.8).collect():
            for s in product(*r["choices"]):
                got[tuple(sorted(s))] = round(r["rule_confidence"], 9)
        want = {s: round(c, 9) for s, c in _mined(rows, 6, 0.8).items()}
        assert got == want and ("p",) in want and any(len(s) == 3 for s in want) == any(len(s) == 3 for s in got)


@pytest.mark.parametrize("all_bad", [True, False])
def test_long_shared_paths(spark, all_bad):
    """Thirty path parts that stand together, and thirty that mostly do, are no 2^30 sets."""
    n = F.col("id")
    deep = [F.lit(f"path=d{k}") for k in range(30)]
    loose = [F.when((n + k) % 31 != 0, F.lit(f"path=l{k}")).otherwise(F.lit("path=x")) for k in range(30)]
    bad = F.when((n < 60) & (F.lit(all_bad) | (n % 2 == 0)), F.array(F.lit(U.BLOCK))).otherwise(F.array().cast("array<string>"))
    tokens = F.when(n < 30, F.array(F.lit("host=a"), *deep)).when(
        (n < 60) & F.lit(all_bad), F.array(F.lit("host=a"), *loose)).otherwise(F.array(F.lit("host=a"), F.lit("host=b")))
    frame = spark.range(3000).select(F.array_distinct(F.concat(tokens, bad)).alias("items"))
    start = time.time()
    rules = U.mine(frame, least=12).collect()
    assert time.time() - start < 60
    if all_bad:
        assert {"path=d0"} in [set(r["tokens"]) for r in rules] and len(rules[0]["choices"][0]) >= 1
        assert any(len(r["choices"][0]) == 30 for r in rules)
    else:
        assert rules == []


def test_any_of_equal_tokens_matches(spark):
    urls = spark.createDataFrame([(1, ["a", "x"]), (2, ["a2", "x"]), (3, ["a"]), (4, ["x"]), (5, [])], "_row bigint, tokens array<string>")
    rules = spark.createDataFrame([("a", ["a", "x"], [["a", "a2"], ["x"]], 2, 0.1, 0.9)],
                                  "key string, tokens array<string>, choices array<array<string>>, n int, "
                                  "rule_support double, rule_confidence double")
    assert {r["_row"]: r["_best"]["mined"] for r in U.matched(urls, rules).collect()} == {1: "a x", 2: "a x"}


def test_mined_rule_blocks(spark):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.concat(
        F.lit("http://"), F.when(F.col("id") % 4 == 0, "pills-win").otherwise("fine"), F.lit(".example.org/en/"),
        F.col("id")).alias("url"))
    known = spark.range(0, 400, 2).select(F.col("id").alias("doc_id"), (F.col("id") % 4 != 0).cast("int").alias("quality"),
                                          F.lit(0).alias("toxic"))
    got = U.judge(pages, known)
    assert got.where("verdict = 'block'").count() == 100
    assert got.where("verdict = 'block' and host like 'pills%' and mined_confidence = 1").count() == 100
    few = known.where("doc_id < 40")
    assert U.judge(pages, few).where("verdict = 'block'").count() == 0  # too few labels for a rule


def test_a_small_bad_host_has_a_rule_among_many_labels(spark):
    def items(bad, *tokens):
        return F.array(*[F.lit(t) for t in (*tokens, *[U.BLOCK] * bad)])

    n = F.col("id")
    frame = spark.range(40_000).select(  # 30 pages of one host, and 30 that only two tokens together tell
        F.when(n < 30, items(1, "host=org", "host=pills")).when(n < 60, items(1, "host=org", "path=win"))
        .when(n < 300, items(0, "host=net", "path=win")).otherwise(items(0, "host=org")).alias("items"))
    got = {tuple(r["tokens"]): (r["key"], r["rule_confidence"]) for r in U.mine(frame).collect()}
    assert got == {("host=pills",): ("host=pills", 1.0), ("host=org", "path=win"): ("path=win", 1.0)}


@pytest.mark.parametrize("quality, toxic, blocked", [(0, None, True), (None, 1, True), (1, 0, False), (None, None, None)])
def test_labels(spark, quality, toxic, blocked):
    urls = spark.createDataFrame([(1, ["t"])], "page_id bigint, tokens array<string>")
    known = spark.createDataFrame([(1, quality, toxic)], LABEL_SCHEMA)
    got = U.labelled_urls(urls, known).collect()
    assert [U.BLOCK in r["items"] for r in got] == ([] if blocked is None else [blocked])
