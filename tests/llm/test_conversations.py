"""Conversation repair against a plain search over all edits, chunk and segment sizes, and awkward rows."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pytest

from sardonyx.llm import catalog
from sardonyx.llm import conversation_repair as repair
from tests.conftest import SF_SMALL

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, pos string, state string"
EMPTY = hashlib.sha256(b"").hexdigest()


def place(row):
    same = hashlib.sha256(f"{len(row[1])}:{row[1]}:{row[2]}".encode()).digest()
    return (row[0] is not None, row[0] or 0, row[1], same)


def plain(rows):
    """What a conversation's audit must be, from (turn, role, text) rows."""
    rows = sorted([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows], key=place)
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(repair.WHITE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen
                      else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    def after(q, letter):
        if letter == "s":
            return 1 if q == 0 else None
        if letter == "u":
            return 2 if q in (0, 1, 3) else None
        return 3 if letter == "a" and q == 2 else None

    @lru_cache(None)
    def best(t, q, inserts):
        ways = []
        if t == len(rows):
            if q in (0, 3):
                ways.append((0, "", ()))
        else:
            _, role, text = rows[t]
            ways.append((2, "D", None, t + 1, q))
            if faults[t] in ("", "truncated"):
                more = 5 if faults[t] else 0
                for letter, name, cost in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    if name and after(q, name[0]) is not None:
                        ways.append((cost + more, letter, f"{name}:{text}", t + 1, after(q, name[0])))
        out = [w for w in ways if len(w) == 3]
        for cost, letter, said, t2, q2 in (w for w in ways if len(w) == 5):
            c, letters, lines = best(t2, q2, 0)
            out.append((cost + c, letter + letters, ((said,) if said is not None else ()) + lines))
        if inserts < 3:
            for name in ("user", "assistant"):
                if after(q, name[0]) is not None:
                    c, letters, lines = best(t, after(q, name[0]), inserts + 1)
                    out.append((5 + c, "I" + letters, (name + ":",) + lines))
        return min(out) if out else (10 ** 9, "", ())

    for t in range(len(rows), -1, -1):  # from the end, so that long conversations do not recurse
        for q in range(4):
            best(t, q, 0)
    cost, letters, lines = best(0, 0, 0)
    turns = [r[0] for r in rows if r[0] is not None]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
            "cost": cost, "audit": letters, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def some_rows(rng, n, texts=("Yes.", "no", "", " \t", "What?", "word!", "an end…", "é.")):
    roles = ("user", "assistant", "user", "assistant", "system", "tool", "", None, "s", "ua")
    kinds = rng.choice([roles, roles[:2], roles[:5]])
    return [(rng.choice([None, k, k, k + 3]), rng.choice(kinds), rng.choice(texts + (f"t{k}.", f"u{k}", f"v{k}!") * 3))
            for k in range(n)]


def frame(spark, convs):
    rows = [(c, t, r, x, "c", "p", "s") for c, rs in convs.items() for t, r, x in rs]
    return spark.createDataFrame(rows, SCHEMA)


def compare(found, convs):
    got = {r["conv_id"]: r.asDict() for r in found.collect()}
    assert len(got) == len(convs)
    for c, rows in convs.items():
        row = got[c]
        assert row.pop("conv_id") == c
        assert row == plain(rows), (c, rows)


@pytest.mark.parametrize("parts, chunk", [(1, 4096), (7, 3), (16, 1)])
def test_random_conversations(spark, parts, chunk):
    rng = random.Random(parts)
    convs = {c: some_rows(rng, rng.randint(1, 9)) for c in range(400)} | {
        None: some_rows(rng, 30), 1000: some_rows(rng, 300), 1001: [(None, "user", "a.")] * 50}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        compare(repair.audit(frame(spark, convs), chunk=chunk), convs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("rounds", [0, 1, 20])
def test_long_conversations_over_many_segments(spark, rounds):
    """Good rows (vectors meet at once), rows that let every vector through, and both."""
    good = [(k, ("user", "assistant")[k % 2], f"row {k}.") for k in range(400)]
    cut = [(k, ("user", "assistant")[k % 2], f"row {k}") for k in range(400)]
    same = [(k, "user", "again.") for k in range(400)]
    convs = {1: good, 2: cut, 3: same, 4: cut[:200] + good[200:], 5: same[:390] + good[390:], 6: good[:201] + cut[201:]}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        compare(repair.audit(frame(spark, convs), chunk=7, rounds=rounds), convs)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_speculation_meets_before_a_chunk_ends():
    """On ordinary rows any two end vectors give parallel vectors after a few rows."""
    rng = random.Random(5)
    for _ in range(200):
        symbols = [chr(65 + rng.choice((1, 2, 1, 2, 1, 2, 0, 3)) * 4 + rng.choice((0, 0, 0, 0, 1, 2, 3))) for _ in range(60)]
        ends = {repair.costs().back(v, symbols)[0] for v in ((0, 10, 5, 0), (5, 5, 0, 5), (2, 2, 3, 0))}
        assert len(ends) == 1


def test_repair_gives_legal_conversations(spark):
    rng = random.Random(11)
    convs = {c: some_rows(rng, rng.randint(1, 9)) for c in range(60)} | {None: some_rows(rng, 40)}
    out = repair.repair(frame(spark, convs), chunk=4)
    assert out.columns == ["conv_id", "seq", "edit", "fault", "role", "text"]
    by = {}
    for r in sorted(out.collect(), key=lambda r: tuple(r["seq"])):
        by.setdefault(r["conv_id"], []).append(r)
    for c, rows in convs.items():
        want = plain(rows)
        assert "".join(r["edit"] for r in by[c]) == want["audit"]
        kept = [r for r in by[c] if r["edit"] != "D"]
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in kept))
        said = "\n".join(f"{r['role']}:{r['text']}" for r in kept)
        assert hashlib.sha256(said.encode()).hexdigest() == want["repaired_sha256"]
        assert sum(r["fault"] == "blank" for r in by[c]) == want["blank"]


def test_awkward_tables(spark):
    assert repair.audit(frame(spark, {}).limit(0)).collect() == []
    assert repair.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    long = "word " * 300_000 + "end."
    convs = {1: [(1, "user", long), (2, "assistant", long)], 2: [(None, None, None)] * 3}
    compare(repair.audit(frame(spark, convs)), convs)
    texts = spark.createDataFrame([("a", 1, "user", "x."), (None, 1, "user", "x."), ("", 2, "user", "y.")],
                                  "conv_id string, turn int, role string, text string")
    assert {r["conv_id"]: r["audit"] for r in repair.audit(texts).collect()} == {"a": "D", None: "D", "": "D"}


def damage(conv, turn, role, text):
    role, text = role if role is not None else " ", text if text is not None else " "
    hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    if hit == 0:
        return []
    text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
    return [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)


def test_query(spark):
    convs = {}
    for c, *row in duckdb.sql(f"SELECT * FROM read_parquet('{SF_SMALL}/conversations.parquet')").fetchall():
        convs.setdefault(c, []).extend(damage(c, *row))
    found = catalog.QUERIES["op12_conversation_repair"](spark, SF_SMALL)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                             "repaired_sha256"]
    compare(found, convs)


def test_query_with_nulls_and_dropped_conversations(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(5)]), rng.choice(["user", "assistant", None, ""]),
             rng.choice([None, "a.", "b?!", "", "c"])) for _ in range(300)]
    dropped = next(c for c in range(50, 500) if not damage(c, 1, "user", "a."))
    rows.append((dropped, 1, "user", "a."))
    spark.createDataFrame(rows, SCHEMA.split(", conv ")[0]).write.parquet(f"{tmp_path}/conversations.parquet")
    convs = {}
    for c, *row in rows:
        convs.setdefault(c, []).extend(damage(c, *row))
    compare(catalog.QUERIES["op12_conversation_repair"](spark, str(tmp_path)), convs)
    assert plain([]) == {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "",
                         "repaired_sha256": EMPTY}
