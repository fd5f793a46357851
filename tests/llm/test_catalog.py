"""The registered queries over whole tables against plain Python, and SQL where there is any."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from sardonyx.llm import catalog
from sardonyx.llm.common import alnum_words
from tests.conftest import SF_SMALL
from tests.llm.test_decontaminate import _brute
from tests.llm.test_urls import _plain


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _rows(spark, query):
    return catalog.QUERIES[query](spark, SF_SMALL).collect()


@pytest.mark.parametrize("query", list(catalog.ORACLE))
def test_sql(spark, con, query):
    df = catalog.QUERIES[query](spark, SF_SMALL)
    got = con.sql(catalog.ORACLE[query])
    at = [got.columns.index(c) for c in df.columns]
    assert sorted(df.columns) == sorted(got.columns)
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[k] for k in at) for r in got.fetchall())


def test_decontamination(spark, con):
    items = [(str(i), alnum_words((t or "").encode())) for i, t in con.sql("SELECT * FROM benchmark").fetchall()]
    want = {}
    for i, t in con.sql("SELECT doc_id, text FROM documents").fetchall():
        words = alnum_words((t or "").encode())
        hit, found = _brute(items, words, 10)
        want[i] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    assert {r[0]: tuple(r[1:]) for r in _rows(spark, "op2_decontamination")} == want


def test_url_filters(spark, con):
    got = {r["page_id"]: r for r in _rows(spark, "op3_url_filters")}
    pages = con.sql("SELECT page_id, url FROM pages").fetchall()
    assert len(got) == len(pages)
    for i, u in pages:
        host, path, rule, verdict = _plain(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict or verdict is None and got[i]["verdict"] in ("allow", "block")


def test_token_queries(spark, con):
    tokenizers = pytest.importorskip("tokenizers")
    tok, start = tokenizers.Tokenizer.from_str(catalog.vocabulary()), 0
    counts = {r["doc_id"]: r for r in _rows(spark, "op4_token_counts")}
    store = {r["doc_id"]: tuple(r) for r in _rows(spark, "op8_token_store")}
    for i, t in con.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        n = len(ids)
        assert tuple(counts[i]) == (i, len((t or "").encode()), n, n > 512)
        ids.append(2)
        assert store[i] == (i, start, n + 1, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n + 1


def test_columns(spark):
    want = {"op1_html_extraction": ["page_id", "url", "text", "n_chars"],
            "op5_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
            "op6_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
            "op7_lm_scoring": ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "held_out"],
            "op10_mixing": ["doc_id", "n_tokens", "domain", "posterior", "rate", "copies"]}
    for query, columns in want.items():
        assert catalog.QUERIES[query](spark, SF_SMALL).columns == columns
