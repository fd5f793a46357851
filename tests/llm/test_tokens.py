import random
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from sardonyx.llm import token_counts, token_store  # noqa: E402
from sardonyx.llm.bpe import PieceEncoder  # noqa: E402
from sardonyx.llm.catalog import BYTE_BPE, vocabulary  # noqa: E402
from tests.llm.frames import DOC_SCHEMA, documents  # noqa: E402


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(BYTE_BPE))


def _ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_library_ids(library):
    enc, rng = PieceEncoder(vocabulary()), random.Random(5)
    low = [chr(i) for i in range(0x250)] + [" "] * 200 + ["\n"] * 60 + ["'"] * 50 + list("smtdrlve") * 10
    wide = low + [" ", "　", "中", "\U0001f600", "̀", "ก", "٣", "<|endoftext|>"] * 20
    for k in range(4000):
        text = "".join(rng.choices(low if k % 2 else wide, k=rng.randint(0, 40)))
        assert np.frombuffer(enc.ids_of(text), "<u4").tolist() == _ids(library, text), repr(text)


@pytest.mark.parametrize("head", [0, 5, 131_072])
def test_counts(spark, library, head):
    docs = documents(spark)
    want = sorted((repr(r["doc_id"]), len((r["text"] or "").encode()), len(_ids(library, r["text"])))
                  for r in docs.collect())
    got = token_counts.token_counts(docs, vocabulary(), head).collect()
    assert sorted((repr(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want


@pytest.mark.parametrize("most", [1, 16_384])
def test_frequent_long_pieces_are_not_joined(spark, library, monkeypatch, most):
    """A separator line of 70 characters in most documents is counted where it is read."""
    monkeypatch.setattr(token_counts.frequent_long, "__defaults__", (most,))
    line, rare = "=" * 70, "-" * 90
    rows = [(i, f"text {i}\n{line}\nmore {line}" if i % 4 else f"alone {rare} {i}" if i % 8 else "é" * 100) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, vocabulary(), 100).collect()}
    assert got == {i: len(_ids(library, t)) for i, t in rows}
    pieces = spark.createDataFrame([("\n" + line, 300, 3), (rare, 25, 4), ("short", 900, 1)], "piece string, n bigint, k bigint")
    known = token_counts.frequent_long(pieces, "k", most)
    tail = Counter({"\n" + line: 2, rare: 1, "short": 5, "x" * 80: 1})
    assert token_counts.take_long(tail, known)[0] == (2, 3)
    assert ("\n" + line) not in tail and tail["short"] == 5 and tail["x" * 80] == 1 and (rare in tail) == (most == 1)


def test_store_has_stripes_indexes_and_bloom_filters(spark, tmp_path):
    docs = spark.range(0, 6000, 1, 1).selectExpr("id as doc_id", "concat('words of text number ', id, repeat(' more', id % 50)) as text")
    path = token_store.write_tokens(docs, vocabulary(), str(tmp_path / "ids"), stripe_bytes=1 << 16, index_stride=1000)
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = 0
    for f in sorted((tmp_path / "ids").glob("*.orc")):
        reader = jvm.org.apache.orc.OrcFile.createReader(
            jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        rows = reader.rows()
        assert reader.getRowIndexStride() == 1000
        for stripe in list(reader.getStripes()):
            footer = rows.readStripeFooter(stripe)
            streams = [(footer.getStreams(k).getColumn(), footer.getStreams(k).getKind().toString())
                       for k in range(footer.getStreamsCount())]
            assert (1, "ROW_INDEX") in streams and (1, "BLOOM_FILTER_UTF8") in streams
            # run-length encoding of the second kind on the ids (the innermost column)
            assert "V2" in footer.getColumns(footer.getColumnsCount() - 1).getKind().toString()
            seen += stripe.getNumberOfRows()
        assert len(list(reader.getStripeStatistics())) == len(list(reader.getStripes()))
        rows.close()
    assert seen == 6000


def test_store_round_trip(spark, library, tmp_path):
    docs = documents(spark)
    path = token_store.write_tokens(docs, vocabulary(), str(tmp_path / "ids"))
    back = token_store.read_tokens(spark, path)
    rows = back.orderBy("part", "pos").collect()
    key = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in rows]
    assert key == sorted(key)
    want = sorted((repr(r["doc_id"]), [*_ids(library, r["text"]), 2]) for r in docs.collect())
    assert sorted((repr(r["doc_id"]), r["ids"]) for r in rows) == want
    start, by_place = 0, []
    for r in rows:
        by_place.append((r["doc_id"], start, len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes())))
        start += len(r["ids"])
    got = [tuple(r) for r in token_store.token_digest(back).collect()]
    assert sorted(got, key=lambda r: r[1]) == by_place
    assert [r["doc_id"] for r in back.where("doc_id = 7").select("doc_id").collect()] == [7]
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in \
        back.where("doc_id = 7")._jdf.queryExecution().toString()


def test_empty(spark):
    none = spark.createDataFrame([], DOC_SCHEMA)
    assert token_counts.token_counts(none, vocabulary()).count() == 0
    assert token_store.store_and_digest(none, vocabulary()).count() == 0
