import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from sardonyx.llm import decontaminate, mixing, quality, token_store  # noqa: E402
from sardonyx.llm.catalog import QUERIES, vocabulary  # noqa: E402
from sardonyx.llm.common import alnum_words  # noqa: E402
from tests.conftest import SF_SMALL  # noqa: E402
from tests.llm.test_decontaminate import _brute  # noqa: E402
from tests.llm.test_quality import plain_score  # noqa: E402
from tests.llm.test_simhash import plain_components, plain_fingerprint  # noqa: E402


def test_run_against_plain_python(spark):
    from tokenizers import Tokenizer

    docs, labels, bench = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = quality.fit(docs, labels, held_out=quality.held_out_column())
    texts = {i: r["text"] for i, r in rows.items()
             if plain_score(model, quality.statistics((r["text"] or "").encode())) >= 0.5}
    ids = sorted(texts)
    heads = plain_components(ids, [plain_fingerprint(texts[i]) for i in ids])
    texts = {i: texts[i] for i, h in zip(ids, heads) if i == h}
    items = [(str(r["item_id"]), alnum_words((r["text"] or "").encode())) for r in bench.collect()]
    for i, t in list(texts.items()):
        words = alnum_words((t or "").encode())
        while hit := _brute(items, words, decontaminate.WINDOW)[0]:
            if len(hit) > len(words) * decontaminate.COVERAGE:
                del texts[i]
                break
            spans = decontaminate._merged([(k, k + 1) for k in hit])
            texts[i] = decontaminate.cut_spans(texts[i].encode(), spans).decode()
            words = alnum_words(texts[i].encode())
    mid = spark.createDataFrame([(i, t, rows[i]["lang"]) for i, t in texts.items()], "doc_id bigint, text string, lang string")
    copies = {r["doc_id"]: r["copies"] for r in mixing.plan(mid, labels).collect()}
    tok, start, want = Tokenizer.from_str(vocabulary()), 0, []
    for i in sorted(texts):
        if copies[i]:
            own = [*tok.encode(texts[i] or "", add_special_tokens=False).ids, 2]
            want.append((i, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
            start += len(own)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF_SMALL).collect()) == want


def test_token_ids_stay_after_run(spark):
    result = corpus_pipeline.run(spark, SF_SMALL)
    back = token_store.read_tokens(spark, token_store.store_of(result))
    stored, start, want = back.orderBy("part", "pos").collect(), 0, []
    for r in stored:
        want.append((r["doc_id"], start, len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes())))
        start += len(r["ids"])
    assert want and sorted(tuple(r) for r in result.collect()) == sorted(want)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_SMALL).columns == docs.columns


def test_every_operator_has_a_query():
    assert {int(q[2:].split("_")[0]) for q in QUERIES} == set(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5
