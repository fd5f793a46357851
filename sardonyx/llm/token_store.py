"""Token ids in ORC: stripes of run-length encoded integers, row indexes and Bloom filters.

Documents are range-partitioned and sorted by ``doc_id``, encoded where they
land, and written as ORC with one row per document: ``doc_id, part, pos, start_in_part, ids``.
ORC packs the integer lists with its run-length encoding, keeps minimum and
maximum of ``doc_id`` per stripe and row group, and a Bloom filter on
``doc_id``; a lookup skips the stripes that can't hold an id, and a scan is
split by stripe.  ``part`` and ``start_in_part`` let a reader place each
document in the whole id stream from one sum per part.

Defined results: a NULL text is empty and holds the end id alone; NULL ids
come first; rows that repeat an id follow each other, in an order fixed by the
row handle; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sardonyx.llm.bpe import encoder
from sardonyx.llm.common import arrow_map, texts_of, with_row
from sardonyx.session import scratch_dir

END_ID = 2
#: Metadata key of a digest's column: the folder that holds the digested ids.
STORE = "token_store"
STRIPE_BYTES = 16 << 20
#: Rows between two entries of a row index; rows are whole documents.
INDEX_STRIDE = 1000
#: A task hands on a batch of rows when their ids reach this many bytes.
FLUSH_BYTES = 8 << 20


def write_tokens(docs: DataFrame, tokenizer_json: str, path: str, end_id: int = END_ID,
                 stripe_bytes: int = STRIPE_BYTES, index_stride: int = INDEX_STRIDE) -> str:
    """Encode ``docs`` in ascending ``doc_id`` order into an ORC folder; returns the path."""
    box = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        from pyspark import TaskContext

        enc, part, pos, start = encoder(box.value), TaskContext.get().partitionId(), 0, 0

        def rows(ids, lengths, blobs):
            nonlocal pos, start
            n = np.array(lengths, np.int64)
            at = np.concatenate([[0], np.cumsum(n)])
            values = pa.array(np.frombuffer(b"".join(blobs), "<u4").astype(np.int32))
            out = pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field("doc_id").type), pa.array([part] * len(ids), pa.int32()),
                 pa.array(np.arange(pos, pos + len(ids))), pa.array(start + at[:-1]),
                 pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)],
                ["doc_id", "part", "pos", "start_in_part", "ids"])
            pos, start = pos + len(ids), start + int(at[-1])
            return out

        for batch in batches:
            ids, lengths, blobs, held = [], [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                blob = enc.ids_of(text.decode())
                ids.append(doc_id)
                blobs += [blob, end]
                lengths.append(len(blob) // 4 + 1)
                held += len(blob) + 4
                if held >= FLUSH_BYTES:
                    yield rows(ids, lengths, blobs)
                    ids, lengths, blobs, held = [], [], [], 0
            if ids:
                yield rows(ids, lengths, blobs)

    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = (with_row(docs.select("doc_id", "text"))
               .repartitionByRange(F.col("doc_id").asc_nulls_first(), "_row")
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_row").select("doc_id", "text"))
    (arrow_map(ordered, encode, f"doc_id {kind}, part int, pos bigint, start_in_part bigint, ids array<int>")
     .write.mode("overwrite")
     .option("orc.compress", "ZSTD").option("orc.stripe.size", str(stripe_bytes))
     .option("orc.create.index", "true").option("orc.row.index.stride", str(index_stride))
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .orc(path))
    return path


def read_tokens(spark, path: str) -> DataFrame:
    """The stored rows; filters on ``doc_id`` reach the row indexes and Bloom filters."""
    return spark.read.orc(path)


def token_digest(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the stored documents."""
    def digest(batches):
        for b in batches:
            lists = b.column(3)
            at = lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * x:4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(np.diff(at).astype(np.int64)),
                 pa.array(crc, pa.int64())], ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    rows = arrow_map(tokens.select("doc_id", "part", "start_in_part", "ids"), digest,
                     f"doc_id {kind}, part int, start_in_part bigint, n_tokens bigint, ids_crc32 bigint")
    # one row per part, from the integer columns alone
    ends = (tokens.select("part", "start_in_part", F.size("ids").alias("n"))
            .groupBy("part").agg(F.max(F.col("start_in_part") + F.col("n")).alias("n")))
    before = ends.select("part", F.coalesce(
        F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part").select(
        "doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def store_and_digest(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """Write ``docs`` as token ids below the checkpoint folder, read them back and digest them.

    The digest knows its store (``store_of``): the folder's path is metadata of ``ids_crc32``, which a
    Parquet copy of the digest keeps.
    """
    spark = docs.sparkSession
    path = write_tokens(docs, tokenizer_json, scratch_dir(spark, "token-ids"))
    digest = token_digest(read_tokens(spark, path))
    return digest.withMetadata("ids_crc32", {STORE: path})


def store_of(digest: DataFrame) -> str | None:
    """The folder of the token ids that ``store_and_digest`` digested; None for any other table."""
    return next((f.metadata[STORE] for f in digest.schema.fields if STORE in f.metadata), None)
