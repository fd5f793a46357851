"""Helpers shared by the training-data operators: tables, code shipping, Arrow maps, words.

Row maps go through ``mapInArrow``: Spark partitions and moves the work, a
task sees one Arrow batch at a time, and pandas is never loaded into a worker.
"""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sardonyx.session import ensure_checkpoint_dir, materialize

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark (the folder may be in any store Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Give the executors this package, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    # into the shared folder, from which every executor can fetch it
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/sardonyx_code.zip")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(buf.getvalue()))
    out.close()
    sc.addPyFile(path.toString())
    _SHIPPED.add(sc.applicationId)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped to the executors."""
    prepare(df.sparkSession)
    return df.mapInArrow(fn, schema)


class PieceLists:
    """Per row a list of ``struct<piece, m>``, kept as flat columns (no object per entry)."""

    def __init__(self):
        self.ends, self.pieces, self.counts = [0], [], []

    def add(self, counter) -> None:
        self.pieces += counter.keys()
        self.counts += counter.values()
        self.ends.append(len(self.pieces))

    def array(self, kind: pa.DataType) -> pa.Array:
        entries = pa.StructArray.from_arrays(
            [pa.array(self.pieces, kind), pa.array(self.counts, pa.int32())], ["piece", "m"])
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), entries)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of each text of a batch, one at a time; NULL is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    for v in col.cast(pa.binary()) if col.type != pa.binary() else col:
        b = v.as_py()
        yield b if b is not None else b""


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, decide, name: str) -> DataFrame:
    """The rows of ``docs`` for which ``decide`` gives ``kept``; all columns pass through.

    ``docs`` is written once with a row handle (so that the handles hold in
    every later pass) under a name that no column has; ``decide`` sees
    ``_row, doc_id, text`` and returns ``_row, kept`` (never NULL) of every row.
    """
    handle = fresh(docs, "_row")
    rows = stored(with_row(docs, handle), name)
    narrow = rows.select(F.col(handle).alias("_row"), "doc_id", "text")
    # the dropped are the fewer: a list small enough to be broadcast moves no text at all
    drop = decide(narrow).where("not kept").select(F.col("_row").alias(handle))
    return rows.join(drop, handle, "left_anti").select(docs.columns)


def with_row(df: DataFrame, name: str = "_row") -> DataFrame:
    """A handle for each row, so that rows that agree in every column stay apart."""
    return df.withColumn(name, F.monotonically_increasing_id())


#: A-Z to a-z; every other byte as it is.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A-Z to a-z, ASCII bytes that are not letters or digits to a space, all else as it is.
LOWER_ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122
                    else 32 for b in range(256))


def space_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of bytes that are not space, \\t, \\n, \\v, \\f or \\r."""
    return text.translate(LOWER_ASCII).split()


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters and digits and non-ASCII characters."""
    return text.translate(LOWER_ALNUM).split()


def crc_mod(column: str, mod: int):
    """crc32 of an id's decimal text, modulo ``mod``; an empty id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod


def hash_share(column: str, most: int, total: int):
    """A repeatable share of ids by hash, a little under ``most`` of ``total``, so that a limit of
    ``most`` after it is a bound and not a choice of rows."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 30)) < int(0.97 * most / total * (1 << 30))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared checkpoint folder and read back."""
    ensure_checkpoint_dir(df.sparkSession)
    return materialize(df, name)
