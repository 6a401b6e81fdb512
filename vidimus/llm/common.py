"""What the operators of this package share: text bytes, folds, Arrow streaming, small statistics."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vidimus.functions.frames import by_shuffle

#: White space of all contracts here: the six ASCII characters that bytes.split() also splits at.
WS = r"[\x20\x09-\x0D]"


def raw(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null counts as empty."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id written as text, modulo parts; an id that is null is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(parts)), F.lit(0))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SLICE_ROWS, SLICE_BYTES = 256, 2 << 20


def sliced(batches: Iterator[pa.RecordBatch], text: int = 1, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches: at most `rows`, and of more than one row at most `size` bytes of
    the column at `text` (a string), so that few texts are Python objects at a time."""
    for b in batches:
        size_of = pc.binary_length(b.column(text)).fill_null(0)
        upto = np.cumsum(size_of.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = upto[at - 1] if at else 0
            n = int(np.clip(np.searchsorted(upto, before + size, side="right") - at, 1, rows))
            yield b.slice(at, n)
            at += n


def longs(col: pa.Array) -> np.ndarray:
    """An integer column without nulls as numpy."""
    return col.to_numpy(zero_copy_only=False)


def semi(docs: DataFrame, kept: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key is in kept (null equals null), all columns as they were.

    A written list of keys is a few bytes a key and many times that as a broadcast table, so the two meet
    by a shuffle at any size."""
    right = kept.select(F.col(key).alias("__kept_key"))
    return docs.join(by_shuffle(right), docs[key].eqNullSafe(right["__kept_key"]), "left_semi")
