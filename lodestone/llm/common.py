"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut, shared_dir, table

__all__ = ["WORD", "cut", "free", "held_out", "shared_dir", "slices", "table", "texts"]

#: Spark's bound on the bytes of an Arrow batch, and of a Parquet row group, which a task holds while it writes texts.
BOUNDS = {"spark.sql.execution.arrow.maxBytesPerBatch": "2m", "parquet.block.size": str(32 << 20)}
#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def held_out(key: Column) -> Column:
    """True for the quarter of the rows that no learner may see; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def texts(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the named columns, so that others cannot clash with what an operator adds.

    What goes to a Python worker at a time, and what is held for writing, is bound by bytes, for texts can be long.
    """
    conf = df.sparkSession.conf
    for name, value in BOUNDS.items():
        if conf.get(name, None) != value:
            conf.set(name, value)
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *more)


def free(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many more ``_`` as set it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Each batch in pieces of about ``most`` bytes of the string ``column``; one long text stays whole."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = max(1, batch.column(column).nbytes // n)
        step = max(1, most // size)
        for i in range(0, n, step):
            yield batch.slice(i, step)


