"""Texts for rules that the tables' own texts never meet: a row per part, one of a list of sentences by its number, and what SQL expects of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import table


def quoted(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"{value!r}::DOUBLE" if isinstance(value, float) else str(value).lower() if isinstance(value, bool) else str(value)


def pick(values: list, k: Column) -> Column:
    """The value of a list at k modulo its length."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def parts(spark, d, **texts: list[str]) -> DataFrame:
    """(k, ...): per part a sentence of each list, ``#`` in it replaced by the part's number."""
    k = F.col("p_partkey").cast("long")
    return table(spark, d, "part").select(k.alias("k"), *[F.replace(pick(v, k), F.lit("#"), k.cast("string")).alias(n) for n, v in texts.items()])


def expected(rows: list[tuple], names: str) -> str:
    """A common table ``x`` (k, names): per part the row at its number modulo their count, ``#`` in texts replaced."""
    cols = [c.strip() for c in names.split(",")]
    values = ", ".join(f"({i}, {', '.join(map(quoted, r))})" for i, r in enumerate(rows))
    out = [f"replace({c}, '#', p_partkey::VARCHAR) AS {c}" if any(isinstance(r[i], str) for r in rows) else c for i, c in enumerate(cols)]
    return f"x AS (SELECT p_partkey::BIGINT AS k, {', '.join(out)} FROM part JOIN (VALUES {values}) v(i, {names}) ON p_partkey % {len(rows)} = i)"
