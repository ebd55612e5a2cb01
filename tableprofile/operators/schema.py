"""Column kinds, and one-pass aggregates that return one row per column."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import value_or_null
from ..functions.names import column

NUMERIC, TEXT, DATE, OTHER = "numeric", "text", "date", "other"

# Text this long or longer enters a grouping as its SHA-256 digest (64 hex digits),
# so that the bytes shuffled per value have a bound. Shorter text never has 64
# characters, so text and digests cannot be mixed up.
DIGEST_BYTES = 64


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if isinstance(data_type, T.StringType):
        return TEXT
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATE
    return OTHER


def fields_of_kind(df: DataFrame, kind: str) -> list[T.StructField]:
    return [f for f in df.schema.fields if kind_of(f.dataType) == kind]


def bounded_key(text: Column) -> Column:
    """Text of fewer than ``DIGEST_BYTES`` bytes as it is, longer text as its digest."""
    return F.when(F.octet_length(text) < DIGEST_BYTES, text).otherwise(F.sha2(text, 256))


def comparable(field: T.StructField) -> Column:
    """The column in a form that can be grouped, equal exactly when the values are."""
    c = value_or_null(field)
    if isinstance(field.dataType, T.StringType):
        return bounded_key(c)
    if isinstance(field.dataType, T.BinaryType):
        return bounded_key(F.hex(c))
    if isinstance(field.dataType, T.MapType):
        c = F.array_sort(F.map_entries(c))
    if isinstance(field.dataType, (T.MapType, T.ArrayType, T.StructType)):
        return F.when(
            c.isNotNull(), bounded_key(F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}))
        )
    return c


def column_array(fields: Sequence[T.StructField], metrics: Mapping[str, Callable[[T.StructField], Column]]) -> Column:
    """An array with one struct per field: its name and the given aggregates."""
    return F.array(
        *(
            F.struct(F.lit(f.name).alias("column"), *(make(f).alias(name) for name, make in metrics.items()))
            for f in fields
        )
    )


def per_column(
    df: DataFrame,
    fields: Sequence[T.StructField],
    metrics: Mapping[str, Callable[[T.StructField], Column]],
) -> DataFrame:
    """One row per field with the given aggregates, all from a single scan.

    The partial aggregates have one row per task, so only those rows are shuffled.
    """
    if not fields:
        # No column of the wanted kind: the same result columns, and no rows.
        nothing = df.sparkSession.range(0, 0, 1, 1)
        return per_column(nothing, nothing.schema.fields, metrics).where(F.lit(False))
    return df.agg(column_array(fields, metrics).alias("rows")).select(F.inline("rows"))


def one_row(df: DataFrame) -> DataFrame:
    """A frame of one row in one partition, to put literals on."""
    return df.sparkSession.range(0, 1, 1, 1)


def schema_rows(df: DataFrame) -> DataFrame:
    """The schema as a table: column, position, dtype, kind."""
    rows = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(i).cast("long").alias("position"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.lit(kind_of(f.dataType)).alias("kind"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return one_row(df).select(F.inline(F.array(*rows)))


def union_aligned(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of the parts; a column that a part lacks is null there.

    A column that is text in one part and something else in another is text in the result,
    as is one whose types Spark cannot widen to a common one. Known from the schemas alone.
    """
    kinds: dict[str, set[str]] = {}
    for part in parts:
        for f in part.schema.fields:
            if not isinstance(f.dataType, T.NullType):
                kinds.setdefault(f.name, set()).add(kind_of(f.dataType) if kind_of(f.dataType) != OTHER else f.dataType.simpleString())
    as_text = {name for name, found in kinds.items() if len(found) > 1}
    aligned = [
        part.select(*(column(f.name).cast("string").alias(f.name) if f.name in as_text else column(f.name) for f in part.schema.fields))
        for part in parts
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)
