"""Column kinds and the long (column, value) views the profiler works on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    DateType,
    DecimalType,
    FractionalType,
    IntegralType,
    NumericType,
    StringType,
    StructType,
    TimestampNTZType,
    TimestampType,
)


def string_columns(schema: StructType) -> list[str]:
    return [f.name for f in schema if isinstance(f.dataType, StringType)]


def numeric_columns(schema: StructType) -> list[str]:
    """Numbers only: booleans, dates and timestamps belong to neither kind."""
    return [f.name for f in schema if isinstance(f.dataType, NumericType)]


def name_sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_sql(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def col(name: str):
    return F.col(name_sql(name))


def long_numeric(df: DataFrame, columns: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., column_name, value double), one row per cell, null cells left out."""
    columns = numeric_columns(df.schema) if columns is None else columns
    if not columns:
        raise ValueError("the table has no numeric columns")
    wide = df.selectExpr(*map(name_sql, keep), *[f"double({name_sql(c)}) AS {name_sql(c)}" for c in columns])
    return wide.unpivot(list(keep), [col(c) for c in columns], "column_name", "value").where("value is not null")


def columns_by_kind(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Whole numbers as bigint, fractions as double and everything else as string."""
    kinds: dict[str, list[str]] = {}
    for c in columns:
        t = df.schema[c].dataType
        kind = "bigint" if isinstance(t, IntegralType) else "double" if isinstance(t, FractionalType) and not isinstance(t, DecimalType) else "string"
        kinds.setdefault(kind, []).append(c)
    return kinds


def columns_by_own_kind(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """As ``columns_by_kind``, but dates, times and decimals keep their types."""
    kinds: dict[str, list[str]] = {}
    for kind, names in columns_by_kind(df, columns).items():
        for c in names:
            t = df.schema[c].dataType
            own = isinstance(t, (DateType, TimestampType, TimestampNTZType, DecimalType))
            kinds.setdefault(t.simpleString() if own else kind, []).append(c)
    return kinds


def hashed_alike(schema: StructType) -> bool:
    """Whether rows that are equal in grouping have equal hashes for sure: not with collations, or types that hold others."""
    plain = (NumericType, BooleanType, BinaryType, DateType, TimestampType, TimestampNTZType)
    return all(isinstance(f.dataType, plain) or f.dataType == StringType() for f in schema)


def cells_by_kind(df: DataFrame, columns: list[str] | None = None) -> list[DataFrame]:
    """(column_name, value) cells without nulls, one table per value type.

    Whole numbers stay whole, fractions stay double, times and decimals keep their types and everything else becomes
    text, so values can be counted before any of them is formatted.
    """
    kinds = columns_by_own_kind(df, df.columns if columns is None else columns)
    return [
        df.selectExpr(*[f"CAST({name_sql(c)} AS {kind}) AS {name_sql(c)}" for c in names])
        .unpivot([], [col(c) for c in names], "column_name", "value")
        .where("value is not null")
        for kind, names in kinds.items()
    ]


def wide_to_long(one_row: DataFrame, columns: list[str], metrics: list[str]) -> DataFrame:
    """Turn the single row of a wide aggregate (``<metric>__<i>`` columns) into one row per column.

    Written as SQL text: a table may have thousands of columns, and text costs one call each.
    """
    entries = [
        f"named_struct('column_name', {text_sql(c)}, " + ", ".join(f"'{m}', `{m}__{i}`" for m in metrics) + ")"
        for i, c in enumerate(columns)
    ]
    return one_row.selectExpr(f"inline(array({', '.join(entries)}))")


def aggregate_sql(df: DataFrame, expressions: list) -> DataFrame:
    """A global aggregate of columns or SQL expressions."""
    return df.agg(*[F.expr(e) if isinstance(e, str) else e for e in expressions])
