"""Table schemas: bringing rows into one, adding columns once, rebuilding a stored table under checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from procmill.session import exists, names_in


def as_type(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def conform(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """The columns of the schema in its order and types; columns that df lacks are null, others are left out."""
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in as_type(schema)])


def add_column(df: DataFrame, name: str, kind: str, default=None) -> DataFrame:
    """df with the column, filled with the default; as it is if it has the column in this type. Another type there is an error."""
    if name in df.columns:
        have, want = df.schema[name].dataType, T.StructType.fromDDL(f"`{name}` {kind}")[0].dataType
        if have != want:
            raise ValueError(f"{name} is {have.simpleString()}, not {want.simpleString()}")
        return df
    return df.withColumn(name, F.lit(default).cast(kind))


def check(df: DataFrame, required: Sequence[str] = (), unique: Sequence[str] = (), references: Sequence[tuple[str, DataFrame, str]] = ()) -> dict[str, int]:
    """How many rows break each rule: null in a required column, a repeated unique key, a reference (column, table, its column) to nothing."""
    out = {f"null {c}": df.where(F.col(c).isNull()).count() for c in required}
    if unique:
        out[f"repeated {', '.join(unique)}"] = df.groupBy(*unique).count().where("count > 1").count()
    for c, table, key in references:
        out[f"{c} without {key}"] = df.where(F.col(c).isNotNull()).join(table.select(F.col(key).alias(c)), c, "left_anti").count()
    return out


def rebuild(df: DataFrame, path: str, schema: T.StructType | str, rows: int | None = None, **rules) -> DataFrame:
    """Writes df in the schema to a new folder and gives the table, if it has as many rows as it must (those of df, if not said) and breaks
    no rule of `check`; else nothing stays written. A folder that holds files is refused, so the old table is there until the new one is."""
    spark = df.sparkSession
    if exists(spark, path) and names_in(spark, path):
        raise ValueError(f"{path} is not empty")
    new = conform(df, schema)
    want = new.count() if rows is None else rows
    broken = {k: n for k, n in check(new, **rules).items() if n}
    if broken:
        raise ValueError(f"rows that break rules: {broken}")
    new.write.mode("overwrite").parquet(path)
    got = spark.read.schema(new.schema).parquet(path)
    if (n := got.count()) != want:
        from procmill.session import remove

        remove(spark, path)
        raise ValueError(f"{n} rows instead of {want}")
    return got
