"""References to records that do not exist, kept as signed counts per key.

Every change is a delta of a key of a target table: +1 or -1 reference, +1 or -1 existence. Summed deltas are the state; keys with
references and no existence are the orphans of now. States and deltas merge by the same sum, so a run over new deltas alone brings
a stored state up to date.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

STATE = ("target", "key")


def reference_deltas(rows: DataFrame, target: str, key: str, at: str, sign: int = 1) -> DataFrame:
    """Deltas of rows that refer to `target` by column `key`; null references are none."""
    return rows.where(rows[key].isNotNull()).select(F.lit(target).alias("target"), rows[key].cast("string").alias("key"), F.lit(sign).cast("long").alias("refs"), F.lit(0).cast("long").alias("exists_n"), F.lit(0).cast("long").alias("deleted_n"), rows[at].alias("first_ref"), F.lit(None).cast("timestamp").alias("first_exists"))


def existence_deltas(rows: DataFrame, target: str, key: str, at: str, sign: int = 1) -> DataFrame:
    """Deltas of rows of `target` itself."""
    return rows.where(rows[key].isNotNull()).select(F.lit(target).alias("target"), rows[key].cast("string").alias("key"), F.lit(0).cast("long").alias("refs"), F.lit(sign).cast("long").alias("exists_n"), F.lit(0).cast("long").alias("deleted_n"), F.lit(None).cast("timestamp").alias("first_ref"), rows[at].alias("first_exists"))


def deletion_deltas(log: DataFrame, target: str | None = None, table_col: str = "table_name", key: str = "record_key") -> DataFrame:
    """Marks of keys that a deletion log lists. The log names no surviving row, so it marks and takes nothing away."""
    rows = log.where(log[key].isNotNull() & (F.lit(True) if target is None else log[table_col] == target))
    return rows.select(log[table_col].alias("target"), log[key].cast("string").alias("key"), F.lit(0).cast("long").alias("refs"), F.lit(0).cast("long").alias("exists_n"), F.lit(1).cast("long").alias("deleted_n"), F.lit(None).cast("timestamp").alias("first_ref"), F.lit(None).cast("timestamp").alias("first_exists"))


def key_state(*deltas: DataFrame) -> DataFrame:
    """The state per (target, key): sums of all counts, first reference, first existence. States are deltas too. Map-side sums keep hot keys cheap."""
    return reduce(DataFrame.unionByName, deltas).groupBy(*STATE).agg(F.sum("refs").alias("refs"), F.sum("exists_n").alias("exists_n"), F.sum("deleted_n").alias("deleted_n"), F.min("first_ref").alias("first_ref"), F.min("first_exists").alias("first_exists"))


def current_orphans(state: DataFrame) -> DataFrame:
    """The current orphan report: keys with references and no existence."""
    return state.where("refs > 0 and exists_n <= 0")


def orphan_rows(referring: list[tuple[DataFrame, str, str, str, str, str]], state: DataFrame) -> DataFrame:
    """(table_name, row_id, kind, period), distinct: every referring row whose reference has no target at its own time.

    referring: (rows, table name, id column, key column, time column, target). kind is 'late' if the target exists but its earliest
    time is after the row's, 'deleted' if it does not exist and the deletion log lists it, else 'missing'. period is yyyy-MM of the
    row's time, null without one; without times on both sides nothing is late. State and rows meet in one join by key; keys that no
    row can miss leave the state before the join.
    """
    state = state.where("refs > 0 and (exists_n <= 0 or first_exists > first_ref)").select("target", "key", "exists_n", "deleted_n", "first_exists")
    rows = reduce(DataFrame.unionByName, [d.where(d[key].isNotNull()).select(F.lit(name).alias("table_name"), d[i].cast("long").alias("row_id"), F.lit(target).alias("target"), d[key].cast("string").alias("key"), d[at].alias("at")) for d, name, i, key, at, target in referring])
    kind = F.when(F.col("exists_n") > 0, F.when(F.col("first_exists") > F.col("at"), "late")).when(F.col("deleted_n") > 0, "deleted").otherwise("missing")
    return (
        rows.join(state, ["target", "key"])
        .select("table_name", "row_id", kind.alias("kind"), F.date_format("at", "yyyy-MM").alias("period"))
        .where("kind is not null")
        .distinct()
    )
