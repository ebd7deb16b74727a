"""Deeply nested records into related flat tables.

A merged schema is inferred over all records (one distributed aggregate, the driver sees only the schema), then every array level
is exploded into a child table whose rows carry their own surrogate key, their parent's and their ordinal. All levels come out of a
single pass over the records, in one tall table with a `level` column; a child table is a filter on it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from procmill.functions.models import record_batches
from procmill.session import materialize, spread

ROW = "level string, sk string, parent_sk string, root_no int, ordinal int, parent_id string, id string, {} value string"


# ---- schema ----

def _parse_type(s: str, i: int) -> tuple[T.DataType, int]:
    if s.startswith("OBJECT<", i):
        i += 7
        fields = []
        while s[i] != ">":
            if s[i] == "`":
                j, name = i + 1, ""
                while True:
                    if s[j] == "`" and s[j + 1 : j + 2] == "`":
                        name, j = name + "`", j + 2
                    elif s[j] == "`":
                        break
                    else:
                        name, j = name + s[j], j + 1
                i = j + 1
            else:
                m = re.compile(r"[^:`<>,]+").match(s, i)
                name, i = m.group(), m.end()
            kind, i = _parse_type(s, i + 2)  # past ": "
            fields.append(T.StructField(name, kind))
            if s.startswith(", ", i):
                i += 2
        return T.StructType(fields), i + 1
    if s.startswith("ARRAY<", i):
        kind, i = _parse_type(s, i + 6)
        return T.ArrayType(kind), i + 1
    m = re.compile(r"[A-Z_]+(\([0-9, ]*\))?").match(s, i)
    return T.StringType(), m.end()


def schema_of_variant(described: str) -> T.DataType:
    """The type that schema_of_variant describes; all scalars, and values of clashing kinds, become strings."""
    return _parse_type(described, 0)[0]


def infer_schema(df: DataFrame, col: str) -> T.DataType | None:
    """The merged schema of all JSON texts in `col`; None if there are none. Texts that are not well-formed count for nothing."""
    said = df.agg(F.expr(f"schema_of_variant_agg(try_parse_json(`{col}`))").alias("s")).first()["s"]
    kind = schema_of_variant(said) if said else None
    return kind if isinstance(kind, (T.StructType, T.ArrayType)) else None


def pruned(kind: T.DataType, fields: tuple[str, ...], arrays: tuple[str, ...] | None = None) -> T.DataType:
    """The schema with only these scalar fields, and these arrays (all, if None): what from_json need not build."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(pruned(kind.elementType, fields, arrays))
    if not isinstance(kind, T.StructType):
        return kind
    out = []
    for f in kind.fields:
        if isinstance(f.dataType, T.ArrayType):
            if arrays is None or f.name in arrays:
                out.append(T.StructField(f.name, pruned(f.dataType, fields, arrays)))
        elif isinstance(f.dataType, T.StructType):
            if (inner := pruned(f.dataType, fields, arrays)).fields:
                out.append(T.StructField(f.name, inner))
        elif f.name in fields:
            out.append(f)
    return T.StructType(out)


def levels(kind: T.DataType | None, level: str = "") -> dict[str, tuple[str, ...]]:
    """The array levels of a schema by their dotted paths, each with the scalar fields of its items."""
    if isinstance(kind, T.ArrayType):
        name = level or "items"
        inner = kind.elementType
        own = tuple(f.name for f in inner.fields if not isinstance(f.dataType, (T.ArrayType, T.StructType))) if isinstance(inner, T.StructType) else ()
        return {name: own} | (levels(inner, f"{name}.items" if isinstance(inner, T.ArrayType) else name))
    out: dict[str, tuple[str, ...]] = {}
    for f in kind.fields if isinstance(kind, T.StructType) else []:
        out |= levels(f.dataType, f"{level}.{f.name}" if level else f.name)
    return out


# ---- explosion ----

def _scalar(e: Column, kind: T.DataType, name: str) -> Column:
    if isinstance(kind, T.StructType) and name in kind.names and isinstance(kind[name].dataType, T.StringType):
        return e.getField(name)
    return F.lit(None).cast("string")


def _level(items: Column, kind: T.DataType, level: str, parent_sk: Column, parent_id: Column, root_no: Column | None, fields: tuple[str, ...]) -> Column:
    """array of ROW: the items of one array level and, recursively, of all levels below it."""
    def row(e: Column, i: Column) -> Column:
        sk = F.concat(parent_sk, F.lit(f"/{level.rpartition('.')[2]}:"), i.cast("string"))
        root = i if root_no is None else root_no
        scalar = not isinstance(kind, (T.StructType, T.ArrayType))
        own_id = F.lit(None).cast("string") if scalar else F.coalesce(F.nullif(_scalar(e, kind, "id"), F.lit("")), *([F.nullif(_scalar(e, kind, "name"), F.lit(""))] if level.endswith("lanes") else []))
        own = F.struct(
            F.lit(level).alias("level"), sk.alias("sk"), parent_sk.alias("parent_sk"), root.cast("int").alias("root_no"), i.cast("int").alias("ordinal"), parent_id.alias("parent_id"), (F.lit(None).cast("string") if scalar else _scalar(e, kind, "id")).alias("id"),
            *[_scalar(e, kind, f).alias(f) for f in fields], (e if scalar else F.lit(None)).cast("string").alias("value"),
        )
        below = _below(e, kind, level, sk, own_id, root, fields)
        return F.concat(F.array(own), *below) if below else F.array(own)

    return F.coalesce(F.flatten(F.transform(F.coalesce(items, F.array().cast(T.ArrayType(kind))), row)), F.array().cast(f"array<struct<{_row_type(fields)}>>"))


def _below(e: Column, kind: T.DataType, level: str, sk: Column, own_id: Column, root: Column | None, fields: tuple[str, ...]) -> list[Column]:
    if isinstance(kind, T.ArrayType):
        return [_level(e, kind.elementType, f"{level}.items" if level else "items", sk, own_id, root, fields)]
    out = []
    for f in kind.fields if isinstance(kind, T.StructType) else []:
        name = f"{level}.{f.name}" if level else f.name
        if isinstance(f.dataType, T.ArrayType):
            out.append(_level(e.getField(f.name), f.dataType.elementType, name, sk, own_id, root, fields))
        elif isinstance(f.dataType, T.StructType):  # an object adds no rows of its own; the arrays in it hang on the same parent
            out += _below(e.getField(f.name), f.dataType, name, sk, own_id, root, fields)
    return out


def _row_type(fields: tuple[str, ...]) -> str:
    return ROW.format("".join(f"`{f}` string, " for f in fields)).replace(" string", ": string").replace(" int", ": int")


def explode_levels(df: DataFrame, col: str, schema: T.DataType | None, keys: tuple[str, ...], fields: tuple[str, ...] = ()) -> DataFrame:
    """One row for each item of each array level in the JSON texts of `col`.

    keys: columns of df that name the record; they come first in the result. fields: scalar fields of the items that come out as
    columns. Besides: level (dotted path of the array), sk and parent_sk (surrogate keys, unique within the record), root_no
    (ordinal at the outermost level), ordinal, id, parent_id (`id` of the parent item) and value (of items that are scalars).
    Null texts, texts that are not well-formed, empty arrays and an empty df give no rows; schema None (nothing to infer) too.
    """
    out = [df[k] for k in keys]
    if schema is None:
        return df.where("false").select(*out, F.expr(f"cast(null as struct<{_row_type(fields)}>)").alias("r")).select(*keys, "r.*")
    schema = pruned(schema, ("id", *fields))
    doc = F.from_json(F.col(col), schema)
    rows = _below(doc, schema, "", F.lit("").cast("string"), F.lit(None).cast("string"), None, fields)
    if not rows:
        return explode_levels(df, col, None, keys, fields)
    return df.select(*out, F.explode(F.concat(*rows) if len(rows) > 1 else rows[0]).alias("r")).select(*keys, "r.*")


def child_table(df: DataFrame, col: str, schema: T.DataType | None, keys: tuple[str, ...], level: str) -> DataFrame:
    """One array level as a table of its own: the record's keys, sk, parent_sk, ordinal, and every scalar field of its items as a column
    (fields named like one of these get an underscore), or `value` where items are scalars."""
    fields = levels(schema).get(level, ())
    rows = explode_levels(df, col, schema, keys, tuple(f for f in fields if f != "id")).where(F.col("level") == level)
    taken = {*keys, "sk", "parent_sk", "ordinal"}
    return rows.select(*keys, "sk", "parent_sk", "ordinal", *[F.col(f"`{f}`").alias(f"{f}_" if f in taken else f) for f in fields], *([] if fields else ["value"]))


# ---- process models ----

#: Levels and fields that say what a model is made of.
PARTS, NAMES = ("processes", "lanes", "nodes", "flows", "refs"), ("name", "from", "source", "to", "target")


def model_documents(sources: list[tuple[DataFrame, str, str, str, str]]) -> DataFrame:
    """(origin, record_key, doc) of all records that hold a process model, read once and written to the shared folder.

    sources: (table, origin, key column, text column, form)."""
    parts = None
    for df, origin, key, text, form in sources:
        one = df.select(F.lit(origin).alias("origin"), df[key].cast("string").alias("record_key"), F.lit(form).alias("form"), df[text].alias("text")).where("text is not null")
        parts = one if parts is None else parts.unionByName(one)
    return materialize(spread(parts).mapInArrow(record_batches, "origin string, record_key string, doc string"), "records")


def model_rows(docs: DataFrame) -> DataFrame:
    """The tall table of all levels of the records, whatever arrays they have."""
    return explode_levels(docs, "doc", infer_schema(docs, "doc"), ("origin", "record_key"), NAMES)


def model_elements(docs: DataFrame) -> DataFrame:
    """Lanes, nodes, lane members and flow ends, distinct: (origin, record_key, process_no, kind, element_id, parent_id).

    A lane's or node's parent is the lane or node that encloses it, or ''. A lane without id goes by its name, a flow without one by
    f_<source>_<target>; from and to are source and target. Elements without any id give no row, nor do flow ends that name no node.
    Repeated records collapse.
    """
    schema = infer_schema(docs, "doc")
    tall = explode_levels(docs, "doc", pruned(schema, ("id", *NAMES), PARTS) if schema else None, ("origin", "record_key"), NAMES)
    some = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs])
    last, above = F.element_at(F.split("level", r"\."), -1), F.element_at(F.split("level", r"\."), -2)
    own, source, target = some("id"), some("from", "source"), some("to", "target")
    flow = F.coalesce(own, F.concat(F.lit("f_"), F.coalesce(source, F.lit("")), F.lit("_"), F.coalesce(target, F.lit(""))))
    parent = F.when(above == last, F.coalesce("parent_id", F.lit(""))).otherwise(F.lit(""))
    row = lambda kind, element, up: F.struct(F.lit(kind).alias("kind"), element.alias("element_id"), up.alias("parent_id"))
    rows = (
        F.when(last == "lanes", F.array(row("lane", some("id", "name"), parent)))
        .when(last == "nodes", F.array(row("node", own, parent)))
        .when(last == "refs", F.array(row("member", F.col("value"), F.col("parent_id"))))
        .when(last == "flows", F.array(row("source", flow, source), row("target", flow, target)))
    )
    return (
        tall.where(F.col("level").startswith("processes"))
        .select("origin", "record_key", F.col("root_no").alias("process_no"), F.explode(rows).alias("e"))
        .select("origin", "record_key", "process_no", "e.kind", "e.element_id", "e.parent_id")
        .where("element_id is not null and parent_id is not null")
        .distinct()
    )
