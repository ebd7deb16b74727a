"""Process graphs in Spark: relations of every record straight from its text, without a shuffle; and closures over edge tables."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from procmill.functions import graphs as G
from procmill.session import materialize, ship, spread


def _rows(f: Callable, keys: int, schema: StructType):
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for row in zip(*cols):
                out += [(*row[:keys], *x) for x in f(*row[keys:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(list(zip(*out)) or [()] * len(arrow), arrow)], schema=arrow)

    return run


def expand(df: DataFrame, keys: Sequence[str], inputs: Sequence[str], f: Callable, kinds: str) -> DataFrame:
    """Rows (keys, *f's) for each of the tuples that f(*inputs) gives for a row; f never sees more than one row."""
    ship(df.sparkSession)
    src = df.select(*keys, *[F.col(c).alias(f"_in{i}") for i, c in enumerate(inputs)])
    schema = StructType([src.schema[k] for k in keys] + StructType.fromDDL(kinds).fields)
    return spread(src).mapInArrow(_rows(f, len(keys), schema), schema)


def nodes(df: DataFrame, keys: Sequence[str], text: str, form: str) -> DataFrame:
    def f(t):
        return [(no, pos, n.id, n.kind, G._cat(n), n.name, n.lane) for no, g in enumerate(G.graphs_of(t, form)) for pos, n in enumerate(g.nodes.values())]

    return expand(df, keys, [text], f, "process_no int, pos int, node_id string, kind string, category string, name string, lane string")


def edges(df: DataFrame, keys: Sequence[str], text: str, form: str) -> DataFrame:
    def f(t):
        return [(no, pos, e.id, e.source, e.target, e.condition) for no, g in enumerate(G.graphs_of(t, form)) for pos, e in enumerate(g.edges)]

    return expand(df, keys, [text], f, "process_no int, pos int, edge_id string, source string, target string, condition string")


def follows(df: DataFrame, keys: Sequence[str], text: str, form: str) -> DataFrame:
    """(keys, a, b, n): the direct-follows bag of every record, summed over its processes."""
    def f(t):
        return [(a, b, n) for (a, b), n in sum((G.direct_follows(g) for g in G.graphs_of(t, form)), Counter()).items()]

    return expand(df, keys, [text], f, "a string, b string, n int")


def node_categories(df: DataFrame, keys: Sequence[str], text: str, form: str) -> DataFrame:
    def f(t):
        return list(sum((G.categories(g) for g in G.graphs_of(t, form)), Counter()).items())

    return expand(df, keys, [text], f, "category string, n int")


def messages(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    return expand(df, keys, [text], lambda t: [(a, b, n) for (a, b), n in G.message_flows(t).items()], "a string, b string, n int")


def checks(df: DataFrame, keys: Sequence[str], text: str, form: str) -> DataFrame:
    """Per process: sizes, start, unreachable nodes, components, rule violations, forks and joins, loops, edges to nowhere, warnings."""
    def f(t):
        out = []
        for no, g in enumerate(G.graphs_of(t, form)):
            inner = g.inner()
            roles = Counter(G.gateway_role(inner, i) for i, n in inner.nodes.items() if "Gateway" in n.kind)
            out.append((no, len(g.nodes), len(g.edges), len(g.edges) - len(inner.edges), G.start_of(inner), len(G.unreachable(inner)), len(G.components(inner)), G.rule_violations(inner), roles["fork"] + roles["both"], roles["join"] + roles["both"], len(G.back_edge_targets(inner)), len(G.split_implicit(inner).nodes) - len(inner.nodes), len(g.warnings)))
        return out

    return expand(df, keys, [text], f, "process_no int, n_nodes int, n_edges int, n_dangling int, start string, n_unreachable int, n_components int, n_violations int, n_forks int, n_joins int, n_loops int, n_implicit_splits int, n_warnings int")


def join_points(df: DataFrame, keys: Sequence[str], text: str, form: str) -> DataFrame:
    def f(t):
        return [(no, i, G.join_point(g, i)) for no, g in enumerate(G.graphs_of(t, form)) for i, n in g.nodes.items() if "Gateway" in n.kind and G.gateway_role(g, i) in ("fork", "both")]

    return expand(df, keys, [text], f, "process_no int, fork string, join_id string")


_COMPARED = "df_precision double, df_recall double, df_f1 double, df_strict_precision double, df_strict_recall double, df_strict_f1 double, mf_precision double, mf_recall double, mf_f1 double, label_share double, nodes_match int, df_exact int, df_ref_size int, df_cand_size int, n_missing int, n_extra int, node_delta int, parse_error string"


def compared(df: DataFrame, keys: Sequence[str], reference: str, candidate: str, ref_form: str = "xml", cand_form: str = "xml", least: float = 0.5) -> DataFrame:
    """All measures of the candidate text against the reference text of each row."""
    def f(r, c):
        return [tuple(G.compare(r, c, ref_form, cand_form, least).values())]

    return expand(df, keys, [reference, candidate], f, _COMPARED)


def compared_at(df: DataFrame, keys: Sequence[str], reference: str, candidate: str, thresholds: Sequence[float], ref_form: str = "xml", cand_form: str = "xml") -> DataFrame:
    """(keys, threshold, df_f1): direct-follows F1 under alignments at several label thresholds, from one reading of each text."""
    def f(r, c):
        return list(G.f1_at(r, c, thresholds, ref_form, cand_form))

    return expand(df, keys, [reference, candidate], f, "threshold double, df_f1 double")


def of_edges(df: DataFrame, keys: Sequence[str], graph: str, kinds: dict[str, str], f: Callable, schema: str) -> DataFrame:
    """f's rows of one graph per row, given as JSON {"nodes": [name], "edges": [[name, name]]}; names are ids, tasks but for `kinds`."""
    def run(text):
        x = json.loads(text)
        g = G.Graph("", {i: G.Node(i, kinds.get(i, "task"), i) for i in x["nodes"]}, [G.Edge(f"e{k}", a, b) for k, (a, b) in enumerate(x["edges"])])
        return f(g)

    return expand(df, keys, [graph], run, schema)


def best_scores(pairs: DataFrame, item: Sequence[str], tie: str) -> DataFrame:
    """Of a candidate's comparisons with several references the one with the highest F1, ties by `tie`; all measures from that one."""
    from procmill.operators.relational import best

    return best(pairs, item, "df_f1", [tie])


def closure(edges: DataFrame, starts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, start, node): everything reachable along edges (keys, source, target) from starts (keys, start), the start itself only by
    a way back. For edge tables of any size: every round joins the newest nodes with the edges and is written to the shared folder;
    rounds are as many as the longest shortest way."""
    k = list(keys)
    e = edges.select(*k, "source", "target").distinct()
    new = materialize(starts.join(e.withColumnRenamed("source", "start"), [*k, "start"]).select(*k, "start", F.col("target").alias("node")).distinct(), "reached")
    known = new
    while not new.isEmpty():
        step = new.join(e.withColumnRenamed("source", "node"), [*k, "node"]).select(*k, "start", F.col("target").alias("node")).distinct()
        new = materialize(step.join(known, [*k, "start", "node"], "left_anti"), "reached")
        known = known.union(new)
    return known


def anchoring(df: DataFrame, keys: Sequence[str], model: str, source: str, form: str) -> DataFrame:
    """(keys, n_words, n_anchored, share): the distinct words of a model's activity labels, and those that its source text has too."""
    def f(m, s):
        labels = {x for g in G.graphs_of(m, form) for n in g.nodes.values() if G._cat(n) for x in G.normal_label(n.name).split()}
        hit = labels & set(G.normal_label(s or "").split())
        return [(len(labels), len(hit), len(hit) / len(labels))] if labels else []

    return expand(df, keys, [model, source], f, "n_words int, n_anchored int, share double")
