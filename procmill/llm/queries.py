"""Queries of this subpackage: name to function of (spark, folder), and their SQL where SQL can say it."""

from __future__ import annotations

from procmill.llm import cross_split, defects, encode, leakage, near_dup, packing, quality
from procmill.session import ship, table


def _on(name: str, f):
    def query(spark, d):
        ship(spark)
        return f(table(spark, d, name))

    return query


def _packing(f):
    def query(spark, d):
        ship(spark)
        return f(table(spark, d, "documents"), table(spark, d, "token_budgets"))

    return query


def _quality(f, *more: str):
    def query(spark, d):
        ship(spark)
        return f(*(table(spark, d, t) for t in ("documents", "common_words", *more)))

    return query


def _pairs(f):
    def query(spark, d):
        ship(spark)
        rows = defects.pair_rows([(table(spark, d, "preprocessing_generations"), "preprocessing_generations", "input_text", "output_text"), (table(spark, d, "json_bpmn_generations"), "json_bpmn_generations", "input_preprocess", "output_json")])
        return f(rows, table(spark, d, "common_words"))

    return query


QUERIES = {
    "p1_found": _on("samples", leakage.found),
    "p1_spans": _on("samples", leakage.spans),
    "p4_found": _pairs(defects.found),
    "p4_labels": _pairs(defects.labels),
    "p5_found": _on("samples", cross_split.found),
    "p5_report": _on("samples", cross_split.report),
    "p6_found": _on("samples", near_dup.found),
    "p6_groups": _on("samples", near_dup.group_report),
    "p7_ids": _on("documents", encode.token_ids),
    "p7_counts": _on("documents", encode.token_counts),
    "p8_packing": _packing(packing.packing),
    "p8_fill": _packing(packing.fill),
    "p9_found": _quality(quality.found, "quality_labels"),
    "p9_outliers": _quality(quality.outliers),
}

SQL: dict[str, str] = {}
