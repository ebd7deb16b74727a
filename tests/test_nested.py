"""Nested models into flat tables, against plain recursion."""

import json

import brute_models as B
import pytest

from procmill.functions.models import record_of_json, record_of_xml, read_json
from procmill.operators import nested as N

MODEL = {"pool": "P", "lanes": [{"name": "Clerk", "refs": ["a", 2, "ghost"]}], "nodes": [{"id": "a"}, {"id": 2, "nodes": [{"id": "in", "nodes": [{"id": "deep"}]}], "flows": [{"source": "in", "target": "deep"}]}], "flows": [{"id": "f", "from": "a", "to": 2}]}
XML = '<d:definitions xmlns:d="u"><d:process id="p"><d:laneSet><d:lane id="l"><d:flowNodeRef> t </d:flowNodeRef><d:childLaneSet><d:lane id="k"/></d:childLaneSet></d:lane></d:laneSet><d:task id="t"><d:documentation>x</d:documentation></d:task><d:subProcess id="s"><d:task id="u"/></d:subProcess><d:sequenceFlow id="f" sourceRef="t" targetRef="s"/></d:process></d:definitions>'
TEXTS = [
    json.dumps(MODEL), "﻿" + json.dumps(MODEL), json.dumps(json.dumps(MODEL)), "Here it is:\n```json\n" + json.dumps(MODEL) + "\n```", json.dumps({"processos": [MODEL, MODEL]}), json.dumps({"processes": MODEL}),
    json.dumps(MODEL)[:-1], json.dumps(MODEL).replace("[", "[,", 1), "null", "[]", "{}", "", "   ", None, "no model", '"half', '{"nodes": 3}', '{"nodes": [{"id": null}, 5]}', "{" * 5000,
]


def rows(spark, texts, form="json"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, body string")
    return {tuple(r) for r in N.model_elements(N.model_documents([(df, "o", "id", "body", form)])).collect()}


def test_all_wrappings_agree(spark):
    got = rows(spark, TEXTS)
    for i in range(4):
        assert {r[2:] for r in got if r[1] == str(i)} == B.from_json(TEXTS[0])
    assert {r[2] for r in got if r[1] == "4"} == {0, 1}
    assert {r[2:] for r in got if r[1] == "5"} == B.from_json(TEXTS[0])
    assert not {r for r in got if int(r[1]) >= 6}, "broken and empty texts give nothing"
    assert (0, "lane", "Clerk", "") in {r[2:] for r in got} and (0, "node", "deep", "in") in {r[2:] for r in got} and (0, "source", "f_in_deep", "in") in {r[2:] for r in got}


def test_xml(spark):
    got = {r[2:] for r in rows(spark, [XML, XML[:-5], "", None, "<a/>"], "xml")}
    assert got == B.from_xml(XML) and (0, "lane", "k", "l") in got and (0, "node", "u", "s") in got


def test_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1, TEXTS[0])] * 3, "id long, body string")
    assert N.model_elements(N.model_documents([(df, "o", "id", "body", "json")])).count() == len(B.from_json(TEXTS[0]))
    assert rows(spark, []) == set() and rows(spark, [None, ""]) == set()


def test_generic_levels_carry_keys_and_ordinals(spark):
    df = spark.createDataFrame([("r", '{"orders": [{"id": "o1", "lines": [{"sku": "x", "tags": ["t1", "t2"]}, {"sku": "y"}]}, {"id": "o2", "meta": {"notes": ["n"]}}], "odd `key": [1.5]}'), ("bad", "{"), (None, None)], "k string, doc string")
    schema = N.infer_schema(df, "doc")
    t = {(r.level, r.sk): r for r in N.explode_levels(df, "doc", schema, ("k",), ("sku",)).collect()}
    assert t["orders.lines", "/orders:0/lines:1"].sku == "y" and t["orders.lines", "/orders:0/lines:1"].parent_id == "o1"
    assert t["orders.lines.tags", "/orders:0/lines:0/tags:1"].value == "t2" and t["orders.lines.tags", "/orders:0/lines:0/tags:1"].parent_sk == "/orders:0/lines:0"
    assert t["orders.meta.notes", "/orders:1/notes:0"].value == "n" and t["odd `key", "/odd `key:0"].value == "1.5"


def test_clashing_kinds_become_strings(spark):
    df = spark.createDataFrame([('{"a": [{"x": 1}]}',), ('{"a": [{"x": "s"}]}',), ('{"a": [{"x": {"y": 2}}]}',)], "doc string")
    out = N.explode_levels(df, "doc", N.infer_schema(df, "doc"), (), ("x",))
    assert sorted(r.x for r in out.collect()) == ["1", "s", '{"y":2}']


def test_sample_data_against_recursion(spark):
    import pyarrow.parquet as pq

    from procmill import queries as Q

    d = "/root/testdata/sf0.001"
    want = set()
    s, g = pq.read_table(f"{d}/samples.parquet").to_pylist(), pq.read_table(f"{d}/json_bpmn_generations.parquet").to_pylist()
    for origin, f, table, column in (("samples.bpmn_json", B.from_json, s, "bpmn_json"), ("samples.xml", B.from_xml, s, "xml"), ("json_bpmn_generations.output_json", B.from_json, g, "output_json")):
        want |= {(origin, str(r["id"]), *x) for r in table for x in f(r[column])}
    assert {tuple(r) for r in Q.p2_found(spark, d).collect()} == want


@pytest.mark.parametrize("text,want", [("[1, 2", None), ('x {"a": 1} y', {"a": "1"}), ("true", True), ('"\\"5\\""', "5")])
def test_reading(text, want):
    assert read_json(text) == want


def test_numbers_keep_their_writing():
    assert '"1.50"' in record_of_json('{"nodes": [{"id": 1.50}]}') and record_of_xml("<x") is None


def test_nothing_of_a_record_is_lost(spark):
    """Unknown fields and arrays come out as columns and tables of their own, in JSON and in XML."""
    odd = {"pool": "P", "version": 3, "messages": [{"from": "a", "to": "b", "label": "m"}], "lanes": {"id": "l", "refs": "a"}, "nodes": [{"id": "a", "type": "task", "name": "A", "props": [{"k": "x", "v": True}, {"k": "y"}], "from": {"deep": [1, 2]}}, {"id": "b", "cost": 1.50}], "flows": [{"from": "a", "to": "b", "cond": "ok", "label": "L"}]}
    df = spark.createDataFrame([(1, json.dumps({"processes": [odd], "author": "me"}), "<x xmlns:z='u'><process id='p' name='N'><task id='t' name='T' z:extra='e'><documentation>why</documentation></task><sequenceFlow id='f' sourceRef='t' targetRef='t' name='n'><conditionExpression>c &gt; 1</conditionExpression></sequenceFlow></process></x>")], "id long, body string, xml string")
    docs = N.model_documents([(df, "j", "id", "body", "json"), (df, "x", "id", "xml", "xml")])
    schema = N.infer_schema(docs, "doc")
    assert set(N.levels(schema)) == {f"processes{x}" for x in ("", ".lanes", ".lanes.refs", ".nodes", ".nodes.props", ".nodes.from_.deep", ".flows", ".messages")}
    t = lambda level: [r.asDict() for r in N.child_table(docs, "doc", schema, ("origin",), level).orderBy("origin", "sk").collect()]
    nodes = t("processes.nodes")
    assert (nodes[0]["type"], nodes[0]["name"], nodes[1]["cost"]) == ("task", "A", "1.5") or nodes[1]["cost"] == "1.50"
    assert nodes[2]["extra"] == "e" and nodes[2]["doc"] == "why" and nodes[2]["type"] == "task"
    assert [(r["k"], r["v"], r["parent_sk"]) for r in t("processes.nodes.props")] == [("x", "true", "/processes:0/nodes:0"), ("y", None, "/processes:0/nodes:0")]
    assert [r["value"] for r in t("processes.nodes.from_.deep")] == ["1", "2"] and t("processes.messages")[0]["label"] == "m"
    flows = t("processes.flows")
    assert (flows[0]["cond"], flows[0]["label"], flows[1]["condition"], flows[1]["name"]) == ("ok", "L", "c > 1", "n") and t("processes")[0]["version"] == "3"
    assert {r.kind for r in N.model_elements(docs).where("origin = 'j'").collect()} == {"lane", "member", "node", "source", "target"}
