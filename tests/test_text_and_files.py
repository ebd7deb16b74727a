"""Text functions, file readers and writers, streams, and the chain that turns failures into rows."""

import json

import pytest
from pyspark.sql import functions as F

from procmill.functions import text as X
from procmill.operators import pipeline as P
from procmill.sources import files as S
from procmill.streaming import queue as Q


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()[0]


MD = '---\ntitle: "Leave"\nx: 1\n---\n# T\n<!-- c\n-->See [the page](u) ![i](v) **now** and *then* {{< ref "a" >}}\n```py\ncode\n```\n| a | b |\n|---|:-:|\n| 1 | 2 |\n\n| a | b | c | d |\n|--|--|--|--|\n| 1 | 2 | 3 | 4 |\nask @bob or a.b@c.de in #chan, please   \n\n\n\nend'


def test_markdown(spark):
    got = one(spark, X.clean_markdown, MD)
    assert got == "# T\nSee the page  now and then \n\n- a: 1 — 2\n\nask  or  in , please\n\nend".replace("then \n", "then\n")
    assert one(spark, X.frontmatter_title, MD) == "Leave" and one(spark, X.frontmatter_title, "no") == "" and one(spark, X.clean_markdown, None) is None and one(spark, X.clean_markdown, "") == ""


def test_sections(spark):
    text = "intro " * 5 + "\n## One\n" + "w " * 6 + "\n### Small\nx y\n## Two\n" + "z " * 7
    got = one(spark, lambda c: X.sections(c, F.lit("Title"), 5), text)
    assert [(s.title, s.words) for s in got] == [("Title", 5), ("One", 9), ("Two", 7)] and one(spark, lambda c: X.sections(c, F.lit(None).cast("string"), 5), "a b") == []


def test_small_texts(spark):
    assert one(spark, X.slug, "  How-to: Ship  it! ") == "how_to_ship_it" and one(spark, X.word_slug, "_Ärger & co_") == "rger_co"
    assert one(spark, X.label_similarity, "Check Order", "check the order") == pytest.approx(2 / 3) and one(spark, X.label_similarity, "", "!") == 1.0
    assert one(spark, X.without_fence, "```json\n{}\n```") == "{}" and one(spark, X.without_fence, "```\nopen") == "open" and one(spark, X.without_fence, " x ") == "x"
    assert one(spark, lambda c: X.grams(c, 3), "A b, c d") == ["a b c", "b c d"] and one(spark, lambda c: X.grams(c, 3), "a b") == []
    assert one(spark, lambda c: X.joined_tokens(F.split(c, "\\|")), "The|clerk|(|Ann|)|signs|,|then|sends|.") == "The clerk (Ann) signs, then sends."
    assert X.first_object('x {"a": {"b": 1}} {"c": 2}') == '{"a": {"b": 1}}' and X.last_object('x {"a": {"b": 1}} {"c": 2} }') == '{"c": 2}' and X.first_object("{") is None and X.last_object(None) is None
    assert one(spark, lambda c: X.shortened(c, 5), "abcdefgh") == "ab..." and one(spark, lambda c: X.filled("<{a}{b}>", a=c, b=F.lit(None)), "x") == "<x>"


def test_scores(spark):
    t = "The process has steps:\n1. The manager must review it\n2. submit, approve and send it\n3. If the engineer agrees, close it"
    assert one(spark, lambda c: F.struct(X.procedural_score("c0", "c0")), t)[0] == 2 + 2 + 2 + 1 + 2 and one(spark, lambda c: X.convertibility("c0"), t) == "ideal"
    assert one(spark, lambda c: X.procedural_score("c0", "c0"), None) == 0 and one(spark, lambda c: X.convertibility("c0"), None) == "marginal"


def test_readers(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n/01.txt").write_text("Title: One\nfirst line\n\nsecond\n")
    (tmp_path / "n/12.txt").write_text("only")
    (tmp_path / "n/x.txt").write_text("not numbered")
    got = {r.number: r for r in S.numbered_texts(spark, str(tmp_path / "n"), [(1, 10, "low"), (11, 20, "high")]).collect()}
    assert set(got) == {1, 12} and (got[1].title, got[1].raw_text, got[1].origin) == ("One", "first line second", "low") and (got[12].title, got[12].origin) == (None, "high")
    (tmp_path / "h").mkdir()
    (tmp_path / "h/a.txt").write_text("Category: c\nTitle: t\nbody: x\nmore")
    r = S.headed_texts(spark, str(tmp_path / "h")).first()
    assert (r.category, r.title, r.raw_text) == ("c", "t", "body: x\nmore")
    (tmp_path / "m").mkdir()
    for n, s in (("a", "4.5"), ("b", "3"), ("c", "bad")):
        (tmp_path / f"m/{n}.bpmn2.xml").write_text(f"<{n}/>")
        (tmp_path / f"m/{n}.quality.txt").write_text(s)
    (tmp_path / "m/d.bpmn2.xml").write_text("<d/>")
    assert [tuple(r) for r in S.scored_models(spark, str(tmp_path / "m")).collect()] == [("a", "<a/>", 4.5)]
    (tmp_path / "l.jsonl").write_text('{"id": "1", "text": "t", "extra": 5}\nbroken\n\n{"id": "2", "text": "u"}\n')
    got = sorted((tuple(r) for r in S.json_lines(spark, str(tmp_path / "l.jsonl"), ["id", "text"]).collect()), key=str)
    assert got[0] == ("1", "t", '{"extra":"5"}') and ("2", "u", None) in got and len(got) == 3
    (tmp_path / "state.json").write_text(json.dumps({"log_history": [{"step": 1, "epoch": 0.5, "loss": 2.0}, {"step": 1, "epoch": 0.5, "eval_loss": 1.5}]}))
    assert sorted(tuple(r) for r in S.trainer_state(spark, str(tmp_path / "state.json")).collect()) == [("eval", 1, 0.5, 1.5), ("train", 1, 0.5, 2.0)]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/run.log").write_text("examples used 167\n{'eval_loss': 0.5}\n{'eval_loss': 0.4}\n")
    assert tuple(S.training_log(spark, str(tmp_path / "logs")).first()) == ("run.log", 167, 0.4)
    (tmp_path / "md").mkdir()
    (tmp_path / "md/p.md").write_text(MD)
    (tmp_path / "list.json").write_text(json.dumps([{"path": "md/p.md", "score": 41}, {"path": "md/q.md", "score": 10}]))
    assert [r.title for r in S.markdown_pages(spark, str(tmp_path / "md"), str(tmp_path / "list.json")).collect()] == ["Leave"]
    s = spark.createDataFrame([("a", '{"process_number": 1}'), ("b", '{"process_number": 9}'), ("c", None)], "id string, metadata string")
    assert {r.id: r.problem for r in S.models_by_number(s, S.whole_files(spark, str(tmp_path / "n"), "0*.txt")).collect()} == {"a": None, "b": "no file", "c": "no number"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "v1"), (2, "v2")], "id int, version string")
    S.append(df, str(tmp_path / "t"), ["version"])
    S.replace_partitions(spark.createDataFrame([(3, "v2")], df.schema), str(tmp_path / "t"), ["version"])
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "v1"), (3, "v2")]
    S.write_csv(df, str(tmp_path / "c"), "version")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    assert json.loads(S.manifest(df, "x", df.limit(0), "id").first()[0]) == {"label": "x", "n_rows": 2, "n_keys": 2}
    with pytest.raises(Exception, match="held-out"):
        S.manifest(df, "x", df, "id").collect()
    s = spark.createDataFrame([("a", "b", 1)], "source string, stage string, i int")
    assert spark.table(S.stage_view(s, "a", "b")).count() == 1
    with pytest.raises(ValueError):
        S.stage_view(s, "a; drop", "b")


def test_failures_are_rows(spark):
    df = spark.createDataFrame([(1, '{"nodes": [{"id": "a", "type": "task", "name": "A"}], "flows": [{"from": "a", "to": "ghost"}]}'), (2, "no"), (3, None), (4, "")], "id int, body string")
    got = {r.id: r for r in P.json_to_dsl(df, ["id"], "body").collect()}
    assert got[1].status == "succeeded" and "unknown node" in got[1].warnings and all(got[i].status == "convert_failed" and got[i].error_type == "ValueError" for i in (2, 3, 4))
    back = {r.id: r for r in P.dsl_to_xml(spark.createDataFrame([(1, got[1].output), (2, 'process "P" { task "a" -> #x }'), (3, None)], "id int, p string"), ["id"], "p").collect()}
    assert back[1].status == "succeeded" and back[2].status == "transpile_failed" and back[2].error_type == "DslError" and back[3].status == "transpile_failed"


def test_budget():
    import time

    assert P.staged([("slow", lambda t: time.sleep(5))], 0.2)("x")[0][0] == "slow_timeout"
    assert P.shortened("x" * 3000) == "x" * 1997 + "..." and P.shortened(None) is None


def test_stream_equals_batch(spark, tmp_path):
    e = spark.createDataFrame([(1, i, "ab"[i % 2]) for i in range(6)], "user_id long, event_id long, event_type string").withColumn("ts", F.timestamp_seconds("event_id"))
    for i in range(3):
        e.where(f"event_id div 2 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = Q.follows_stream(Q.parquet_stream(spark, str(tmp_path / "in"), e, 10))
    q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_reference_state_from_a_stream(spark, tmp_path):
    from procmill.operators import references as R

    refs = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(6)], "id long, ref string").withColumn("at", F.timestamp_seconds("id"))
    have = spark.createDataFrame([("a",)], "id string").withColumn("at", F.timestamp_seconds(F.lit(1)))
    deltas = [R.reference_deltas(refs.where("id < 3"), "t", "ref", "at"), R.reference_deltas(refs.where("id >= 3"), "t", "ref", "at"), R.existence_deltas(have, "t", "id", "at")]
    for d in deltas:
        d.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    Q.counts_from_deltas(Q.parquet_stream(spark, str(tmp_path / "in"), deltas[0]), str(tmp_path / "state"), str(tmp_path / "log")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "state/v2")).collect()}
    assert got == {tuple(r) for r in R.key_state(*deltas).collect()} and R.current_orphans(spark.read.parquet(str(tmp_path / "state/v2"))).count() == 2


def test_tokens_that_only_begin_or_end_with_a_mark_are_words(spark):
    df = spark.createDataFrame([(["the", ".NET", "self", "-", "made", "a/", "b"],), ([],), (None,), (["x", None, "."],), ([")"],)], "t array<string>")
    assert [r[0] for r in df.select(X.joined_tokens(F.col("t"))).collect()] == ["the .NET self-made a/ b", "", None, "x.", ")"]


def test_parts_of_a_list_lose_their_blanks(spark):
    assert one(spark, lambda c: X.options(c, "|"), " 0a | b0 ||  ") == ["0a", "b0"]


def test_tables_of_each_width(spark):
    table = lambda n: "\n".join("| " + " | ".join(f"{r}{k}" for k in range(n)) + " |" for r in "hab")
    assert one(spark, X.tables_as_lists, f"x\n{table(2)}\ny\n") == "x\n- h0: a0 — a1\n- h0: b0 — b1\ny\n" and one(spark, X.tables_as_lists, table(3)) == "- a0: a1 — a2\n- b0: b1 — b2"
    assert one(spark, X.tables_as_lists, f"x\n{table(4)}\ny") == "x\ny" and one(spark, X.tables_as_lists, "| a | b |\n|---|---|\n| 1 |\nend") == "- 1\nend" and one(spark, X.tables_as_lists, "a | b\nc") == "a | b\nc"
    assert one(spark, X.tables_as_lists, "| a | b |\n" + "| 1 | 2 |\n" * 30_000).count("\n") == 30_000


def test_state_is_never_started_anew_by_a_failed_read(spark, tmp_path):
    """A version that is there but cannot be read, or is not whole, fails the batch; older versions are cleared away."""
    import shutil

    from procmill.operators import references as R

    have = spark.createDataFrame([("a",), ("b",)], "id string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    delta = R.existence_deltas(have, "t", "id", "at")
    where = {k: str(tmp_path / k) for k in ("in", "state", "log")}
    run = lambda: (delta.coalesce(1).write.mode("append").parquet(where["in"]), Q.counts_from_deltas(Q.parquet_stream(spark, where["in"], delta), where["state"], where["log"], buckets=2).awaitTermination())
    run(), run(), run()
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["v1", "v2"] and {r.exists_n for r in spark.read.parquet(where["state"] + "/v2").collect()} == {3}
    for f in (tmp_path / "state/v2").glob("*.parquet"):
        f.write_bytes(b"broken")
    for f in (tmp_path / "state/v2").glob(".*.crc"):
        f.unlink()
    with pytest.raises(Exception):
        run()
    shutil.rmtree(tmp_path / "state")
    with pytest.raises(Exception, match="no complete state"):
        Q.counts_from_deltas(Q.parquet_stream(spark, where["in"], delta), where["state"], where["log"]).awaitTermination()


def test_finished_work_is_not_done_again_after_a_failed_read(spark, tmp_path):
    work = spark.createDataFrame([(1,), (2,)], "id long")
    where = {k: str(tmp_path / k) for k in ("in", "out")}
    work.coalesce(1).write.parquet(where["in"])
    go = lambda log: Q.run_queue(Q.parquet_stream(spark, where["in"], work), where["out"], ["id"], lambda df: df, str(tmp_path / log)).awaitTermination()
    go("a"), go("b")
    assert spark.read.parquet(where["out"]).count() == 2
    for f in (tmp_path / "out").glob("*.parquet"):
        f.write_bytes(b"broken")
    for f in (tmp_path / "out").glob(".*.crc"):
        f.unlink()
    with pytest.raises(Exception):
        go("c")


def test_the_last_object_of_long_broken_answers():
    import time

    plain = lambda t: next((json.dumps(v, ensure_ascii=False, sort_keys=True) for at in range(len(t) - 1, -1, -1) if t[at] == "{" and (v := _read(t, at)) is not None), None)

    def _read(t, at):
        try:
            return json.JSONDecoder().raw_decode(t, at)[0]
        except ValueError:
            return None

    for t in ('{"a": "use {x} here"} tail', '{"a": {"b": 1}, "c": [', 'x {"q": "a \\" {", "z": 2} {', '{"a": "{\\"in\\": 1}"}', '{}{', "{", '{"a": "}"} "{'):
        assert X.last_object(t) == plain(t), t
    t0 = time.time()
    assert X.last_object('{"a": [1, ' * 20_000) is None and time.time() - t0 < 5


def test_views_prefixes_and_stamps(spark):
    from procmill.operators import relational as O

    df = spark.createDataFrame([("1", "web", "raw", "Zenodo/a"), ("2", "web", "clean", "other"), ("3", None, None, None)], "id string, source string, stage string, path string")
    S.stage_view(df, "web", "raw"), S.stage_view(df, "web", "clean")
    assert {"web__clean", "web__raw"} <= set(S.stage_views(spark))
    assert [r.id for r in df.where(O.prefixed("path", "zenodo/")).collect()] == ["1"]
    old = df.select("id", "stage", F.lit("old").alias("updated_at"))
    got = {r.id: (r.stage, r.updated_at) for r in O.update(old, spark.createDataFrame([("2", "done")], "id string, stage string"), ["id"], ["stage"], "updated_at", F.lit("new")).collect()}
    assert got == {"1": ("raw", "old"), "2": ("done", "new"), "3": (None, "old")}
