"""The deterministic chain JSON -> program -> XML as rows: failures are data, a row has a budget, nothing is thrown.

Every stage is one pass of Arrow batches; a row's result never depends on other rows, so the chain needs no shuffle.
"""

from __future__ import annotations

import signal
import threading
import traceback
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from procmill.functions import codecs, dsl
from procmill.functions import graphs as G
from procmill.operators.graphs import expand

LONGEST = 2000


def shortened(text: str | None, longest: int = LONGEST, mark: str = "...") -> str | None:
    """At most `longest` characters, the last ones a mark where some were cut."""
    return text if text is None or len(text) <= longest else text[: longest - len(mark)] + mark


class Timeout(Exception):
    pass


def within(seconds: float, f: Callable, *args):
    """f(*args), stopped by Timeout after so many seconds (on a main thread, as Python workers have; elsewhere it just runs)."""
    if seconds <= 0 or threading.current_thread() is not threading.main_thread():
        return f(*args)

    def stop(*_):
        raise Timeout(f"more than {seconds:g} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return f(*args)
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


_FAILED = "status string, output string, warnings string, error_stage string, error_type string, error_message string, error_traceback string"


def staged(stages: Sequence[tuple[str, Callable]], seconds: float = 30.0) -> Callable:
    """text -> [(status, output, warnings, error...)]: the stages in turn, each given the result before; each may return (result, warnings).

    status is succeeded, <stage>_failed or <stage>_timeout.
    """
    def run(text):
        stage, warnings = stages[0][0], []

        def all_of():
            nonlocal stage
            value = text
            for stage, f in stages:
                value = f(value)
                if isinstance(value, tuple):
                    value, said = value
                    warnings.extend(said)
            return value

        join = lambda: shortened(" | ".join(dict.fromkeys(warnings))) or None
        try:
            return [("succeeded", within(seconds, all_of), join(), None, None, None, None)]
        except Timeout as e:
            return [(f"{stage}_timeout", None, join(), stage, "Timeout", str(e), None)]
        except Exception as e:  # noqa: BLE001 - whatever a document does is its own row's result
            return [(f"{stage}_failed", None, join(), stage, type(e).__name__, shortened(str(e)), shortened(traceback.format_exc()))]

    return run


def _read(text):
    graphs = G.graphs_of_json(text)
    if not graphs:
        raise ValueError("no process model in the text")
    return graphs, [w for g in graphs for w in g.inner().warnings]


def _write(graphs):
    return dsl.write(graphs)


def _checked(text):
    dsl.parse(text)
    return text


def _compile(text):
    return dsl.compile_program(dsl.parse(text))


def _emit(program):
    graphs, messages = program
    return codecs.to_xml(graphs, messages, with_layout=True)


def _sound(xml):
    found = codecs.xml_findings(xml)
    if found:
        raise ValueError("; ".join(found))
    return xml


def json_to_dsl(df: DataFrame, keys: Sequence[str], text: str, seconds: float = 30.0) -> DataFrame:
    """(keys, status, output = program, warnings, error_...): stages convert, write and parse."""
    return expand(df, keys, [text], staged([("convert", _read), ("write", _write), ("parse", _checked)], seconds), _FAILED)


def dsl_to_xml(df: DataFrame, keys: Sequence[str], text: str, seconds: float = 30.0) -> DataFrame:
    return expand(df, keys, [text], staged([("transpile", _Splat(_compile)), ("emit", _emit), ("check", _sound)], seconds), _FAILED)


def chain(df: DataFrame, keys: Sequence[str], text: str, seconds: float = 30.0) -> DataFrame:
    """(keys, status, df_exact, df_f1, nodes_match, error_...): JSON to program to XML and the XML against the JSON, in one pass that gives
    only the small row."""
    first, second = staged([("convert", _read), ("write", _write), ("parse", _checked)], seconds), staged([("transpile", _Splat(_compile)), ("emit", _emit), ("check", _sound)], seconds)

    def f(t):
        status, program, _, stage, kind, message, _ = first(t)[0]
        if status == "succeeded":
            status, xml, _, stage, kind, message, _ = second(program)[0]
        if status != "succeeded":
            return [(status, None, None, None, stage, kind, message)]
        c = G.compare(t, xml, "json", "xml")
        return [(status, c["df_exact"], c["df_f1"], c["nodes_match"], None, None, None)]

    return expand(df, keys, [text], f, "status string, df_exact int, df_f1 double, nodes_match int, error_stage string, error_type string, error_message string")


class _Splat:
    """Keeps a stage's pair as its result instead of reading it as (result, warnings)."""

    def __init__(self, f):
        self.f = f

    def __call__(self, x):
        graphs, messages = self.f(x)
        return (graphs, messages), [w for g in graphs for w in g.warnings]


def json_to_xml(df: DataFrame, keys: Sequence[str], text: str, seconds: float = 30.0) -> DataFrame:
    """Straight to XML, without the program between."""
    def emit(graphs):
        return codecs.to_xml(graphs)

    return expand(df, keys, [text], staged([("convert", _read), ("emit", emit), ("check", _sound)], seconds), _FAILED)


def programs_parse(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, parse_ok, error_message, n_tasks, n_events, n_gateways) of stored programs."""
    def f(t):
        try:
            s = dsl.statistics(dsl.parse(t or ""))
            return [(1, None, s["task"], s["event"], s["gateway"])]
        except dsl.DslError as e:
            return [(0, str(e), None, None, None)]

    return expand(df, keys, [text], f, "parse_ok int, error_message string, n_tasks int, n_events int, n_gateways int")


def layouts(df: DataFrame, keys: Sequence[str], text: str, form: str) -> DataFrame:
    def f(t):
        return [(no, i, *p) for no, g in enumerate(G.graphs_of(t, form)) for i, p in codecs.layout(g).items()]

    return expand(df, keys, [text], f, "process_no int, node_id string, x int, y int, width int, height int, rank int, slot int")


def renderings(df: DataFrame, keys: Sequence[str], text: str, form: str) -> DataFrame:
    return expand(df, keys, [text], lambda t: [(codecs.render(gs),)] if (gs := G.graphs_of(t, form)) else [], "rendering string")


def mutants(df: DataFrame, keys: Sequence[str], text: str, form: str, seed: int = 1) -> DataFrame:
    """(keys, operator, seed, xml): one changed model for each operator that can change it."""
    def f(t):
        gs = [g.inner() for g in G.graphs_of(t, form)]
        return [(k, got[1], codecs.to_xml(got[0])) for k in codecs.OPERATORS if gs and (got := codecs.perturb(gs, k, seed))]

    return expand(df, keys, [text], f, "operator string, seed int, xml string")


def cases(df: DataFrame, keys: Sequence[str], text: str, form: str, seed: int = 1, dose: int = 3) -> DataFrame:
    """(keys, kind, n_defects, xml): each model intact, once perturbed by every operator that applies, `dose` times by different
    operators, and with its labels in other letters and order of words (a paraphrase, no defect)."""
    def f(t):
        gs = [g.inner() for g in G.graphs_of(t, form)]
        if not gs:
            return []
        out = [("intact", 0, codecs.to_xml(gs))]
        out += [(k, 1, codecs.to_xml(got[0])) for k in codecs.OPERATORS if (got := codecs.perturb(gs, k, seed))]
        if (many := codecs.perturb_many(gs, list(codecs.OPERATORS), seed)) and many[1] >= dose:
            out.append(("triple", dose, codecs.to_xml(codecs.perturb_many(gs, _first_that_apply(gs, dose, seed), seed)[0])))
        names = {n.name for g in gs for n in g.nodes.values() if n.name}
        out.append(("paraphrase", 0, codecs.to_xml(codecs.relabel(gs, {x: " ".join(reversed(x.upper().split())) for x in names}))))
        return out

    return expand(df, keys, [text], f, "kind string, n_defects int, xml string")


def _first_that_apply(gs, dose: int, seed: int) -> list[str]:
    kinds: list[str] = []
    for k in codecs.OPERATORS:
        if (got := codecs.perturb_many(gs, [*kinds, k], seed)) and got[1] == len(kinds) + 1:
            kinds.append(k)
        if len(kinds) == dose:
            break
    return kinds


def compression(df: DataFrame, keys: Sequence[str], xml: str, program: str) -> DataFrame:
    """(keys, xml_tokens, dsl_tokens, ratio): sizes of both forms, the XML without its diagram."""
    def f(x, p):
        a, b = dsl.tokens(codecs.strip_diagram(x)) if x else 0, dsl.tokens(p)
        return [(a, b, a / b if b else None)]

    return expand(df.where(F.col(xml).isNotNull() & F.col(program).isNotNull()), keys, [xml, program], f, "xml_tokens int, dsl_tokens int, ratio double")
