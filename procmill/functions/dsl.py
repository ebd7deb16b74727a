"""The process language: parsing it, compiling it to graphs, and writing graphs in it.

A program is a list of processes, pools and collaborations. Steps are chained by ->; gateways hold branches; #id names a step where
it follows its name, and refers to it where it stands alone (also #"Name"). Everything compiles to functions.graphs.Graph, from which
XML, renderings and layouts are made, so each form has one writer.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from procmill.functions.graphs import Edge, Graph, Node, components, join_point, routing_target, split_implicit, start_of

_TOKEN = re.compile(r'(?P<skip>\s+|//[^\n]*)|(?P<name>"(?:[^"\\\n]|\\.)*")|(?P<arrow>->)|(?P<cond>\[[^\[\]]*\])|(?P<word>[A-Za-z_]\w*)|(?P<mark>[{}();:#@=,])')

TASKS = {"task": "task", "user": "userTask", "service": "serviceTask", "manual": "manualTask", "script": "scriptTask", "send": "sendTask", "receive": "receiveTask", "rule": "businessRuleTask"}
GATEWAYS = {"xor": "exclusiveGateway", "and": "parallelGateway", "or": "inclusiveGateway", "event": "eventBasedGateway"}
EVENTS = ("none", "message", "timer", "error", "signal", "escalation")


class DslError(ValueError):
    """A text that is no program, with the line where that shows."""


def quote(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t") + '"'


def unquote(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m.group(1), m.group(1)), s[1:-1], flags=re.S)


@dataclass
class Step:
    """op: task, event, gateway, subprocess, call, ref or note."""

    op: str
    kind: str = ""
    name: str = ""
    id: str = ""
    lane: str = ""
    spec: str = ""
    branches: list[tuple[str, list[Step]]] = field(default_factory=list)


@dataclass
class Block:
    """A process or pool: flows by lane ('' without), each with whether it goes on from the one before."""

    name: str
    flows: list[tuple[str, bool, list[Step]]]


@dataclass
class Program:
    blocks: list[Block] = field(default_factory=list)
    messages: list[tuple[str, str, str]] = field(default_factory=list)


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str, int]] = []
        at, line = 0, 1
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise DslError(f"No terminal matches at line {line}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m.group(), line))
            line += m.group().count("\n")
            at = m.end()
        self.tokens.append(("end", "", line))
        self.at = 0

    def peek(self, value: str | None = None, kind: str | None = None) -> bool:
        k, v, _ = self.tokens[self.at]
        return (kind is None or k == kind) and (value is None or v == value)

    def take(self, value: str | None = None, kind: str | None = None) -> str:
        if not self.peek(value, kind):
            k, v, line = self.tokens[self.at]
            raise DslError(f"Expected {value or kind} instead of {v or 'the end'!s} at line {line}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def maybe(self, value: str | None = None, kind: str | None = None) -> str | None:
        return self.take(value, kind) if self.peek(value, kind) else None

    def name(self) -> str:
        return unquote(self.take(kind="name"))

    def ident(self) -> str:
        return self.take(kind="word") if self.maybe("#") else ""

    def program(self) -> Program:
        p = Program()
        while not self.peek(kind="end"):
            word = self.take(kind="word")
            if word == "collaboration":
                self.name(), self.ident(), self.take("{")
                while self.peek("pool"):
                    self.take()
                    p.blocks.append(self.block())
                while self.maybe("message"):
                    label = self.name() if self.peek(kind="name") else ""
                    self.take("from")
                    a = self.reference()
                    self.take("to")
                    p.messages.append((label, a, self.reference()))
                    self.props()
                self.take("}")
            elif word in ("process", "pool"):
                p.blocks.append(self.block())
            elif word == "note":
                self.name(), self.ident()
            else:
                raise DslError(f"Unexpected {word} at line {self.tokens[self.at - 1][2]}")
        return p

    def block(self) -> Block:
        name = self.name()
        self.ident()
        return Block(name, self.body())

    def body(self) -> list[tuple[str, bool, list[Step]]]:
        self.take("{")
        flows = []
        if self.peek("@"):
            while self.maybe("@"):
                self.take("lane")
                lane = self.name()
                self.ident(), self.take("{")
                flows.append((lane, bool(self.maybe("->")), self.flow()))
                self.take("}")
        else:
            flows.append(("", False, self.flow()))
        self.take("}")
        return flows

    def flow(self) -> list[Step]:
        steps = [self.step()]
        while self.maybe("->"):
            steps.append(self.step())
        return steps

    def reference(self) -> str:
        self.take("#")
        return self.take(kind="word") if self.peek(kind="word") else "=" + self.name()

    def props(self) -> dict[str, str]:
        out = {}
        if self.maybe("("):
            while True:
                key = self.take(kind="word")
                self.take("=")
                out[key] = self.name()
                if not self.maybe(","):
                    break
            self.take(")")
        return out

    def spec(self) -> str:
        kind = self.take(kind="word")
        if kind not in EVENTS:
            raise DslError(f"Unknown event {kind} at line {self.tokens[self.at - 1][2]}")
        if self.maybe("("):
            self.name(), self.take(")")
        return "" if kind == "none" else kind

    def step(self) -> Step:
        if self.peek("#"):
            return Step("ref", id=self.reference())
        word = self.take(kind="word")
        if word in ("start", "end", "catch", "throw"):
            spec = self.spec() if self.maybe(":") else ""
            name = self.name() if self.peek(kind="name") else ""
            i = self.ident()
            return Step("event", word, name, i, self.props().get("lane", ""), spec)
        if word in TASKS:
            name, i = self.name(), self.ident()
            return Step("task", TASKS[word], name, i, self.props().get("lane", ""))
        if word in GATEWAYS:
            name = self.name() if self.peek(kind="name") else ""
            s = Step("gateway", GATEWAYS[word], name, self.ident())
            self.take("{")
            if word == "and" and not self.peek(kind="cond"):
                s.branches.append(("", self.target()))
                while self.maybe(";"):
                    s.branches.append(("", self.target()))
            else:
                while self.peek(kind="cond"):
                    condition = self.take()[1:-1].strip()
                    self.take("->")
                    s.branches.append((condition, self.target()))
            self.take("}")
            if not s.branches:
                raise DslError(f"A gateway without branches at line {self.tokens[self.at - 1][2]}")
            return s
        if word == "subprocess":
            name, i = self.name(), self.ident()
            self.body()
            return Step("subprocess", "subProcess", name, i)
        if word == "call":
            name, i = self.name(), self.ident()
            return Step("call", "callActivity", name, i, self.props().get("lane", ""))
        if word == "note":
            return Step("note", name=self.name(), id=self.ident())
        raise DslError(f"Unexpected {word} at line {self.tokens[self.at - 1][2]}")

    def target(self) -> list[Step]:
        if self.maybe("("):
            self.take(")")
            return []
        return self.flow()


def parse(text: str) -> Program:
    """The program of a text; DslError if it is none. An empty text is an empty program."""
    try:
        return _Parser(text).program()
    except RecursionError as e:
        raise DslError("Nested too deeply") from e


# ---- to graphs ----

class _Compiler:
    def __init__(self):
        self.graphs: list[Graph] = []
        self.declared: dict[str, str] = {}
        self.named: dict[str, str] = {}
        self.pending: list[tuple[Graph, str, str, str]] = []
        self.count = 0

    def node(self, g: Graph, s: Step, lane: str) -> str:
        if s.id and s.id in self.declared:
            return self.declared[s.id]
        self.count += 1
        i = s.id or f"n{self.count}"
        kind = s.kind
        if s.op == "event":
            fits = (s.kind, s.spec) in (("start", "message"), ("end", "message"), ("end", "error")) or s.kind in ("catch", "throw")
            kind = f"{s.kind}{s.spec.capitalize() if fits else ''}Event"
        g.nodes[i] = Node(i, kind, s.name, s.lane or lane)
        if s.id:
            self.declared[s.id] = i
        if s.name:
            self.named.setdefault(s.name, i)
        return i

    def link(self, g: Graph, opened: list[tuple[str, str]], to: str) -> None:
        for i, condition in opened:
            if i.startswith("#"):
                self.pending.append((g, i, condition, to))
            else:
                g.edges.append(Edge(f"e{len(g.edges)}", i, to, condition))

    def flow(self, g: Graph, steps: list[Step], opened: list[tuple[str, str]], lane: str) -> list[tuple[str, str]]:
        """Compiles steps after the open ends (node, condition); gives the ends that stay open."""
        steps = [s for s in steps if s.op != "note"]
        for k, s in enumerate(steps):
            last = k == len(steps) - 1
            if s.op == "ref":
                for i, condition in opened:
                    self.pending.append((g, i, condition, s.id))
                opened = [] if last else [(f"#{s.id}", "")]  # what follows a reference goes on from the step it names
                continue
            i = self.node(g, s, lane)
            self.link(g, opened, i)
            opened = [(i, "")]
            if s.op == "event" and s.kind == "end" and last:
                opened = []
            elif s.op == "gateway":
                ends: list[tuple[str, str]] = []
                for condition, branch in s.branches:
                    ends += self.flow(g, branch, [(i, condition)], lane)
                if ends:
                    self.count += 1
                    merge = f"m{self.count}"
                    g.nodes[merge] = Node(merge, s.kind, "", s.lane or lane)
                    self.link(g, ends, merge)
                    opened = [(merge, "")]
                else:
                    opened = []
        return opened

    def meant(self, ref: str) -> str:
        to = self.named.get(ref[1:]) if ref.startswith("=") else self.declared.get(ref)
        if to is None:
            raise DslError(f"No step is named #{ref.lstrip('=')}")
        return to

    def joined(self, a: str, b: str) -> Graph | None:
        """The graph of both nodes; if they are in two, the later one becomes part of the earlier."""
        at = sorted({next((k for k, g in enumerate(self.graphs) if i in g.nodes), 0) for i in (a, b)})
        if len(at) == 2:
            first, other = self.graphs[at[0]], self.graphs.pop(at[1])
            first.nodes |= other.nodes
            first.edges += [Edge(f"e{len(first.edges) + k}", e.source, e.target, e.condition, e.label) for k, e in enumerate(other.edges)]
            first.lanes += [(f"lane_{len(first.lanes) + k + 1}", x) for k, (_, x) in enumerate(other.lanes) if x not in [y for _, y in first.lanes]]
            return first
        return self.graphs[at[0]] if self.graphs else None

    def run(self, p: Program) -> list[Graph]:
        for b in p.blocks:
            g = Graph(b.name)
            self.graphs.append(g)
            opened: list[tuple[str, str]] = []
            for lane, goes_on, steps in b.flows:
                if lane and lane not in [x for _, x in g.lanes]:
                    g.lanes.append((f"lane_{len(g.lanes) + 1}", lane))
                opened = self.flow(g, steps, opened if goes_on else [], lane)
        for g, i, condition, ref in self.pending:
            source = self.meant(i[1:]) if i.startswith("#") else i
            target = ref if ref in g.nodes and i.startswith("#") else self.meant(ref)
            home = self.joined(source, target) or g
            home.edges.append(Edge(f"e{len(home.edges)}", source, target, condition))
        for g in self.graphs:
            for n in g.nodes.values():
                if n.lane and n.lane not in [x for _, x in g.lanes]:
                    g.lanes.append((f"lane_{len(g.lanes) + 1}", n.lane))
        return self.graphs


def compile_program(p: Program) -> tuple[list[Graph], list[tuple[str, str, str]]]:
    """The graphs of a program's processes and pools, and its messages (label, node id, node id).

    A repeated #id is the same node. References to later steps resolve; unknown ones are a DslError. Branches that end or refer do
    not reach the merge; without an open branch there is no merge. Steps after a reference go on from the step it names. Processes
    that refer to each other's steps are one. The inside of a subprocess stays inside: it is one node.
    """
    c = _Compiler()
    graphs = c.run(p)
    at = lambda r: c.named.get(r[1:]) if r.startswith("=") else c.declared.get(r)
    return graphs, [(label, a, b) for label, x, y in p.messages if (a := at(x)) and (b := at(y))]


def graphs_of_dsl(text: str) -> list[Graph]:
    return compile_program(parse(text))[0]


# ---- from graphs ----

def identifiers(keys: list[str], names: list[str]) -> dict[str, str]:
    """A word for each key, from its name; numbered where taken."""
    out, used = {}, set()
    for k, name in zip(keys, names):
        base = re.sub(r"\W+", "_", name.lower(), flags=re.ASCII).strip("_")[:40] or "step"
        base = base if base[0].isalpha() else f"n_{base}"
        i, n = base, 2
        while i in used:
            i, n = f"{base}_{n}", n + 1
        used.add(i)
        out[k] = i
    return out


class _Writer:
    """Every node is written once; ways to nodes that stand elsewhere become references."""

    def __init__(self, g: Graph, ids: dict[str, str], used: set[str], done: set[str]):
        self.g, self.ids, self.used, self.done = g, ids, used, done
        self.after = {i: list(dict.fromkeys(v)) for i, v in g.successors().items()}
        self.condition = {(e.source, e.target): e.condition or e.label for e in g.edges}

    def skip(self, i: str) -> str:
        return routing_target(self.g, i)

    def ref(self, i: str) -> str:
        self.used.add(i)
        return f"\x00ref{i}\x00"

    def head(self, n: Node) -> str:
        mark = f"\x00id{n.id}\x00"
        lane = f" (lane={quote(n.lane)})" if n.lane else ""
        if m := next((w for w, k in TASKS.items() if k == n.kind), None):
            return f"{m} {quote(n.name)}{mark}{lane}"
        if n.kind.endswith("Event"):
            m = re.match(r"(start|end|catch|throw)(\w*)Event", n.kind.replace("intermediateC", "c").replace("intermediateT", "t"))
            place, spec = m.group(1), m.group(2).lower()
            spec = f":{spec or 'none'}" if place in ("catch", "throw") or spec else ""
            return f"{place}{spec}{' ' + quote(n.name) if n.name else ''}{mark}{lane}"
        if n.kind == "subProcess":
            return f'subprocess {quote(n.name)}{mark} {{ note {quote(n.name)} }}'
        if n.kind in ("callActivity", "transaction", "adHocSubProcess"):
            return f"call {quote(n.name)}{mark}{lane}"
        return f"task {quote(n.name)}{mark}{lane}"

    def walk(self, i: str | None, stop: str | None, outer: tuple[str, ...], pad: str) -> tuple[list[str], bool]:
        """Steps from node i on until stop, and whether stop was reached (the way is open)."""
        out: list[str] = []
        ended = False
        while i is not None:
            i = self.skip(i) if i != stop else i
            if i == stop or (stop is not None and i == self.skip(stop)):
                if ended:  # an end event that goes on would close the branch if it stood last
                    return [*out, self.ref(self.skip(stop))], False
                return out, True
            if i in self.done or i in outer:
                return [*out, self.ref(i)], False
            n = self.g.nodes[i]
            ways = [t for t in self.after.get(i, ()) if t in self.g.nodes]
            if not ways and (stop is not None or outer) and not n.kind.startswith("end"):
                return [*out, self.ref(i)], False  # a last step here would run on into the merge; it gets a process of its own
            self.done.add(i)
            if len(ways) < 2:
                if "Gateway" not in n.kind:
                    out.append(self.head(n))
                    ended = n.kind.startswith("end")
                i = ways[0] if ways else None
                continue
            ended = False
            join = join_point(self.g, i)
            if join is not None and (self.skip(join) in self.done or join in self.done):
                join = None
            words = next(w for w, k in GATEWAYS.items() if k == n.kind) if n.kind in GATEWAYS.values() else "xor"
            words = "xor" if words == "event" else words
            name = f" {quote(n.name)}" if n.name else ""
            inner = pad + "  "
            branches, opened = [], False
            for t in ways:
                steps, reached = self.walk(t, join, (*outer, *((self.skip(stop),) if stop is not None else ())), inner + "  ")
                opened = opened or reached
                body = f" ->\n{inner}  ".join(steps) if steps else "()"
                if words == "and":
                    branches.append(inner + body)
                else:
                    cond = re.sub(r"[\[\]]", " ", self.condition.get((i, t), "")).strip() or "branch"
                    branches.append(f"{inner}[{cond}] -> {body}")
            out.append(f"{words}{name}\x00id{n.id}\x00 {{\n" + (";\n" if words == "and" else "\n").join(branches) + f"\n{pad}}}")
            i = join if opened else None
        return out, False


def _leading_somewhere(g: Graph) -> Graph:
    """The graph without gateways from which no activity can be reached (they relate nothing) and without repeated edges."""
    before, kept = g.predecessors(), {i for i, n in g.nodes.items() if "Gateway" not in n.kind}
    todo = list(kept)
    while todo:
        for j in before.get(todo.pop(), ()):
            if j not in kept:
                kept.add(j)
                todo.append(j)
    edges = {(e.source, e.target): e for e in g.edges if e.source in kept and e.target in kept}  # a repeated edge counts once
    return Graph(g.name, {i: n for i, n in g.nodes.items() if i in kept}, list(edges.values()), g.lanes, g.warnings)


def write(graphs: list[Graph]) -> str:
    """The program of some graphs: one process for each part that hangs together.

    The direct-follows relation of the program is that of the graphs. Edges to unknown nodes are left out, forks without a gateway get
    one; nodes that no way reaches from the start follow in processes of their own.
    """
    graphs = [_leading_somewhere(split_implicit(g.inner())) for g in graphs]
    keyed = []
    for no, g in enumerate(graphs):  # ids are unique in a graph only
        k = lambda i, no=no: f"{no}:{i}"
        keyed.append(Graph(g.name, {k(n.id): Node(k(n.id), n.kind, n.name, n.lane, n.doc) for n in g.nodes.values()}, [Edge(e.id, k(e.source), k(e.target), e.condition, e.label) for e in g.edges], g.lanes))
    every = [n for g in keyed for n in g.nodes.values()]
    ids = identifiers([n.id for n in every], [n.name or n.kind for n in every])
    used: set[str] = set()
    blocks = []
    for g in keyed:
        done: set[str] = set()
        w = _Writer(g, ids, used, done)
        for part in components(g):
            sub = Graph(g.name, {i: g.nodes[i] for i in part}, [e for e in g.edges if e.source in part])
            first = start_of(sub)
            rest = [x for x in [first, *part] if x is not None]
            for i in rest:
                if i in done or w.skip(i) in done:
                    continue
                steps, _ = w.walk(i, None, (), "  ")
                if steps:
                    blocks.append(f"process {quote(g.name)} {{\n  " + " ->\n  ".join(steps) + "\n}")
    text = "\n\n".join(blocks)
    text = re.sub(r"\x00ref(.*?)\x00", lambda m: "#" + ids[m.group(1)], text)
    return re.sub(r"\x00id(.*?)\x00", lambda m: f" #{ids[m.group(1)]}" if m.group(1) in used else "", text) + ("\n" if text else "")


def tokens(text: str | None) -> int:
    """Words, marks and quoted strings' words: the default, documented size of a text where no tokenizer is given."""
    return len(re.findall(r"\w+|[^\w\s]", text or ""))


def statistics(p: Program) -> Counter:
    out: Counter = Counter()

    def walk(steps: list[Step]) -> None:
        for s in steps:
            out[s.op] += 1
            for _, b in s.branches:
                walk(b)

    for b in p.blocks:
        for _, _, steps in b.flows:
            walk(steps)
    return out
