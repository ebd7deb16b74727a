"""Graphs to XML, layouts and neutral renderings, and seeded perturbations of graphs."""

from __future__ import annotations

import random
import re
import xml.etree.ElementTree as ET
from collections import Counter, defaultdict

from procmill.functions.graphs import Edge, Graph, Node, category, label, start_of

NS = "http://www.omg.org/spec/BPMN/20100524/MODEL"
DI = "http://www.omg.org/spec/BPMN/20100524/DI"
DC = "http://www.omg.org/spec/DD/20100524/DC"
DD = "http://www.omg.org/spec/DD/20100524/DI"
for _prefix, _uri in (("", NS), ("bpmndi", DI), ("dc", DC), ("di", DD)):
    ET.register_namespace(_prefix, _uri)


# ---- XML ----

def xml_id(raw: str, used: set[str]) -> str:
    """A name that XML takes as an id, numbered where taken."""
    base = re.sub(r"[^\w.-]", "_", raw, flags=re.ASCII) or "id"
    base = base if base[0].isalpha() or base[0] == "_" else f"_{base}"
    i, n = base, 2
    while i in used:
        i, n = f"{base}_{n}", n + 1
    used.add(i)
    return i


_TRIGGER = re.compile(r"(Message|Timer|Signal|Error|Escalation)Event$")


def _tag(kind: str) -> str:
    if kind.endswith("Event"):
        place = _TRIGGER.sub("Event", kind)
        return {"catchEvent": "intermediateCatchEvent", "throwEvent": "intermediateThrowEvent"}.get(place, place)
    return "task" if kind == "activity" else kind


def to_xml(graphs: list[Graph], messages: list[tuple[str, str, str]] = (), with_layout: bool = False) -> str:
    """The document of some graphs: a process each, participants and message flows if there are several or any messages.

    Edges to unknown nodes are left out. Node ids of different graphs may clash; the document's are unique.
    """
    used: set[str] = set()
    q = lambda t: f"{{{NS}}}{t}"
    root = ET.Element(q("definitions"), {"id": xml_id("Definitions_1", used), "targetNamespace": "urn:process-models"})
    wide = len(graphs) > 1 and bool(messages) or bool(messages)
    collaboration = ET.SubElement(root, q("collaboration"), {"id": xml_id("Collaboration_1", used)}) if wide else None
    named: dict[str, str] = {}
    planes = []
    for no, g in enumerate(graphs, 1):
        g = g.inner()
        p = ET.SubElement(root, q("process"), {"id": xml_id(f"Process_{no}", used), "name": g.name, "isExecutable": "false"})
        if collaboration is not None:
            ET.SubElement(collaboration, q("participant"), {"id": xml_id(f"Participant_{no}", used), "name": g.name, "processRef": p.get("id")})
        ids = {i: xml_id(i, used) for i in g.nodes}
        named |= {i: x for i, x in ids.items() if i not in named}
        if g.lanes:
            lanes = ET.SubElement(p, q("laneSet"), {"id": xml_id(f"LaneSet_{no}", used)})
            for i, name in g.lanes:
                lane = ET.SubElement(lanes, q("lane"), {"id": xml_id(i, used), "name": name})
                for n in g.nodes.values():
                    if n.lane == name:
                        ET.SubElement(lane, q("flowNodeRef")).text = ids[n.id]
        flows = [(xml_id(e.id, used), e) for e in g.edges]
        for n in g.nodes.values():
            el = ET.SubElement(p, q(_tag(n.kind)), {"id": ids[n.id]} | ({"name": n.name} if n.name else {}))
            if n.doc:
                ET.SubElement(el, q("documentation")).text = n.doc
            for f, e in flows:
                if e.target == n.id:
                    ET.SubElement(el, q("incoming")).text = f
            for f, e in flows:
                if e.source == n.id:
                    ET.SubElement(el, q("outgoing")).text = f
            if m := _TRIGGER.search(n.kind):
                ET.SubElement(el, q(f"{m.group(1).lower()}EventDefinition"), {"id": xml_id(f"{ids[n.id]}_trigger", used)})
        for f, e in flows:
            el = ET.SubElement(p, q("sequenceFlow"), {"id": f, "sourceRef": ids[e.source], "targetRef": ids[e.target]} | ({"name": e.condition or e.label} if e.condition or e.label else {}))
        planes.append((g, ids, flows))
    for k, (name, a, b) in enumerate(messages, 1):
        if a in named and b in named and collaboration is not None:
            ET.SubElement(collaboration, q("messageFlow"), {"id": xml_id(f"Message_{k}", used), "sourceRef": named[a], "targetRef": named[b]} | ({"name": name} if name else {}))
    if with_layout:
        _diagram(root, planes, used)
    return ET.tostring(root, encoding="unicode", xml_declaration=False)


def _diagram(root: ET.Element, planes: list, used: set[str]) -> None:
    plane = ET.SubElement(ET.SubElement(root, f"{{{DI}}}BPMNDiagram", {"id": xml_id("Diagram_1", used)}), f"{{{DI}}}BPMNPlane", {"id": xml_id("Plane_1", used)})
    top = 0
    for g, ids, flows in planes:
        places = layout(g)
        for i, (x, y, w, h, *_) in places.items():
            s = ET.SubElement(plane, f"{{{DI}}}BPMNShape", {"id": xml_id(f"{ids[i]}_di", used), "bpmnElement": ids[i]})
            ET.SubElement(s, f"{{{DC}}}Bounds", {"x": str(x), "y": str(y + top), "width": str(w), "height": str(h)})
        for f, e in flows:
            s = ET.SubElement(plane, f"{{{DI}}}BPMNEdge", {"id": xml_id(f"{f}_di", used), "bpmnElement": f})
            for n, side in ((e.source, 1), (e.target, 0)):
                x, y, w, h, *_ = places[n]
                ET.SubElement(s, f"{{{DD}}}waypoint", {"x": str(x + w * side), "y": str(y + top + h // 2)})
        top += max((y + h for _, y, _, h, *_ in places.values()), default=0) + 60


def strip_diagram(xml: str) -> str:
    """The document without its diagram section; a text that is not well-formed stays as it is."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return xml
    for e in list(root):
        if isinstance(e.tag, str) and e.tag.endswith("}BPMNDiagram"):
            root.remove(e)
    return ET.tostring(root, encoding="unicode")


def xml_findings(xml: str | None) -> list[str]:
    """Why a document is no sound model: not well-formed, repeated ids, references to ids that are not there, no process."""
    try:
        root = ET.fromstring(xml or "")
    except (ET.ParseError, ValueError) as e:
        return [f"not well-formed: {e}"]
    out, ids = [], Counter(e.get("id") for e in root.iter() if e.get("id") is not None)
    out += [f"id {i} stands {n} times" for i, n in sorted(ids.items()) if n > 1]
    if not any(isinstance(e.tag, str) and e.tag.endswith("}process") for e in root.iter()):
        out.append("no process")
    for e in root.iter():
        for a in ("sourceRef", "targetRef", "processRef"):
            if (r := e.get(a)) is not None and r not in ids:
                out.append(f"{a} {r} is no id")
        if isinstance(e.tag, str) and e.tag.endswith("}flowNodeRef") and (e.text or "").strip() not in ids:
            out.append(f"flowNodeRef {(e.text or '').strip()} is no id")
    return out


# ---- layout ----

#: Sizes of shapes by kind, and the grid.
SIZES = {"task": (100, 80), "event": (36, 36), "gateway": (50, 50)}
GRID_X, GRID_Y = 160, 120


def ranks(g: Graph) -> dict[str, int]:
    """The longest way from any node without predecessors to each node, ignoring edges that close a cycle."""
    g = g.inner()
    after = g.successors()
    state: dict[str, int] = {}
    forward: dict[str, list[str]] = defaultdict(list)
    order: list[str] = []
    start = start_of(g)
    for first in ([start] if start else []) + list(g.nodes):
        todo = [(first, iter(after.get(first, ())))] if first not in state else []
        if todo:
            state[first] = 1
        while todo:
            i, ways = todo[-1]
            for j in ways:
                if state.get(j) == 1:
                    continue  # closes a cycle
                forward[i].append(j)
                if j not in state:
                    state[j] = 1
                    todo.append((j, iter(after.get(j, ()))))
                    break
            else:
                state[i] = 2
                order.append(i)
                todo.pop()
    out = dict.fromkeys(g.nodes, 0)
    for i in reversed(order):
        for j in forward[i]:
            out[j] = max(out[j], out[i] + 1)
    return out


def layout(g: Graph) -> dict[str, tuple[int, int, int, int, int, int]]:
    """node -> (x, y, width, height, rank, slot): columns by rank, a band for each lane, slots within band and rank in node order."""
    g = g.inner()
    rank = ranks(g)
    lanes = [name for _, name in g.lanes]
    band = {name: k for k, name in enumerate(dict.fromkeys([*lanes, *[n.lane for n in g.nodes.values()]]))}
    slots: Counter = Counter()
    slot = {}
    for n in g.nodes.values():
        slot[n.id] = slots[rank[n.id], n.lane]
        slots[rank[n.id], n.lane] += 1
    heights = {name: max([c for (_, x), c in slots.items() if x == name], default=1) for name in band}
    tops, y = {}, 0
    for name in band:
        tops[name] = y
        y += heights[name] * GRID_Y
    out = {}
    for n in g.nodes.values():
        w, h = SIZES["gateway" if "Gateway" in n.kind else "event" if n.kind.endswith("Event") else "task"]
        free = (heights[n.lane] - slots[rank[n.id], n.lane]) * GRID_Y // 2  # centred in the band
        out[n.id] = (rank[n.id] * GRID_X + (GRID_X - w) // 2, tops[n.lane] + free + slot[n.id] * GRID_Y + (GRID_Y - h) // 2, w, h, rank[n.id], slot[n.id])
    return out


# ---- neutral rendering ----

def render(graphs: list[Graph]) -> str:
    """A text of the model without ids or order of writing: gateways with one way in and out are bypassed, nodes numbered by breadth
    from the start with ways in the order of their targets' labels. Models that differ in ids, order or such gateways render the same."""
    out = []
    for g in graphs:
        g = g.inner()
        edges = {(e.source, e.target): e.condition or e.label for e in g.edges}
        nodes = dict(g.nodes)
        while True:
            into, out_of = defaultdict(list), defaultdict(list)
            for a, b in edges:
                out_of[a].append(b)
                into[b].append(a)
            i = next((i for i, n in nodes.items() if "Gateway" in n.kind and len(into[i]) == 1 and len(out_of[i]) == 1 and into[i][0] != i), None)
            if i is None:
                break
            a, b = into[i][0], out_of[i][0]
            text = edges.pop((a, i)) or edges[i, b]
            edges.pop((i, b))
            edges.setdefault((a, b), text)
            del nodes[i]
        say = lambda i: f"{nodes[i].kind if 'Gateway' in nodes[i].kind else (category(nodes[i].kind) or 'activity')} {' '.join(nodes[i].name.split())}".strip()  # noqa: E731, B023
        number: dict[str, int] = {}
        start = start_of(Graph(g.name, nodes, [Edge("", a, b) for a, b in edges]))
        for first in ([start] if start in nodes else []) + sorted(nodes, key=lambda i: (say(i), len(into[i]), len(out_of[i]))):
            todo = [first]
            while todo:
                i = todo.pop(0)
                if i in number:
                    continue
                number[i] = len(number) + 1
                todo += sorted(out_of[i], key=lambda j, i=i: (edges[i, j], say(j)))
        out.append("\n".join([f"process {' '.join(g.name.split())}"] + [f"{k}. {say(i)}" + (f" [{' '.join(nodes[i].lane.split())}]" if nodes[i].lane else "") for i, k in number.items()] + [f"{a} -> {b}" + (f" if {' '.join(c.split())}" if c else "") for a, b, c in sorted((number[x], number[y], c) for (x, y), c in edges.items())]))
    return "\n\n".join(out)


# ---- perturbation ----

def _copy(g: Graph) -> Graph:
    return Graph(g.name, {i: Node(n.id, n.kind, n.name, n.lane, n.doc) for i, n in g.nodes.items()}, [Edge(e.id, e.source, e.target, e.condition, e.label) for e in g.edges], list(g.lanes))


def _tasks(g: Graph) -> list[str]:
    return [i for i, n in g.nodes.items() if category(n.kind) == "task"]


def drop_task(g: Graph, rng: random.Random) -> Graph | None:
    """Without one task; its ways in lead to its ways out."""
    g = _copy(g)
    if len(_tasks(g)) < 2:
        return None
    i = rng.choice(_tasks(g))
    into, out = [e for e in g.edges if e.target == i and e.source != i], [e for e in g.edges if e.source == i and e.target != i]
    g.edges = [e for e in g.edges if i not in (e.source, e.target)] + [Edge(f"{a.id}_{b.id}", a.source, b.target, a.condition, a.label) for a in into for b in out]
    del g.nodes[i]
    return g


def add_task(g: Graph, rng: random.Random, name: str = "Additional step") -> Graph | None:
    """With one task more, in the middle of one edge."""
    g = _copy(g)
    if not g.edges:
        return None
    e = rng.choice(g.edges)
    i = "added"
    while i in g.nodes:
        i += "_"
    g.nodes[i] = Node(i, "task", name, g.nodes[e.source].lane if e.source in g.nodes else "")
    g.edges.append(Edge(f"{e.id}_more", i, e.target))
    e.target = i
    return g


def swap_tasks(g: Graph, rng: random.Random) -> Graph | None:
    """With the names of two differently named tasks exchanged."""
    g = _copy(g)
    pairs = [(a, b) for k, a in enumerate(_tasks(g)) for b in _tasks(g)[k + 1 :] if g.nodes[a].name != g.nodes[b].name]
    if not pairs:
        return None
    a, b = rng.choice(pairs)
    g.nodes[a].name, g.nodes[b].name = g.nodes[b].name, g.nodes[a].name
    return g


def parallel_to_exclusive(g: Graph, rng: random.Random) -> Graph | None:
    """With all parallel gateways exclusive."""
    g = _copy(g)
    hit = [n for n in g.nodes.values() if n.kind == "parallelGateway"]
    for n in hit:
        n.kind = "exclusiveGateway"
    return g if hit else None


def swap_branches(g: Graph, rng: random.Random) -> Graph | None:
    """With the conditions of two ways out of one gateway exchanged."""
    g = _copy(g)
    ways = defaultdict(list)
    for e in g.edges:
        if e.source in g.nodes and "Gateway" in g.nodes[e.source].kind and (e.condition or e.label):
            ways[e.source].append(e)
    pairs = [(a, b) for es in ways.values() for k, a in enumerate(es) for b in es[k + 1 :] if (a.condition, a.label) != (b.condition, b.label)]
    if not pairs:
        return None
    a, b = rng.choice(pairs)
    a.condition, b.condition, a.label, b.label = b.condition, a.condition, b.label, a.label
    return g


OPERATORS = {"drop": drop_task, "add": add_task, "swap": swap_tasks, "exclusive": parallel_to_exclusive, "branches": swap_branches}


def perturb(graphs: list[Graph], kind: str, seed: int, tries: int = 10) -> tuple[list[Graph], int] | None:
    """(changed graphs, seed used): the operator on the first graph it applies to, with the first of `tries` seeds whose result renders
    differently; None if none does."""
    before = render(graphs)
    for s in range(seed, seed + tries):
        rng = random.Random(f"{kind}-{s}")
        for k, g in enumerate(graphs):
            if (h := OPERATORS[kind](g, rng)) is not None:
                out = [*graphs[:k], h, *graphs[k + 1 :]]
                if render(out) != before:
                    return out, s
                break
    return None


def perturb_many(graphs: list[Graph], kinds: list[str], seed: int) -> tuple[list[Graph], int] | None:
    """(changed graphs, operators applied): the operators in turn, each on what the one before left; those that cannot apply are passed
    over. None if none applies."""
    done = 0
    for kind in kinds:
        if (got := perturb(graphs, kind, seed + done)) is not None:
            graphs, done = got[0], done + 1
    return (graphs, done) if done else None


def relabel(graphs: list[Graph], mapping: dict[str, str]) -> list[Graph]:
    """With names replaced by a mapping; gateways keep theirs."""
    out = []
    for g in graphs:
        g = _copy(g)
        for n in g.nodes.values():
            if "Gateway" not in n.kind:
                n.name = mapping.get(n.name, n.name)
        out.append(g)
    return out


def node_labels(graphs: list[Graph]) -> set[str]:
    return {label(c, n.name) for g in graphs for n in g.nodes.values() if (c := category(n.kind)) is not None}
