"""Plain recursive reading of process models, as a second opinion for the nested operator."""

import json
import re
import xml.etree.ElementTree as ET


def load(text):
    s = text.replace("﻿", "").strip()
    m = re.match(r"(?s).*?```(?:json)?\s*(.*?)\s*```\s*$", s)
    for t in (s, m and m.group(1), s[s.find("{") :] if "{" in s else None):
        if t:
            try:
                v = json.loads(t, parse_int=str, parse_float=str)
            except ValueError:
                continue
            return load(v) if isinstance(v, str) else v
    return None


def from_json(text):
    out, v = set(), load(text) if text else None
    if not isinstance(v, dict):
        return out

    def lanes(p, no, up):
        for lane in p.get("lanes") or []:
            i = lane.get("id") or lane.get("name")
            out.add((no, "lane", i, up))
            out.update((no, "member", r, i) for r in lane.get("refs") or [])
            lanes(lane, no, i)

    def nodes(p, no, up):
        for n in p.get("nodes") or []:
            out.add((no, "node", n["id"], up))
            nodes(n, no, n["id"])
        for f in p.get("flows") or []:
            a, b = f.get("from") or f.get("source"), f.get("to") or f.get("target")
            i = f.get("id") or f"f_{a}_{b}"
            out.update({(no, "source", i, a), (no, "target", i, b)})

    for no, p in enumerate(v.get("processos") or v.get("processes") or [v]):
        lanes(p, no, "")
        nodes(p, no, "")
    return out


def from_xml(text):
    out = set()
    try:
        root = ET.fromstring(text or "")
    except ET.ParseError:
        return out
    tag = lambda e: e.tag.split("}")[-1]
    for no, p in enumerate(x for x in root.iter() if tag(x) == "process"):
        def walk(e, node, lane, no=no):
            for c in e:
                t, i = tag(c), c.get("id")
                if t == "lane":
                    out.add((no, "lane", i, lane))
                    walk(c, node, i)
                elif t == "flowNodeRef":
                    out.add((no, "member", c.text.strip(), lane))
                elif t == "sequenceFlow":
                    out.update({(no, "source", i, c.get("sourceRef")), (no, "target", i, c.get("targetRef"))})
                elif t in ("laneSet", "childLaneSet"):
                    walk(c, node, lane)
                elif t not in ("documentation", "extensionElements"):
                    out.add((no, "node", i, node))
                    walk(c, i, lane)
        walk(p, "", "")
    return out
