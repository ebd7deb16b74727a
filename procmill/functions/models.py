"""Reading process models out of text: JSON that may be wrapped, quoted or embedded, and XML, both as JSON records of one shape.

A record is {"processes": [PROCESS], ...} with all that the text says. PROCESS, and a node that holds others, may have "lanes", "nodes" and
"flows", a lane "refs" and "lanes"; these are lists whatever their form in the text. Everything else keeps its key and its place, also
arrays that nobody knows; scalars are strings as they were written. Which keys mean the same (from and source, ...) is left to those
who read the records.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa

WRAPPERS = ("processos", "processes")
LISTS = ("lanes", "nodes", "flows")
NODE_ENDINGS = ("task", "event", "gateway", "subprocess", "activity", "transaction")
NESTING_TAGS = ("subprocess", "adhocsubprocess", "transaction")

_DECODER = json.JSONDecoder(parse_int=str, parse_float=str, parse_constant=str)
_FENCE = re.compile(r"```[A-Za-z]*\s*\n?")


def read_json(text: str | None):
    """The JSON value that a text holds, or None if it holds none that is well-formed.

    The text may be the value itself (with a byte-order mark or blanks around it), a JSON string that holds it again (any depth up
    to 5), or other text in which the value begins at the first brace or after a code fence. A value that breaks off is none: its
    inner objects are not taken for it. Numbers come as strings, as written; of a repeated key the last counts.
    """
    for _ in range(5):
        if not isinstance(text, str):
            return text
        s = text.strip("\ufeff\u200b \t\r\n")
        if not s:
            return None
        try:
            text = _DECODER.decode(s)
            if text == s:  # a number, as written
                return text
            continue
        except (ValueError, RecursionError):
            pass
        starts = [m for m in (s.find("{"), s.find("[{")) if m >= 0]
        tries = ([min(starts)] if starts else []) + [m.end() for m in _FENCE.finditer(s)]
        for at in tries:
            try:
                value, _ = _DECODER.raw_decode(s, at)
            except (ValueError, RecursionError):
                continue
            if isinstance(value, (dict, list)):
                return value
        return None
    return None


def _text(x) -> str | None:
    if x is None or isinstance(x, (dict, list)):
        return None
    if isinstance(x, bool):
        return "true" if x else "false"
    return str(x)


def _first(d: dict, *names):
    for n in names:
        x = _text(d.get(n))
        if x is not None and x != "":
            return x
    return None


def _items(x) -> list:
    return x if isinstance(x, list) else [x] if isinstance(x, dict) else []


#: Keys that name things; an object or array in their place is kept under the key with an underscore.
NAMING = ("id", "name", "from", "source", "to", "target")


def _plain(x):
    """Scalars as text, at any depth."""
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, list) else _text(x)


def _shaped(d: dict, body: bool = True) -> dict:
    """An object of a model with its lanes, nodes, flows and refs as lists."""
    out: dict = {}
    for k, v in d.items():
        if k in LISTS and body:
            if got := [_shaped(x, k != "flows") for x in _items(v) if isinstance(x, dict)]:
                out[k] = got
        elif k == "refs":
            if got := [r for r in map(_text, v if isinstance(v, list) else [v]) if r]:
                out[k] = got
        else:
            out[f"{k}_" if k in NAMING and isinstance(v, (dict, list)) else k] = _plain(v)
    return out


def record_of_json(text: str | None) -> str | None:
    """The record of a JSON text; None if it holds no process."""
    value = read_json(text)
    more: dict = {}
    if isinstance(value, dict):
        w = next((w for w in WRAPPERS if isinstance(value.get(w), (list, dict))), None)
        if w:
            more, value = {k: v for k, v in value.items() if k not in WRAPPERS}, _items(value[w])
        else:
            value = [value] if any(k in value for k in LISTS) else []
    if not isinstance(value, list):
        return None
    try:
        processes = [_shaped(p) if isinstance(p, dict) else {} for p in (read_json(x) if isinstance(x, str) else x for x in value)]
        return json.dumps({**_plain(more), "processes": processes}, ensure_ascii=False) if any(any(p.get(k) for k in LISTS) for p in processes) else None
    except RecursionError:
        return None


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _attributes(e: ET.Element) -> dict:
    return {k.rpartition("}")[2]: v for k, v in e.attrib.items()}


def _said(e: ET.Element, kind: str) -> dict:
    """{key: text} of the first child of this kind, if it has any text."""
    text = next(("".join(c.itertext()).strip() for c in e if _local(c) == kind), "")
    return {"doc" if kind == "documentation" else "condition": text} if text else {}


def _xml_lane(e: ET.Element) -> dict:
    refs, lanes = [], []
    for c in e:
        kind = _local(c)
        if kind == "flowNodeRef" and (r := (c.text or "").strip()):
            refs.append(r)
        elif kind in ("childLaneSet", "laneSet"):
            lanes += [_xml_lane(x) for x in c if _local(x) == "lane"]
    return _attributes(e) | ({"refs": refs} if refs else {}) | ({"lanes": lanes} if lanes else {})


def _xml_body(e: ET.Element) -> dict:
    lanes, nodes, flows = [], [], []
    for c in e:
        kind = _local(c)
        if kind == "laneSet":
            lanes += [_xml_lane(x) for x in c if _local(x) == "lane"]
        elif kind == "sequenceFlow":
            flows.append(_attributes(c) | {"source": c.get("sourceRef"), "target": c.get("targetRef")} | _said(c, "conditionExpression"))
        elif (k := kind.lower()).endswith(NODE_ENDINGS):
            nodes.append(_attributes(c) | {"type": kind} | _said(c, "documentation") | (_xml_body(c) if k.endswith(NESTING_TAGS) else {}))
    return {k: v for k, v in (("lanes", lanes), ("nodes", nodes), ("flows", flows)) if v}


def record_of_xml(text: str | None) -> str | None:
    if not text or "<" not in text:
        return None
    try:
        root = ET.fromstring(text.strip("\ufeff\u200b \t\r\n"))
        processes = [_attributes(p) | _xml_body(p) for p in root.iter() if _local(p) == "process"]
        return json.dumps({"processes": processes}, ensure_ascii=False) if any(any(k in p for k in LISTS) for p in processes) else None
    except (ET.ParseError, ValueError, RecursionError, LookupError):
        return None


READERS = {"json": record_of_json, "xml": record_of_xml}


def record_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (origin, record_key, form, text) to (origin, record_key, doc), without the records that hold no model."""
    for b in batches:
        docs = [READERS[f](t) for f, t in zip(b["form"].to_pylist(), b["text"].to_pylist())]
        keep = pa.array([d is not None for d in docs], pa.bool_())
        out = pa.RecordBatch.from_arrays([b["origin"], b["record_key"], pa.array(docs, pa.string())], ["origin", "record_key", "doc"])
        yield out.filter(keep)
