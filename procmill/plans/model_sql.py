"""SQL that reads JSON process models as DuckDB can: common table expressions of their processes, nodes and edges, for the queries of graph.py."""

from __future__ import annotations

_BARE = r"regexp_replace({}, '^[\x{{feff}}\x{{200b}}\s]+|[\x{{feff}}\x{{200b}}\s]+$', '', 'g')"
_INNER = r"regexp_extract({0}, '(?s)\{{.*\}}')"


def _value(t: str) -> str:
    """The JSON value that text t holds, by itself or inside other text."""
    inner = _INNER.format(t)
    return f"CASE WHEN json_valid({t}) THEN {t} WHEN json_valid({inner}) THEN {inner} END"


def _unquoted(j: str) -> str:
    return f"CASE WHEN json_type({j}) = 'VARCHAR' THEN json_extract_string({j}, '$') ELSE {j} END"


def _first(item: str, *keys: str) -> str:
    """The first of the keys' values that is a scalar and not empty."""
    one = lambda k: f"nullif(CASE WHEN json_type({item}, '$.{k}') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN json_extract_string({item}, '$.{k}') END, '')"
    return f"coalesce({', '.join(map(one, keys))}, NULL)"


def _items(of: str, key: str) -> str:
    """A list of JSON objects, also of one that stands alone."""
    return f"CASE json_type({of}, '$.{key}') WHEN 'ARRAY' THEN CAST(json_extract({of}, '$.{key}') AS JSON[]) WHEN 'OBJECT' THEN [json_extract({of}, '$.{key}')] ELSE [] END"


_TRIGGER = "CASE WHEN low LIKE '%message%' THEN 'Message' WHEN low LIKE '%timer%' THEN 'Timer' WHEN low LIKE '%signal%' THEN 'Signal' WHEN low LIKE '%error%' THEN 'Error' WHEN low LIKE '%escalation%' THEN 'Escalation' ELSE '' END"
_KIND = f"""CASE WHEN low LIKE '%gateway' THEN CASE low WHEN 'parallelgateway' THEN 'parallelGateway' WHEN 'inclusivegateway' THEN 'inclusiveGateway' WHEN 'eventbasedgateway' THEN 'eventBasedGateway' ELSE 'exclusiveGateway' END
WHEN low LIKE '%event%' THEN CASE WHEN low LIKE 'start%' THEN 'start' || CASE WHEN {_TRIGGER} = 'Message' THEN 'Message' ELSE '' END WHEN low LIKE 'end%' THEN 'end' || CASE WHEN {_TRIGGER} IN ('Message', 'Error') THEN {_TRIGGER} ELSE '' END WHEN low LIKE '%throw%' THEN 'throw' || {_TRIGGER} ELSE 'catch' || {_TRIGGER} END || 'Event'
WHEN low = 'subprocess' THEN 'subProcess' WHEN low = 'callactivity' THEN 'callActivity' WHEN low = 'transaction' THEN 'transaction' WHEN low = 'adhocsubprocess' THEN 'adHocSubProcess'
ELSE CASE regexp_replace(low, 'task$', '') WHEN 'manual' THEN 'manualTask' WHEN 'service' THEN 'serviceTask' WHEN 'user' THEN 'userTask' WHEN 'script' THEN 'scriptTask' WHEN 'send' THEN 'sendTask' WHEN 'receive' THEN 'receiveTask' WHEN 'businessrule' THEN 'businessRuleTask' WHEN 'rule' THEN 'businessRuleTask' ELSE 'task' END END"""
_CATEGORY = "CASE WHEN kind LIKE '%Gateway' THEN NULL WHEN kind LIKE '%Event' THEN 'event:' || regexp_extract(kind, '^(start|end|catch|throw)') WHEN kind IN ('subProcess', 'callActivity', 'transaction', 'adHocSubProcess') THEN 'subprocess' ELSE 'task' END"
_LABEL = "coalesce(nullif(CASE WHEN cat LIKE 'event:%' AND trim(name) IN ('start', 'end') THEN '' ELSE trim(name) END, ''), '<' || regexp_replace(cat, '^.*:', '') || '>')"


def models(table: str, text: str, key: str = "id", more: str = "") -> str:
    """Expressions g (rid, key, no: each process), n (rid, no, id, pos, kind, cat, name, label) and e (rid, no, pos, s, t, cond). Rows count as often as they stand."""
    return f"""raw AS (SELECT row_number() OVER () AS rid, {key} AS key{more}, {_BARE.format(text).replace('{{', '{').replace('}}', '}')} AS txt FROM {table} WHERE {text} IS NOT NULL),
j1 AS (SELECT * EXCLUDE (txt), {_value('txt').replace('{{', '{').replace('}}', '}')} AS j FROM raw),
j2 AS (SELECT * REPLACE ({_unquoted('j')} AS j) FROM j1 WHERE j IS NOT NULL),
j3 AS (SELECT * REPLACE ({_value('j').replace('{{', '{').replace('}}', '}')} AS j) FROM j2),
j4 AS (SELECT * REPLACE ({_unquoted('j')} AS j) FROM j3 WHERE j IS NOT NULL),
p0 AS (SELECT * EXCLUDE (j), CASE WHEN json_type(j, '$.processos') IN ('ARRAY', 'OBJECT') THEN {_items('j', 'processos')} WHEN json_type(j, '$.processes') IN ('ARRAY', 'OBJECT') THEN {_items('j', 'processes')} WHEN json_type(j) = 'ARRAY' THEN CAST(j AS JSON[]) ELSE [CAST(j AS JSON)] END AS ps FROM j4 WHERE json_valid(j)),
g AS (SELECT * FROM (SELECT * EXCLUDE (ps), unnest(ps) AS p, generate_subscripts(ps, 1) AS no FROM p0) WHERE json_type(p) = 'OBJECT' AND (json_exists(p, '$.nodes') OR json_exists(p, '$.flows'))),
n0 AS (SELECT rid, no, unnest({_items('p', 'nodes')}) AS x, generate_subscripts({_items('p', 'nodes')}, 1) AS pos FROM g),
n1 AS (SELECT rid, no, pos, {_first('x', 'id')} AS id, regexp_replace(lower(coalesce({_first('x', 'type')}, '')), '[^a-z]', '', 'g') AS low, coalesce({_first('x', 'name')}, '') AS name FROM n0 WHERE json_type(x) = 'OBJECT'),
n2 AS (SELECT rid, no, id, min(pos) AS pos, arg_max(low, pos) AS low, arg_max(name, pos) AS name FROM n1 WHERE id IS NOT NULL GROUP BY ALL),
n3 AS (SELECT *, {_KIND} AS kind FROM n2), n4 AS (SELECT *, {_CATEGORY} AS cat FROM n3), n AS (SELECT *, CASE WHEN cat IS NOT NULL THEN {_LABEL} END AS label FROM n4),
e0 AS (SELECT rid, no, unnest({_items('p', 'flows')}) AS x, generate_subscripts({_items('p', 'flows')}, 1) AS pos FROM g),
e AS (SELECT rid, no, pos, coalesce({_first('x', 'from', 'source')}, '') AS s, coalesce({_first('x', 'to', 'target')}, '') AS t, coalesce({_first('x', 'cond', 'condition')}, '') AS cond FROM e0 WHERE json_type(x) = 'OBJECT')"""


#: Which activity follows which through routing, per process: expression f (rid, no, a, b: node ids).
FOLLOWS = """act AS (SELECT rid, no, id, label FROM n WHERE cat IS NOT NULL),
r(rid, no, a, x) AS (SELECT e.rid, e.no, e.s, e.t FROM e JOIN act ON act.rid = e.rid AND act.no = e.no AND act.id = e.s UNION SELECT r.rid, r.no, r.a, e.t FROM r JOIN e ON e.rid = r.rid AND e.no = r.no AND e.s = r.x WHERE NOT EXISTS (SELECT 1 FROM act WHERE act.rid = r.rid AND act.no = r.no AND act.id = r.x)),
f AS (SELECT r.rid, r.no, r.a, r.x AS b FROM r JOIN act ON act.rid = r.rid AND act.no = r.no AND act.id = r.x)"""

#: Inner edges i, the start st (null without one), everything reached from it re, connected parts cp.
STRUCTURE = """i AS (SELECT e.* FROM e JOIN n a ON a.rid = e.rid AND a.no = e.no AND a.id = e.s JOIN n b ON b.rid = e.rid AND b.no = e.no AND b.id = e.t),
d AS (SELECT n.rid, n.no, n.id, n.pos, n.kind, (SELECT count(*) FROM i WHERE i.rid = n.rid AND i.no = n.no AND i.s = n.id) AS n_out, (SELECT count(*) FROM i WHERE i.rid = n.rid AND i.no = n.no AND i.t = n.id) AS n_in, (SELECT count(*) FROM i WHERE i.rid = n.rid AND i.no = n.no AND i.s = n.id AND i.cond = '') AS n_bare FROM n),
sc AS (SELECT rid, no, count(*) FILTER (kind = 'startEvent') AS n_starts, arg_min(id, pos) FILTER (kind = 'startEvent') AS s1, arg_min(id, pos) FILTER (kind = 'startEvent' AND n_in = 0) AS s2, arg_min(id, pos) FILTER (n_in = 0) AS s3 FROM d GROUP BY ALL),
st AS (SELECT rid, no, CASE WHEN n_starts = 1 THEN s1 WHEN n_starts > 1 THEN coalesce(s2, s1) ELSE s3 END AS start FROM sc),
re(rid, no, id) AS (SELECT rid, no, start FROM st WHERE start IS NOT NULL UNION SELECT i.rid, i.no, i.t FROM re JOIN i ON i.rid = re.rid AND i.no = re.no AND i.s = re.id),
cp(rid, no, a, b) AS (SELECT rid, no, id, id FROM n UNION SELECT cp.rid, cp.no, cp.a, CASE WHEN i.s = cp.b THEN i.t ELSE i.s END FROM cp JOIN i ON i.rid = cp.rid AND i.no = cp.no AND (i.s = cp.b OR i.t = cp.b)),
cm AS (SELECT rid, no, count(DISTINCT least_id) AS n_components FROM (SELECT rid, no, a, min(b) AS least_id FROM cp GROUP BY ALL) GROUP BY ALL)"""


def _attribute(name: str) -> str:
    one = lambda q: rf"regexp_extract(tag, '\s{name}\s*=\s*{q}([^{q}]*){q}', 1)"
    return f"coalesce(nullif({one(chr(34))}, ''), {one(chr(39) * 2)})"


def xml_models(table: str, text: str, keys: str) -> str:
    """Expressions g, n and e as in `models`, of well-formed XML texts without entities: one process (no 1) for each row with these keys."""
    return rf"""g AS (SELECT row_number() OVER () AS rid, 1 AS no, {keys}, regexp_replace({text}, '(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>', '', 'g') AS x FROM {table}),
tg0 AS (SELECT rid, unnest(regexp_extract_all(x, '(?s)<[A-Za-z_][^<>]*>')) AS tag, generate_subscripts(regexp_extract_all(x, '(?s)<[A-Za-z_][^<>]*>'), 1) AS pos FROM g),
tg AS (SELECT rid, pos, regexp_extract(tag, '^<(?:[\w.-]+:)?([\w.-]+)', 1) AS kind, {_attribute('id')} AS id, {_attribute('name')} AS name, {_attribute('sourceRef')} AS s, {_attribute('targetRef')} AS t FROM tg0),
e AS (SELECT rid, 1 AS no, pos, s, t FROM tg WHERE kind = 'sequenceFlow' AND s <> '' AND t <> ''), ends AS (SELECT rid, s AS id FROM e UNION SELECT rid, t FROM e),
c0 AS (SELECT *, CASE WHEN kind LIKE '%Gateway%' THEN NULL WHEN regexp_matches(kind, '^(?i)(start|end|(intermediate)?(catch|throw))[A-Za-z]*Event$') THEN 'event:' || lower(regexp_extract(kind, '^(?i)(?:intermediate)?(start|end|catch|throw)', 1)) WHEN kind IN ('subProcess', 'callActivity', 'transaction', 'adHocSubProcess') THEN 'subprocess' WHEN kind = 'task' OR kind LIKE '%Task' THEN 'task' END AS cat FROM tg WHERE id <> '' AND kind NOT IN ('sequenceFlow', 'lane', 'process')),
n1 AS (SELECT c0.rid, 1 AS no, c0.id, pos, kind, name, CASE WHEN cat IS NULL AND kind NOT LIKE '%Gateway%' THEN 'activity' ELSE cat END AS cat FROM c0 LEFT JOIN ends ON ends.rid = c0.rid AND ends.id = c0.id WHERE cat IS NOT NULL OR kind LIKE '%Gateway%' OR ends.id IS NOT NULL),
n AS (SELECT *, CASE WHEN cat IS NOT NULL THEN {_LABEL} END AS label FROM n1)"""
