"""Defective prompt and answer pairs (problem 4).

Several noisy labelling functions per defect look at a pair, each at evidence of its own, and vote yes, no or nothing. An
expectation-maximization label model (Dawid and Skene 1979, two classes per defect) learns from the counts of vote patterns how far
each function can be trusted; it sees a few hundred patterns a defect at most, whatever the number of rows. A pair keeps every defect
whose posterior exceeds its cutoff. Cutoffs come from the pattern counts of all pairs, too; defects planted in words that no function
was written for serve to validate them only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from procmill.functions.models import read_json
from procmill.llm.words import words
from procmill.session import ship

#: In order of precedence where one defect per pair is asked for and posteriors are equal.
DEFECTS = ("empty", "refusal", "copy", "truncated", "other_language")

#: Names of the sections of structured answers in the languages of the data, and what such an answer ends with.
FRAME = frozenset("process end_process end actors main flow decisions parallel notes none json xml text".split())
OPENERS = ("PROCESS:", "PROCESSO:", "PROCESO:", "PROZESS:", "PROCESSUS:")
LAST_SECTIONS = ("NOTES:", "NOTAS:", "HINWEISE:", "OBSERVAÇÕES:", "OBSERVACIONES:", "ANMERKUNGEN:")
#: Closed classes of English: negation and regret, demands, persons; and what a text about the task itself is about.
_NOT = re.compile(r"\b(?:not|no|nor|never|cannot|without|unable|sorry|apolog\w*|unfortunately|regret\w*|declin\w*|refus\w*|rather|instead|beyond|outside|please|first|need|unless|until)\b|n't\b", re.I)
_PERSON = re.compile(r"\b(?:i|we|me|my|us|our|you|your|as an? [a-z ]{0,20}(?:model|assistant|ai))\b|\b(?:i|we|you)'", re.I)
_TASK = re.compile(r"\b(?:requests?|texts?|transcripts?|inputs?|outputs?|process|models?|tasks?|material|content|information|descriptions?|documents?|help|assist\w*|provid\w*|produc\w*|generat\w*|writ\w*|restructur\w*|extract\w*|creat\w*|answer\w*|context|capabilit\w*|guidelines?|polic\w+|work|begin|start|do)\b", re.I)
_INVISIBLE = re.compile(r"[\s\u200b-\u200f\u2060\ufeff\u00ad`]+")
_FENCE = re.compile(r"```\w*")
_LETTER = re.compile(r"[^\W\d_]+")


def _open_brackets(s: str) -> int:
    """Brackets and strings still open at the end of a text that begins a JSON value."""
    depth, quoted, i = 0, False, 0
    for m in re.finditer(r'\\.|"|[{\[]|[}\]]', s, re.S):
        c = m.group()
        if c == '"':
            quoted = not quoted
        elif not quoted and len(c) == 1:
            depth += 1 if c in "{[" else -1
    return depth + quoted


def _strings(v, out: list[str]) -> list[str]:
    if isinstance(v, str):
        out.append(v)
    elif isinstance(v, dict):
        for x in v.values():
            _strings(x, out)
    elif isinstance(v, list):
        for x in v:
            _strings(x, out)
    return out


def _names(v, out: list[str]) -> list[str]:
    """What a model says to people: names, pools, labels and notes, not ids, kinds and references."""
    if isinstance(v, dict):
        for k, x in v.items():
            if isinstance(x, str):
                if k.lower() in ("name", "pool", "process", "doc", "label", "cond", "condition", "title", "text"):
                    out.append(x)
            else:
                _names(x, out)
    elif isinstance(v, list):
        for x in v:
            _names(x, out)
    return out


def _grams(ws: list[str]) -> set:
    return set(zip(ws, ws[1:], ws[2:]))


def _longest_run(a: list[str], b: list[str], k: int = 8) -> int:
    """About the longest run of words that b shares with a, in runs of k words one after another."""
    have, best, now = set(zip(*(a[i:] for i in range(k)))), 0, 0
    for g in zip(*(b[i:] for i in range(k))):
        now = now + 1 if g in have else 0
        best = max(best, now)
    return best + k - 1 if best else 0


class Voter:
    """Votes on one pair. lists: words of each language; a word in two lists counts for neither."""

    def __init__(self, lists: dict[str, frozenset[str]]):
        fold = {k: {x for w in v for x in words(w)} for k, v in lists.items()}
        self.common = frozenset(fold.get("en", ()))
        others = frozenset(w for k, v in fold.items() if k != "en" for w in v)
        self.foreign, self.english, self.shared = others - self.common, self.common - others, self.common & others

    def votes(self, given: str | None, answer: str | None) -> list[str]:
        """One pattern for each defect: 1, 0 or - of each of its functions."""
        text = answer or ""
        bare = _INVISIBLE.sub(" ", _FENCE.sub(" ", text)).strip()
        ws, source = words(text), words(given)
        value = read_json(text) if bare[:1] in ("{", "[", '"') or "{" in text else None
        is_json = isinstance(value, (dict, list))
        opened = re.search(r"[{\[]\s*\\?[\"{]", bare)
        starts_json = bare[:1] in ("{", "[") or bare[:2] in ('"{', '"[') or bool(opened)
        said = _strings(value, []) if is_json else []
        nodes = is_json and bool(re.search(r'"nodes"\s*:\s*\[\s*[^\]\s]|\\"nodes\\"\s*:\s*\[\s*[^\]\s]', text))
        framed = "PROCESS---" in text or any(o in text for o in OPENERS)
        content = [w for w in (words(" ".join(said)) if is_json else ws) if w not in FRAME]
        loose = "" if nodes or framed or starts_json and not is_json else " ".join(said) if is_json else bare  # what stands in no structure
        loose = loose.replace("’", "'")
        rows = sum(1 for x in text.split("\n") if re.match(r"\s*(?:[-*•]|\d+[.)])\s*\S", x))
        filled = nodes or framed and rows > 0 or starts_json and not is_json
        known = set(source)
        long = {w for w in content if len(w) > 3}
        told = len(long & known) / len(long) if long else 0.0  # how much of it the input says too
        grams, own = _grams(source), _grams(ws)
        both = len(grams & own)
        covers, made = both / max(len(grams), 1), both / max(len(own), 1)
        if made >= 0.5:
            loose = ""  # the input's own words say nothing about the task
        out = []

        # empty: hardly a word, no filled structure, nothing of the input, no sentence, hardly a letter
        out.append("".join((
            f"{len(content) <= 4 and not nodes:d}", f"{not filled:d}", "-" if not source else f"{not long & known:d}",
            f"{sum(w in self.common for w in content) < 2 and len(content) < 6 and not nodes:d}", f"{sum(map(len, content)) < 24 and not nodes:d}",
        )))

        # refusal: negation or demand, persons, no structure but a few sentences, talk of the task, not of the input
        n = len(words(loose))
        out.append("".join((
            f"{bool(_NOT.search(loose)):d}", f"{bool(_PERSON.search(loose)):d}", f"{5 <= n <= 120:d}", f"{n >= 4 and bool(_TASK.search(loose)):d}",
            "-" if n < 4 or not source else f"{told < 0.35:d}",
        )))

        # copy: most of the input's runs of words are here, most of these are the input's, one long run, as long, in the input's form
        if is_json and nodes or not ws or not given:
            out.append("00000" if given else "-----")
            overlap = 0.0
        else:
            overlap = min(covers, made)
            like = (any(o in given for o in OPENERS) or "PROCESS---" in given) == framed and not starts_json
            out.append(f"{covers >= 0.7:d}{made >= 0.7:d}{_longest_run(source, ws) >= 0.5 * len(source):d}{0.5 <= len(ws) / max(len(source), 1) <= 2:d}{like:d}" if len(own) >= 3 else "00000")

        # truncated: something is left open, the end that such answers have is missing, the last words break off
        copied = overlap >= 0.7
        last = text.rstrip().rstrip("`").rstrip()
        if is_json or not content and not starts_json:
            out.append("000-")
        elif starts_json and not framed:
            at = min(i for i in (bare.find("{"), bare.find("[")) if i >= 0)
            cut = _open_brackets(bare[at:].replace('\\"', '"') if bare[:1] == '"' else bare[at:]) > 0
            out.append(f"{cut:d}{cut or not last.endswith(('}', ']', '"')):d}{cut or not last.endswith(('}', ']', '"')):d}{cut:d}" if cut or not last.endswith(("}", "]", '"')) else "0000")
        elif framed and not copied:
            unclosed = "-" if not text.count("---PROCESS---") else "1" if "---END_PROCESS---" not in text else "0"
            missing = not any(s in text.upper() for s in LAST_SECTIONS)
            tail = last.rsplit("\n", 1)[-1].strip()
            abrupt = last.endswith(("…", "...", "[", ",", ":", ";")) or not (last.endswith((".", "!", "?", '"', "'", ")", "---", "”")) or tail.lower().lstrip("-• ").rstrip(".") in ("none", "not specified", "n/a", "-", ""))
            broken = "-" if not abrupt or not ws else f"{ws[-1] not in known and ws[-1] not in ws[:-1] and ws[-1] not in self.common:d}"
            out.append(f"{unclosed}{missing:d}{abrupt:d}{broken}" if content else "000-")
        else:
            out.append("000-")

        # other language: words of the content without what the frame says, names by name, letters beyond ASCII, last letters
        names = _names(value, []) if is_json else [x for x in (re.sub(r"^[^\w]*(?:[A-ZÀ-Ý][A-ZÀ-Ý_ ]+:|\d+[.)])?", "", y) for y in text.split("\n")) if x.strip()] if framed else [text]
        if not is_json and starts_json and not framed:
            names = re.findall(r'\\?"(?:name|pool|process|doc)\\?"\s*:\s*\\?"([^"\\]+)', text)
        if len(content) < 3 or not names:
            out.append("0000")
        else:
            split = [words(x) for x in names]
            foreign = sum(1 for x in split for w in x if w in self.foreign)
            english = sum(1 for x in split for w in x if w in self.english)
            telling = self.foreign | self.shared if foreign >= 2 and not english else self.foreign
            marked = sum(1 for x, raw in zip(split, names) if any(w in telling for w in x) or not raw.isascii() and re.search(r"[à-öø-ÿœß]", raw.lower())) / max(len(split), 1)
            total = sum(map(len, split))
            letters = sum(1 for x in names for w in _LETTER.findall(x) if not w.isascii()) / max(total, 1)
            heads = {w for x in re.findall(r"(?m)^([A-ZÀ-Ý][A-ZÀ-Ý ]{2,}):?", text) for w in words(x)} if framed else set()
            few = total < 6 or foreign + english < 2
            ends = sum(1 for x in split for w in x if w[-1] in "aeo" and len(w) > 2 or len(w) == 1 and w.isalpha()) / max(total, 1)
            out.append(f"{'-' if few else f'{foreign > 2 * english:d}'}{marked >= 0.5 and foreign > english:d}{(len(heads - FRAME) >= 2 or letters > 0.08) and foreign >= english:d}{'-' if total < 6 else f'{ends > 0.45 and foreign >= english:d}'}")
        return out


# ---- the label model ----

class Posteriors(dict):
    """pattern -> probability of the defect; patterns that the data lack are worked out when they are asked for."""

    prior, hit, false = 0.02, np.empty(0), np.empty(0)

    def of(self, votes: np.ndarray) -> np.ndarray:
        yes, no = votes == 1, votes == 0
        a = np.log(self.prior) + (yes * np.log(self.hit) + no * np.log(1 - self.hit)).sum(axis=1)
        b = np.log(1 - self.prior) + (yes * np.log(self.false) + no * np.log(1 - self.false)).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(b - a, -500, 500)))

    def __missing__(self, pattern: str) -> float:
        if not len(self.hit):
            return float(2 * pattern.count("1") > len(pattern))
        self[pattern] = q = float(self.of(_numbers([pattern]))[0])
        return q


def _numbers(patterns: list[str]) -> np.ndarray:
    return np.array([[-1 if c == "-" else int(c) for c in p] for p in patterns])


def posteriors(counts: dict[str, int], rounds: int = 200) -> Posteriors:
    """The probability of the defect for each vote pattern, from the number of pairs with each pattern.

    EM with priors that hold a function for right more often than not: a tenth of defects missed, one false alarm in a hundred.
    """
    m = Posteriors()
    pats = sorted(counts)
    if not pats:
        return m
    n, v = np.array([counts[p] for p in pats], float), _numbers(pats)
    yes, no = v == 1, v == 0
    m.hit, m.false = np.full(v.shape[1], 0.9), np.full(v.shape[1], 0.01)
    q = np.zeros(len(pats))
    for _ in range(rounds):
        new = m.of(v)
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
        w1, w0 = n * q, n * (1 - q)
        m.hit = np.clip(((w1[:, None] * yes).sum(axis=0) + 18) / ((w1[:, None] * (yes | no)).sum(axis=0) + 20), 0.5, 0.999)
        m.false = np.clip(((w0[:, None] * yes).sum(axis=0) + 0.5) / ((w0[:, None] * (yes | no)).sum(axis=0) + 50), 1e-5, 0.4)
        m.prior = float(np.clip((w1.sum() + 1) / (n.sum() + 50), 1e-5, 0.5))
    m.update((p, float(x)) for p, x in zip(pats, q))
    return m


def plant(given: str, answer: str, no: int) -> dict[str, tuple[str, str]]:
    """A pair with each defect planted, in words that the functions do not list; JSON where the answer is JSON."""
    cut = max(len(answer) * (35 + no * 13 % 45) // 100, 20)
    excuses = (
        "I'd rather leave this one to somebody else.", "Could you send me the whole transcript before I write anything?", "This is not a thing that I am going to put into steps.", "We only handle harmless subjects, so you will get no model here.",
        "My rules keep me from turning this into a process.", "There is too little to go on; tell me more and I will try.",
    )
    foreign = (
        "Registrar o pedido no sistema da empresa", "Depois a equipe confere os dados e envia para o setor", "Isso não é feito sem uma cópia do contrato", "Enviar la solicitud a la oficina para que la revise", "El empleado no puede firmar sin una copia del contrato",
    )
    names = [foreign[(no + k) % len(foreign)] for k in range(4)]
    if answer.lstrip("`json \n\ufeff")[:1] in ("{", "["):
        other = json.dumps({"pool": names[0], "nodes": [{"id": f"n{k}", "type": "task", "name": x} for k, x in enumerate(names)], "flows": []}, ensure_ascii=False)
        excuse = json.dumps({"message": excuses[no % 6]}) if no % 2 else excuses[no % 6]
    else:
        other, excuse = f"PROCESS: {names[0]}\n\nACTORS:\n- {names[1]}\n\nMAIN FLOW:\n1. {names[2]}\n\nNOTES:\n- {names[3]}.", excuses[no % 6]
    empty = ("", "nil", "...", "```\n\n```", "{ }", "to follow", "[]", "(see file)")[no % 8]
    return {"empty": (given, empty), "refusal": (given, excuse), "copy": (given, given if no % 2 else "As you sent it:\n\n" + given), "truncated": (given, answer.rstrip()[:cut]), "other_language": (given, other)}


def cutoffs(voter: Voter, pairs: list[tuple[str, str]], tables: dict[str, dict[str, float]], counts: dict[str, dict[str, int]], half: int = 0) -> dict[str, float]:
    """Per defect, the cutoff with the best expected F1, half-way to the next posterior; 0.5 without pairs.

    Hits are those of defects planted in every other pair (from number `half`; the others are left for validation). False alarms are
    those that the label model expects among all pairs: of each pattern above the cutoff its count times the probability of no defect.
    """
    out = {}
    planted = [voter.votes(*plant(g, a, no)[d])[i] for no, (g, a) in enumerate(pairs) if no % 2 == half for i, d in enumerate(DEFECTS)]
    for i, d in enumerate(DEFECTS):
        table, n = tables[d], counts[d]
        hits = [table[p] for p in planted[i :: len(DEFECTS)]]
        real = sum(k * table[p] for p, k in n.items())
        best = (-1.0, 0.0, 0.5)
        values = sorted({*hits, *(table[p] for p in n), 0.0, 1.0})
        for low, high in zip(values, values[1:]):
            at = (low + high) / 2
            recall = sum(x > at for x in hits) / len(hits) if hits else 0.0
            false = sum(k * (1 - table[p]) for p, k in n.items() if table[p] > at)
            tp = recall * real
            f1 = 2 * tp / (tp + false + real) if tp else 0.0
            if (round(f1, 6), -abs(at - 0.5)) > best[:2]:
                best = (round(f1, 6), -abs(at - 0.5), at)
        out[d] = min(max(best[2], 0.05), 0.95)
    return out


def expected_cutoffs(tables: dict[str, dict[str, float]], counts: dict[str, dict[str, int]]) -> dict[str, float]:
    """Per defect, the cutoff with the best expected F1 over all pairs, half-way to the next posterior: a pattern counts as many defects
    as it has pairs times its posterior, found if that is above the cutoff, else missed."""
    out = {}
    for d in DEFECTS:
        by: dict[float, int] = {}
        for p, k in counts[d].items():
            by[tables[d][p]] = by.get(tables[d][p], 0) + k
        real = sum(k * q for q, k in by.items())
        best = (-1.0, 0.0, 0.5)
        values = sorted({*by, 0.0, 1.0})
        for low, high in zip(values, values[1:]):
            at = (low + high) / 2
            over = [(q, k) for q, k in by.items() if q > at]
            tp = sum(k * q for q, k in over)
            f1 = 2 * tp / (sum(k for _, k in over) + real) if tp else 0.0
            if (round(f1, 6), -abs(at - 0.5)) > best[:2]:
                best = (round(f1, 6), -abs(at - 0.5), at)
        out[d] = min(max(best[2], 0.05), 0.95)
    return out


# ---- in Spark ----

def _vote(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voter = Voter(shared.value)
        for b in batches:
            got = [voter.votes(g, a) for g, a in zip(b["given"].to_pylist(), b["answer"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["table_name"], b["row_id"], *[pa.array([x[i] for x in got], pa.string()) for i in range(len(DEFECTS))]], ["table_name", "row_id", *DEFECTS])

    return run


def pair_rows(tables: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """(table_name, row_id, given, answer) of the succeeded rows. tables: (rows, name, input column, output column)."""
    parts = [df.where((F.col("status") == "succeeded") & F.col("id").isNotNull()).select(F.lit(name).alias("table_name"), F.col("id").alias("row_id"), F.col(i).alias("given"), F.col(o).alias("answer")) for df, name, i, o in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def labelled(pairs: DataFrame, common_words: DataFrame, fixed: dict[str, float] | None = None) -> DataFrame:
    """(table_name, row_id, defects: array of (defect, posterior)), distinct; only pairs with a defect, the most certain first.

    fixed: cutoffs to use instead of chosen ones. Null answers are empty; null inputs are copied by nothing. Rows repeated with the
    same texts collapse. An empty table gives no rows. Extra columns are left out.
    """
    from procmill.session import materialize, spread

    spark = pairs.sparkSession
    ship(spark)
    lists: dict[str, set] = {}
    rows = common_words.where("lang is not null and word is not null").select("lang", "word").distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("common_words has more than 100,000 rows")
    for r in rows:
        lists.setdefault(r["lang"], set()).add(r["word"])
    known = {k: frozenset(v) for k, v in lists.items()}
    kind = "table_name string, row_id bigint, " + ", ".join(f"{d} string" for d in DEFECTS)
    votes = materialize(spread(pairs).mapInArrow(_vote(spark.sparkContext.broadcast(known)), kind), "votes")
    seen = votes.select(F.explode(F.array(*[F.struct(F.lit(d).alias("defect"), F.col(d).alias("pattern")) for d in DEFECTS])).alias("v")).groupBy("v.defect", "v.pattern").agg(F.count("*").alias("n")).collect()
    tables = {d: posteriors({r["pattern"]: r["n"] for r in seen if r["defect"] == d}) for d in DEFECTS}
    if fixed is None:
        counts = {d: {r["pattern"]: r["n"] for r in seen if r["defect"] == d} for d in DEFECTS}
        fixed = expected_cutoffs(tables, counts)
    return votes.select("table_name", "row_id", _defects(tables, fixed).alias("defects")).where(F.size("defects") > 0).distinct()


def _defects(tables: dict[str, dict[str, float]], fixed: dict[str, float]) -> Column:
    def one(i: int, d: str) -> Column:
        entries = [x for p, q in sorted(tables[d].items()) for x in (F.lit(p), F.lit(q))]
        q = F.coalesce(F.element_at(F.create_map(*entries), F.col(d)), F.lit(0.0)) if entries else F.lit(0.0)
        return F.struct((-q).alias("_q"), F.lit(i).alias("_i"), F.lit(d).alias("defect"), q.alias("posterior"), (q > fixed.get(d, 0.5)).alias("over"))

    all_of = F.array(*[one(i, d) for i, d in enumerate(DEFECTS)])
    return F.transform(F.array_sort(F.filter(all_of, lambda x: x["over"])), lambda x: F.struct(x["defect"].alias("defect"), x["posterior"].alias("posterior")))


def found(pairs: DataFrame, common_words: DataFrame) -> DataFrame:
    """(table_name, row_id, defect): the first defect, by certainty and then by the order of DEFECTS."""
    return labelled(pairs, common_words).select("table_name", "row_id", F.col("defects")[0]["defect"].alias("defect")).distinct()


def labels(pairs: DataFrame, common_words: DataFrame) -> DataFrame:
    """All defects kept, one row each, with their posteriors."""
    return labelled(pairs, common_words).select("table_name", "row_id", F.explode("defects").alias("d")).select("table_name", "row_id", "d.defect", "d.posterior")
