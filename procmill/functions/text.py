"""Text functions as Column expressions; all but the readers of JSON objects stay inside the JVM."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, StringType

# Patterns that decide what counts as a step, an action, an actor and so on in procedural text.
PROCESS_WORDS = r"(?i)\b(steps?|procedure|workflow|process|runbook|playbook|handoff|handover|onboarding|offboarding|lifecycle|pipeline)\b"
ACTION_WORDS = r"(?i)\b(open|create|submit|review|approve|assign|notify|validate|escalate|click|navigate|select|ensure|verify|complete|request|send|receive|confirm|update|check|schedule|initiate|close|resolve|forward|upload|download|configure|provision|revoke|terminate|cancel)\b"
ACTOR_WORDS = r"(?i)\b(user|manager|team\s+member|owner|requester|reviewer|engineer|analyst|coordinator|specialist|approver|admin|lead|director|stakeholder|DRI|on-call)\b"
CONDITION_WORDS = r"(?i)\b(if\s+the|if\s+a|if\s+you|when\s+the|when\s+a|unless|otherwise|depending\s+on|in\s+case|in\s+the\s+event)\b"
NUMBERED_STEP = r"(?m)^\s*\d+\.\s+"
LEGAL_TITLE = r"(?i)\b(CONFIDENTIALITY|LIMITATION\s+OF\s+LIABILITY|INDEMNIFI\w*|INTELLECTUAL\s+PROPERTY|FORCE\s+MAJEURE|MISCELLANEOUS|U\.?S\.?\s+GOVERNMENT|GOVERNING\s+LAW|DISPUTE\s+RESOLUTION|SEVERABILITY|ENTIRE\s+AGREEMENT|WAIVER|REPRESENTATIONS?\s+AND\s+WARRANTIES|DEFINITIONS?\b|APPENDIX)\b"
CLASS_ACTORS = r"(?i)\b(manager|team\s+member|engineer|reviewer|approver|analyst|coordinator|specialist|lead|director|admin|stakeholder|DRI|on-call)\b"


def count_of(text: str | Column, pattern: str) -> Column:
    return F.regexp_count(text if isinstance(text, Column) else F.col(text), F.lit(pattern))


def tiers(n: Column, *steps: tuple[int, int]) -> Column:
    """The points of the highest step that n reaches, else 0. steps: (at least, points), highest first."""
    out = F.lit(0)
    for least, points in reversed(steps):
        out = F.when(n >= least, points).otherwise(out)
    return out


def procedural_score(text: str, title: str) -> Column:
    """Points for process words (2 at most), actions, actors (2 at most), conditions and numbered steps, less 5 for a legal title. Nulls count as empty."""
    t, h = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(title), F.lit(""))
    return (
        F.least(count_of(t, PROCESS_WORDS), F.lit(2)) + tiers(count_of(t, ACTION_WORDS), (8, 3), (5, 2), (3, 1)) + F.least(count_of(t, ACTOR_WORDS), F.lit(2))
        + F.when(t.rlike(CONDITION_WORDS), 1).otherwise(0) + tiers(count_of(t, NUMBERED_STEP), (3, 2), (1, 1)) - F.when(h.rlike(LEGAL_TITLE), 5).otherwise(0)
    ).cast("int")


def convertibility(text: str) -> Column:
    """ideal, good, linear or marginal: three numbered steps or more, with conditions and two different actors, one of both, or neither; or fewer steps."""
    t = F.coalesce(F.col(text), F.lit(""))
    actors = F.size(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(CLASS_ACTORS), F.lit(1)), F.lower))) >= 2
    conditions = t.rlike(CONDITION_WORDS)
    return F.when(count_of(t, NUMBERED_STEP) < 3, "marginal").when(actors & conditions, "ideal").when(actors | conditions, "good").otherwise("linear")


# ---- markdown ----

_MARKUP = {
    "front matter": [(r"(?m)\A---[ \t]*\R(?s:.*?)^---[ \t]*(?:\R|\z)", "")],
    "code": [(r"(?m)^[ \t]*(`{3,}|~{3,})[^\n]*\R(?s:.*?)^[ \t]*\1[ \t]*$", "")],
    "shortcodes": [(r"\{\{(?:<(?s:.*?)>|%(?s:.*?)%)\}\}", "")],
    # Comments, tags, braces, images and links, as their results are compared with SQL
    "html": [(r"(?s)<!--.*?-->", ""), (r"</?[a-zA-Z][^>]*>", ""), (r"\{[^}]*\}", "")],
    "images": [(r"!\[[^\]]*\]\([^)]*\)", "")],
    "links": [(r"\[([^\]]*)\]\([^)]*\)", "$1")],
    # strong (two or three marks) may stand inside a word, emphasis by one mark may not; marks touch what they mark
    "emphasis": [(r"(?<!\*)(\*{2,3})(?=[^\s*])(.+?)(?<=[^\s*])\1(?!\*)", "$2"), (r"(?<![\w*])\*(?=[^\s*])(.+?)(?<=[^\s*])\*(?![\w*])", "$1")],
    "handles": [(r"`?[\w.+-]+@(?:[\w-]+\.)+\w+`?", ""), (r"(?<=\s)(?:#[\w-]+(?=[\s,.)])|@[\w.-]+)", "")],
    "space": [(r"[ \t]+(?=\n|\z)", ""), (r"\n{3,}", "\n\n"), (r"\A\s+|\s+\z", "")],
}
#: How a table's rows read as items, by its number of columns ({0} and so on: cells, {h}: the first header).
_ITEMS = {2: "- {h}: {0} — {1}", 3: "- {0}: {1} — {2}"}


def cut(c: Column, *kinds: str) -> Column:
    """Without the markup of these kinds (keys of _MARKUP), cut in the order given."""
    for kind in kinds:
        for pattern, left in _MARKUP[kind]:
            c = F.regexp_replace(c, pattern, left)
    return c


def frontmatter_title(c: Column) -> Column:
    """The title that the front matter gives, without quotes; '' without one."""
    front = F.regexp_extract(c, _MARKUP["front matter"][0][0], 0)
    return F.regexp_replace(F.regexp_extract(front, r"(?m)^\s*title:[ \t]*(\S[^\n]*?)\s*$", 1), "^[\"'](.*)[\"']$", "$1")


def _cells(row: Column) -> Column:
    """A table row's cells without blanks around; the bars at both ends border no cells."""
    return F.transform(F.split(F.regexp_replace(row, r"^\s*\|+|\|+\s*$", ""), r"\|"), lambda x: F.trim(x))


def _items_of(block: Column) -> Column:
    """A table as items, one for each row below the first; '' for tables of more than three columns."""
    rows = F.filter(F.transform(F.split(block, r"\n"), _cells), lambda r: ~F.forall(r, lambda x: x.rlike(r"^[-:]+$")))

    def item(r: Column, head: Column) -> Column:
        out = F.concat(F.lit("- "), F.array_join(r, " | "))
        for n, form in _ITEMS.items():
            said = F.format_string(form.replace("{h}", "%1$s").replace("{0}", "%2$s").replace("{1}", "%3$s").replace("{2}", "%4$s"), head[0], F.get(r, F.lit(0)), F.get(r, F.lit(1)), F.get(r, F.lit(2)))
            out = F.when((F.size(head) == n) & (F.size(r) >= n), said).otherwise(out)
        return out

    return F.element_at(F.transform(F.array(rows), lambda rs: F.when((F.size(rs) > 1) & (F.size(rs[0]) <= 3), F.array_join(F.transform(F.slice(rs, F.lit(2), F.greatest(F.size(rs) - 1, F.lit(0))), lambda r: item(r, rs[0])), "\n")).otherwise("")), 1)


def tables_as_lists(c: Column) -> Column:
    """Tables of up to three columns as list items, wider ones dropped; the first row is the header and gives no item.

    A table is a line that begins with a bar and has another, and the lines after it that begin with one. Tables are set apart by
    marks, so a text is split once; what stands between them is left as it is.
    """
    apart = F.regexp_replace(c, r"(?m)^[ \t]*\|[^\n|]*\|[^\n]*(?:\n[ \t]*\|[^\n]*)*+\n?", "\u0001$0\u0001")
    lines = lambda items: F.when(items == "", "").otherwise(F.concat(items, F.lit("\n")))  # noqa: E731 - a table without items leaves no line
    parts = F.transform(F.split(apart, "\u0001"), lambda x, i: F.when(i % 2 == 1, lines(_items_of(F.regexp_replace(x, r"\n\z", "")))).otherwise(x))
    joined = F.array_join(parts, "")
    return F.when(c.contains("|"), F.when(c.endswith("\n"), joined).otherwise(F.regexp_replace(joined, r"\n\z", ""))).otherwise(c)


def clean_markdown(c: Column) -> Column:
    """All cleaning steps in their order, inside the JVM."""
    return cut(tables_as_lists(cut(c, "front matter", "code", "shortcodes", "html", "images", "links")), "emphasis", "handles", "space")


def sections(text: Column, title: Column, least_words: int = 100) -> Column:
    """array<struct<title, text, words>> of the parts under ## and ### headers; a part of fewer words joins the part before it, with
    its title, and is lost if there is none. The text before the first header is a part under `title` (or 'Introduction')."""
    def words(c: Column) -> Column:
        return F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))

    marked = F.regexp_replace(text, r"(?m)^#{2,3}[ \t]+(.+)$", "\u0001$1\u0002")
    raw = F.transform(F.split(F.concat(F.coalesce(F.nullif(title, F.lit("")), F.lit("Introduction")), F.lit("\u0002"), marked), "\u0001"), lambda x: F.struct(F.trim(F.substring_index(x, "\u0002", 1)).alias("title"), F.regexp_replace(F.substring_index(x, "\u0002", -1), r"\A\s+|\s+\z", "").alias("text")))
    kind = "array<struct<title:string,text:string,words:int>>"

    def merge(acc: Column, x: Column) -> Column:
        n = words(x["text"])
        last = F.element_at(acc, -1)
        joined = F.concat(last["text"], F.lit("\n\n"), x["title"], F.lit("\n\n"), x["text"])
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["title"].alias("title"), joined.alias("text"), words(joined).alias("words"))))
        return F.when(n >= least_words, F.concat(acc, F.array(F.struct(x["title"].alias("title"), x["text"].alias("text"), n.alias("words"))))).when(F.size(acc) > 0, longer).otherwise(acc).cast(kind)

    return F.aggregate(raw, F.array().cast(kind), merge)


# ---- names and small texts ----

def slug(c: Column, longest: int = 60) -> Column:
    """Lower case, word characters of any script only, blanks and hyphens as one underscore, cut at `longest`."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s-]", ""), r"(?U)\A\s+|\s+\z", ""), r"(?U)[\s-]+", "_"), 1, longest)


def word_slug(c: Column) -> Column:
    """ASCII letters and digits with single underscores between."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def normal_label(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^0-9a-z]+", " "))


def label_words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normal_label(c), " "), lambda x: x != ""))


def label_similarity(a: Column, b: Column) -> Column:
    """Shared share of the distinct words; 1 if neither has any."""
    x, y = label_words(a), label_words(b)
    n = F.size(F.array_union(x, y))
    return F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / n)


def without_fence(c: Column) -> Column:
    """The inside of a text's code fence, also of one that is not closed; other texts as they are, without blanks around."""
    t = F.regexp_replace(c, r"\A\s+|\s+\z", "")
    return F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\A```[^\n]*\n?", ""), r"\n?```\s*\z", ""), r"\A\s+|\s+\z", "")).otherwise(t)


def shortened(c: Column, longest: int, mark: str = "...") -> Column:
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest - len(mark)), F.lit(mark))).otherwise(c)


def filled(template: str, **values: Column) -> Column:
    """The template with {name} replaced by each value; null values are empty."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return out


def before(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, 1)


def options(c: Column, mark: str = ",") -> Column:
    """The parts of a list with a mark between, without blanks around and without empty parts."""
    return F.filter(F.transform(F.split(c, r"\Q" + mark + r"\E"), lambda x: F.trim(x)), lambda x: x != "")


def grams(c: Column, k: int) -> Column:
    """The runs of k words (lower case, letters and digits) as strings, in order; none for shorter texts."""
    ws = F.filter(F.split(F.regexp_replace(F.lower(c), "[^0-9a-z]+", " "), " "), lambda x: x != "")
    runs = lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))).otherwise(F.array().cast("array<string>"))
    return F.element_at(F.transform(F.array(ws), runs), 1)  # the words are bound once, not read again for every run


def joined_tokens(c: Column) -> Column:
    """Prose from tokens: no blank before a token that is one of . , ; : ! ? ) ] } - / nor after one that is ( [ { - or /. Tokens that
    only begin or end with such a mark are words. Null tokens are left out."""
    ts = F.filter(c, lambda t: t.isNotNull())
    tight = lambda t, before: t.isin(*".,;:!?)]}-/") | before.isin(*"([{-/")
    return F.element_at(F.transform(F.array(ts), lambda all_: F.array_join(F.transform(all_, lambda t, i: F.when((i == 0) | tight(t, F.get(all_, i - 1)), t).otherwise(F.concat(F.lit(" "), t))), "")), 1)


def first_object(text: str | None) -> str | None:
    """The first JSON object of a text: the one that its first brace begins; none if that is not well-formed."""
    at = (text or "").find("{")
    if at < 0:
        return None
    try:
        return json.dumps(json.JSONDecoder().raw_decode(text, at)[0], ensure_ascii=False, sort_keys=True)
    except (ValueError, RecursionError):
        return None


def last_object(text: str | None) -> str | None:
    """The first object from the right that is well-formed, by its opening brace.

    What stands right of a brace up to the next one is read first: an object that goes on beyond a brace that begins nothing can only be
    well-formed if that brace stands in a string, so only then all the rest is read. A long answer without any object is read about once.
    """
    text, d = text or "", json.JSONDecoder()
    at, end = text.rfind("{"), len(text)
    while at >= 0:
        part = text[at:end]
        inside = len(re.findall(r"""(?<!\\)(?:\\\\)*\"""", part)) % 2 == 1
        for piece in (part, text[at:]) if inside and end < len(text) else (part,):
            try:
                v, _ = d.raw_decode(piece)
                return json.dumps(v, ensure_ascii=False, sort_keys=True)
            except (ValueError, RecursionError):
                pass
        end, at = at, text.rfind("{", 0, at)
    return None


def matching_ratio(a: str | None, b: str | None) -> float | None:
    """Twice the matching characters over all characters (Ratcliff and Obershelp); null if either is."""
    import difflib

    return None if a is None or b is None else difflib.SequenceMatcher(None, a, b).ratio()


matching_ratio_udf = F.udf(matching_ratio, DoubleType(), useArrow=True)
first_object_udf = F.udf(first_object, StringType(), useArrow=True)
last_object_udf = F.udf(last_object, StringType(), useArrow=True)


def masked_labels(prompt: Column, answer: Column, longest: int = 4096, ignored: int = -100) -> Column:
    """struct<input_ids, labels>: prompt and answer ids, labels masked over the prompt; null if longer than `longest`."""
    ids = F.concat(prompt, answer)
    return F.when(F.size(ids) <= longest, F.struct(ids.alias("input_ids"), F.concat(F.array_repeat(F.lit(ignored), F.size(prompt)), answer).alias("labels")))
