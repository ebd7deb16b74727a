"""Text quality statistics, outlier scores from exact per-language ranks, and the kind of each text (problem 9).

Per document: the statistics of RANKED. Ranks are exact: rows (language, statistic, value, document) are range-partitioned and sorted,
counted within each part, and shifted by the offsets of the parts before; a value that many documents share is spread over as many
parts as it needs, and its counts in them are put together. Tail probabilities within the language add up to outlier scores (ECOD, Li
et al. 2022). The kind comes from boosted trees that see the tails and scores and nothing else, fitted on the hand labels at hand;
without usable labels, from the shares of line shapes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from string import ascii_letters, digits

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from procmill.llm.trees import Trees, fit
from procmill.session import materialize, ship, spread

KINDS = ("prose", "list", "table", "junk")
STATISTICS = ("word_count", "mean_word_length", "symbol_ratio", "punct_line_share", "common_word_share")
SHAPES = ("words_per_line", "short_lines", "list_share", "label_share", "table_share", "junk_share", "prose_share", "vowel_ratio", "other_ratio", "distinct_sentences", "distinct_words", "menu_ratio", "n_lines")
#: All of them are ranked, and decide.
RANKED = STATISTICS + SHAPES
#: Labelled documents that the trees are fitted on, at most; those with the least hash of their id if there are more.
MOST_LABELS = 20_000
#: Labelled documents from which the trees are fitted; with fewer (by halves of the sample: under 0.92 right with 44, 0.97 with 100) the
#: shares of line shapes decide (0.966).
LEAST_LABELS = 100

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+")
_ASCII_WORD = re.compile(r"[a-z]+(?:['-][a-z]+)*|[0-9]+")
_BEYOND = re.compile(r"[^\x00-\x7f]+")
_SENTENCE = re.compile(r"[.!?]+(?:\s|$)|\n+")
_BULLET = re.compile(r"(?:[-*•–—·▪‣◦>]|\[[ xX]?\]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{1,4}[.)])\s+\S")
_LABEL = re.compile(r"[^\W\d_][\w /&.'-]{0,30}:(?:\s|$)")
_LOG = re.compile(r"\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\[?\d\d:\d\d:\d\d|\b(?:INFO|WARN|ERROR|DEBUG)\b.*=")
_CODE = re.compile(r"""^(?:</?[\w:!?]|[{}\[\]]|"[\w ]+"\s*:)|[{;]$|->|^\s*(?:def|class|import|function|return|var|SELECT|process|task|xor|and)\b.*[{(;>]""")
_RULE = set("-=_*+|#~.: ")
_GAPS = re.compile(r"\S {2,}(?=\S)")
_COMMA = re.compile(r",(?=\S|$)")
_MENU = re.compile(r" [|>»·•/-] ")

#: Columns: letters, digits, blanks, plain punctuation, vowels; rows: ASCII codes.
_CLASSES = np.array([[chr(b) in x for x in (ascii_letters, digits, " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f", ".,;:!?'\"()-", "aeiouyAEIOUY")] for b in range(256)], np.int64)


def _line_kind(s: str) -> str:
    if len(s) >= 3 and not set(s) - _RULE:
        return "table" if "|" in s or "+" in s else "rule"
    if _LOG.match(s):
        return "log"
    if _BULLET.match(s) and not (s[0] == "-" and s.count(";") >= 2):
        return "list"
    pipes, tabs = s.count("|"), s.count("\t")
    if pipes >= 2 or tabs >= 1:
        return "table"
    n = len(s.split())
    if (c := s.count(";")) >= 2 and n <= 4 * (c + 1):
        return "table"
    if s.count(",") >= 2 and (c := len(_COMMA.findall(s))) >= 2 and n <= 4 * (c + 1):
        return "table"
    if "  " in s and len(_GAPS.findall(s)) >= 2:
        return "table"
    if _CODE.search(s):
        return "code"
    if n <= 14 and _LABEL.match(s):
        return "label"
    return "prose" if n > 9 or not (s[0].isupper()) else "short"


def statistics(text: str | None, common: frozenset[str]) -> list[float]:
    """RANKED of one text; a null, empty or blank text has zero everywhere.

    words: runs of letters (with inner apostrophes and hyphens) or digits; symbol ratio: characters that are neither letters,
    digits, white space nor . , ; : ! ? ' " ( ) -, of all that are not white space; punctuation ends a line by . ! ? : ; or an
    ellipsis, quotes and brackets after it ignored; common words: share of words in the language's list (any list's, if the
    language has none).
    """
    if not text or not text.strip():
        return [0.0] * len(RANKED)
    n = len(text)
    low = text.lower()
    data = text.encode("utf-8")
    plain_text = len(data) == n
    words = (_ASCII_WORD if plain_text else _WORD).findall(low)
    nw = len(words)
    letters, figures, blanks, plain, vowels = (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASSES).tolist()
    beyond = "" if plain_text else "".join(_BEYOND.findall(text))
    if beyond:
        letters += sum(map(str.isalpha, beyond))
        figures += sum(map(str.isdecimal, beyond))
        blanks += sum(map(str.isspace, beyond))
        vowels += sum(map(beyond.lower().count, "áéíóúãõâêôàäöü"))
    lines = [y for x in text.split("\n") if (y := x.strip())]
    nl = len(lines)
    dense = n - blanks or 1
    symbols = max(dense - letters - figures - plain, 0)
    ends = sum(1 for x in lines if (y := x.rstrip("\"')]}»”’*_")) and y[-1] in ".!?:;…")
    share: dict[str, int] = {}
    for x in lines:
        k = _line_kind(x)
        share[k] = share.get(k, 0) + len(x)
    whole = sum(share.values()) or 1
    of = lambda *ks: sum(share.get(k, 0) for k in ks) / whole
    sentences = [y for x in _SENTENCE.split(text) if (y := x.strip())]
    return [
        float(nw), sum(map(len, words)) / nw if nw else 0.0, symbols / dense, ends / nl, sum(map(common.__contains__, words)) / nw if nw else 0.0,
        nw / nl, of("short"), of("list"), of("label"), of("table"), of("code", "log", "rule"), of("prose"),
        vowels / max(letters, 1), sum(1 for c in beyond if c > "\u024f") / n, sum(map(len, set(sentences))) / max(sum(map(len, sentences)), 1), len(set(words)) / nw if nw else 0.0,
        len(_MENU.findall(text)) / max(nw, 1), float(nl),
    ]


def language(c: str = "lang"):
    """The language of a tag: lower case, without region; null and blank are 'und'."""
    x = F.regexp_extract(F.lower(F.trim(c)), "^[a-z]+", 0)
    return F.when(F.coalesce(x, F.lit("")) == "", "und").otherwise(x)


def _features(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[str, frozenset[str]] = shared.value
        every = frozenset().union(*lists.values())
        for b in batches:
            rows = [statistics(t, lists.get(g, every)) for g, t in zip(b["lang"].to_pylist(), b["text"].to_pylist())]
            x = np.array(rows, np.float64).reshape(len(rows), len(RANKED))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(RANKED), pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["lang"], values], ["doc_id", "lang", "x"])

    return run


def features(documents: DataFrame, common_words: DataFrame, most_words: int = 100_000) -> DataFrame:
    """(doc_id, lang, x: values of RANKED), lang without region. common_words: (lang, word), a parameter table of at most most_words rows."""
    spark = documents.sparkSession
    ship(spark)
    rows = common_words.where("word is not null").select(language().alias("lang"), F.lower("word").alias("word")).distinct().limit(most_words + 1).collect()
    if len(rows) > most_words:
        raise ValueError("common_words has more rows than most_words")
    lists: dict[str, set] = {}
    for r in rows:
        lists.setdefault(r["lang"], set()).add(r["word"])
    shared = spark.sparkContext.broadcast({k: frozenset(v) for k, v in lists.items()})
    return spread(documents.where("doc_id is not null").select("doc_id", language().alias("lang"), "text")).mapInArrow(_features(shared), "doc_id bigint, lang string, x array<double>")


# ---- exact ranks and outlier scores ----

_LOCAL = "lang string, stat int, value double, doc_id bigint, part int, upto bigint, n bigint, edge boolean"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over one part's rows sorted by (lang, stat, value): of each row the rows of its (lang, stat) up to its value, those with its
    value, both in this part, and whether its value is the first or last of the part (and so may go on in another)."""
    part, first = TaskContext.get().partitionId(), True
    held: list[pa.RecordBatch] = []  # rows of the value that is not yet ended
    key, before = None, 0

    def rows(b: pa.RecordBatch, keep_last: bool):
        nonlocal key, before, first
        lang, stat, value = b["lang"].to_numpy(zero_copy_only=False), b["stat"].to_numpy(), b["value"].to_numpy()
        same_key = (lang[1:] == lang[:-1]) & (stat[1:] == stat[:-1])
        same = same_key & ((value[1:] == value[:-1]) | np.isnan(value[1:]) & np.isnan(value[:-1]))
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        ends = np.append(starts[1:], len(value))
        if keep_last:
            held.append(b.slice(starts[-1]))
            starts, ends = starts[:-1], ends[:-1]
        if not len(starts):
            return None
        n, total = ends - starts, int(ends[-1])
        new = np.concatenate([[key != (lang[0], stat[0])], ~same_key[starts[1:] - 1]])
        run = np.cumsum(n) + before
        base = np.maximum.accumulate(np.where(new, run - n, 0))  # what was counted before the key began
        upto = run - np.where(np.logical_or.accumulate(new), base, 0)
        edge = np.zeros(len(n), bool)
        edge[0] = first
        edge[-1] |= not keep_last
        key, before, first = (lang[total - 1], stat[total - 1]), int(upto[-1]), False
        of = lambda x, t: pa.array(np.repeat(x, n), t)
        b = b.slice(0, total)
        return pa.RecordBatch.from_arrays([b["lang"], b["stat"], b["value"], b["doc_id"], pa.array(np.full(total, part, np.int32)), of(upto, pa.int64()), of(n, pa.int64()), of(edge, pa.bool_())], [c.split()[0] for c in _LOCAL.split(", ")])

    for b in batches:
        if b.num_rows:
            whole = pa.Table.from_batches([*held, b]).combine_chunks().to_batches()[0] if held else b
            held.clear()
            if (out := rows(whole, True)) is not None:
                yield out
    if held:
        yield rows(held[0], False)


def ranks(long: DataFrame, parts: int | None = None) -> DataFrame:
    """(lang, stat, value, doc_id, n, upto, total): of each row the rows with its value, those with at most it, and all, within (lang, stat).

    Exact at any size, in one shuffle: rows are range-partitioned by (lang, stat, value, doc_id), so a value that a third of the rows
    share is cut by doc_id. Offsets of the parts, and the counts of values at their edges, are tables of at most two rows a part and one
    for each language and statistic. NaN is the largest value. Repeated rows count as often as they stand.
    """
    spark = long.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["lang", "stat", "value", "doc_id"]
    local = materialize(long.select(*by).repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(_counted, _LOCAL), "ranks")
    w = W.partitionBy("lang", "stat")
    sums = local.groupBy("lang", "stat", "part").agg(F.max("upto").alias("s"))
    offsets = sums.select("lang", "stat", "part", (F.sum("s").over(w.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("s")).alias("before"), F.sum("s").over(w).alias("total"))
    v = W.partitionBy("lang", "stat", "value")
    edges = local.where("edge").groupBy("lang", "stat", "value", "part").agg(F.max("n").alias("e"))
    edges = edges.select("lang", "stat", "value", "part", F.sum("e").over(v).alias("all_n"), (F.sum("e").over(v.orderBy("part").rowsBetween(0, W.unboundedFollowing)) - F.col("e")).alias("later"), F.lit(True).alias("edge"))
    out = local.join(offsets, ["lang", "stat", "part"]).join(edges, ["lang", "stat", "value", "part", "edge"], "left")
    return out.select(*by, F.coalesce("all_n", "n").alias("n"), (F.col("upto") + F.col("before") + F.coalesce("later", F.lit(0))).alias("upto"), "total")


def tails(feats: DataFrame) -> DataFrame:
    """(doc_id, lang, stat, value, l, r, a): -log of the left and the right tail probability of each statistic within the language, and
    that on the side of its skew."""
    long = feats.select("doc_id", "lang", F.posexplode("x").alias("stat", "value"))
    r = ranks(long)
    left, right = -F.log(F.col("upto") / F.col("total")), -F.log((F.col("total") - F.col("upto") + F.col("n")) / F.col("total"))
    skew = feats.groupBy("lang").agg(F.array(*[F.coalesce(F.skewness(F.col("x")[i]), F.lit(0.0)) for i in range(len(RANKED))]).alias("skew"))
    r = r.join(skew, "lang").select("doc_id", "lang", "stat", "value", left.alias("l"), right.alias("r"), (F.get("skew", F.col("stat")) < 0).alias("_s"))
    return r.select("doc_id", "lang", "stat", "value", "l", "r", F.when(F.col("_s"), F.col("l")).otherwise(F.col("r")).alias("a"))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of tails sorted by document, to (doc ids, langs, values, tails, scores) of whole documents; of a repeated document one stands."""
    held: list[pa.RecordBatch] = []

    def cut(b: pa.RecordBatch) -> tuple:
        ids = b["doc_id"].to_numpy()
        docs, first, of = np.unique(ids, return_index=True, return_inverse=True)
        stat = b["stat"].to_numpy()
        put = np.zeros((4, len(docs), len(RANKED)))
        for k, c in enumerate(("value", "l", "r", "a")):
            put[k][of, stat] = b[c].to_numpy()
        value, l, r, a = put
        named = slice(0, len(STATISTICS))
        sums = [np.maximum.reduce([x[:, cols].sum(axis=1) for x in (l, r, a)]) for cols in (named, slice(None))]
        return docs, b["lang"].take(pa.array(first)), value, np.concatenate([l, r, np.stack(sums, axis=1)], axis=1), sums[0]

    for b in batches:
        if b.num_rows:
            whole = pa.Table.from_batches([*held, b]).combine_chunks().to_batches()[0]
            ids = whole["doc_id"].to_numpy()
            at = int(np.searchsorted(ids, ids[-1]))
            held = [whole.slice(at)]
            if at:
                yield cut(whole.slice(0, at))
    if held:
        yield cut(held[0])


def by_document(t: DataFrame) -> DataFrame:
    return t.repartition("doc_id").sortWithinPartitions("doc_id")


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for docs, lang, value, _, score in _whole(batches):
        yield pa.RecordBatch.from_arrays([pa.array(docs), lang, *[pa.array(value[:, i]) for i in range(len(STATISTICS))], pa.array(score)], ["doc_id", "lang", *STATISTICS, "score"])


def outlier_scores(feats: DataFrame) -> DataFrame:
    """(doc_id, lang, *STATISTICS, score), one row a document: the greatest of three sums over STATISTICS, of left tails, of right tails
    and of the tails on the side of the skew."""
    return by_document(tails(feats)).mapInArrow(_scores, "doc_id bigint, lang string, " + ", ".join(f"{c} double" for c in (*STATISTICS, "score")))


# ---- kinds ----

def by_shape(value: np.ndarray) -> np.ndarray:
    """The kind from the shares of line shapes alone, as positions in KINDS; used where there are no labels to learn from."""
    x = {c: value[:, i] for i, c in enumerate(RANKED)}
    lists, tables, junk = x["list_share"] + x["label_share"] + x["short_lines"], x["table_share"], x["junk_share"]
    junk = np.maximum(junk, np.where((x["word_count"] == 0) | (x["distinct_sentences"] < 0.3) | (x["other_ratio"] > 0.2) | (x["vowel_ratio"] < 0.2) | ((x["menu_ratio"] > 0.3) & (x["n_lines"] < 4)) | ((x["distinct_words"] < 0.15) & (x["word_count"] > 20)), 1.0, 0.0))
    shares = np.stack([x["prose_share"] + 1e-6, lists, tables, junk])
    return np.where(junk == 1.0, 3, np.argmax(shares, axis=0))


def learn(t: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> Trees | None:
    """Trees fitted on the tails and scores of at most `most` labelled documents; None if fewer than LEAST_LABELS or all of one kind. Unknown kinds
    are ignored.

    Of a document's labels the most frequent counts, ties go to the rater with the lowest name.
    """
    own = labels.where(F.col("kind").isin(*KINDS) & F.col("doc_id").isNotNull())
    votes = own.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.min("rater").alias("rater"))
    one = votes.groupBy("doc_id").agg(F.min_by("kind", F.struct(-F.col("n"), "rater", "kind")).alias("kind")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    kind = {r["doc_id"]: KINDS.index(r["kind"]) for r in one.collect()}
    rows = t.join(one.select("doc_id"), "doc_id", "left_semi").orderBy("doc_id").toArrow() if kind else None
    if rows is None or not rows.num_rows:
        return None
    got = [(docs, x) for docs, _, _, x, _ in _whole(iter(rows.combine_chunks().to_batches()))]
    docs, x = np.concatenate([d for d, _ in got]), np.concatenate([y for _, y in got])
    y = np.array([kind[int(d)] for d in docs])
    return fit(x, y, len(KINDS)) if len(y) >= LEAST_LABELS and len(set(y.tolist())) > 1 else None


def _classify(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: Trees | None = shared.value
        for docs, _, value, x, score in _whole(batches):
            got = trees.classes(x) if trees else by_shape(value)
            got = np.where(value[:, RANKED.index("n_lines")] == 0, KINDS.index("junk"), got)  # null and blank
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array([KINDS[i] for i in got], pa.string()), pa.array(score)], ["doc_id", "kind", "score"])

    return run


def kinds(documents: DataFrame, common_words: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """(doc_id, kind, score) of every document, once each. Null, empty and blank texts are junk; rows without a doc_id are left out; an
    empty table gives no rows."""
    t = materialize(tails(materialize(features(documents, common_words), "features")), "tails")
    shared = documents.sparkSession.sparkContext.broadcast(learn(t, labels, most))
    return by_document(t).mapInArrow(_classify(shared), "doc_id bigint, kind string, score double")


def found(documents: DataFrame, common_words: DataFrame, labels: DataFrame) -> DataFrame:
    return kinds(documents, common_words, labels).where("kind <> 'prose'").select("doc_id", "kind")


def outliers(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """The named statistics and the outlier score of every document."""
    return outlier_scores(materialize(features(documents, common_words), "features"))
