"""Text, JSON lines, markdown and model files as DataFrames, and tables as files. Every reader is lazy and gives rows for bad files
instead of failing on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from procmill.functions import text as X
from procmill.operators.statistics import quantiles

NAME = r"([^/]+)$"


def whole_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, stem, text): one row per file; stem is the name without its extensions."""
    df = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    name = F.regexp_extract(F.url_decode("path"), NAME, 1)
    return df.select("path", name.alias("name"), F.substring_index(name, ".", 1).alias("stem"), "text")


def numbered_texts(spark: SparkSession, path: str, bands: Sequence[tuple[int, int, str]], source: str = "numbered") -> DataFrame:
    """Files NN.txt with an optional 'Title:' line: (id, source, title, raw_text, number, origin). Lines join by one blank; origin is
    that of the band (first, last, origin) that holds the number, null outside all."""
    f = whole_files(spark, path, "*.txt").where(F.col("stem").rlike(r"^\d+$"))
    number = F.col("stem").cast("int")
    origin: Column = F.lit(None).cast("string")
    for lo, hi, name in reversed(list(bands)):
        origin = F.when(number.between(lo, hi), name).otherwise(origin)
    body = F.regexp_replace("text", r"(?m)\A\s*Title:[^\n]*\n?", "")
    lines = F.filter(F.transform(F.split(body, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    title = F.trim(F.regexp_extract("text", r"\A\s*Title:([^\n]*)", 1))
    return f.select(F.format_string(f"{source}_%08d", number).alias("id"), F.lit(source).alias("source"), F.nullif(title, F.lit("")).alias("title"), F.array_join(lines, " ").alias("raw_text"), number.alias("number"), origin.alias("origin"))


def headed_texts(spark: SparkSession, path: str, source: str = "headed") -> DataFrame:
    """Text files that begin with 'Category:' and 'Title:' lines, in any order: (stem, source, category, title, raw_text)."""
    f = whole_files(spark, path, "*.txt")
    head = r"\A(?:\s*(?:Category|Title):[^\n]*\n)*"
    field = lambda k: F.nullif(F.trim(F.regexp_extract(F.regexp_extract("text", f"({head})", 1), rf"(?m)^\s*{k}:([^\n]*)", 1)), F.lit(""))
    return f.select("stem", F.lit(source).alias("source"), field("Category").alias("category"), field("Title").alias("title"), F.trim(F.regexp_replace("text", head, "")).alias("raw_text"))


def token_rows(spark: SparkSession, path: str, tokens: str = "tokens") -> DataFrame:
    """Parquet rows with an array of tokens, as prose: all columns but the tokens, and raw_text."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in df.columns if c != tokens], X.joined_tokens(F.col(tokens)).alias("raw_text"))


def scored_models(spark: SparkSession, path: str, least: float = 4.0) -> DataFrame:
    """Model files *.bpmn2.xml with the score beside them (<stem>.quality.txt): (stem, gold_xml, score), scores of at least `least`.
    Files without a score, or with one that is no number, are left out."""
    xml = whole_files(spark, path, "*.bpmn2.xml").select("stem", F.col("text").alias("gold_xml"))
    score = whole_files(spark, path, "*.quality.txt").select("stem", F.expr("try_cast(trim(text) as double)").alias("score"))
    return xml.join(score, "stem").where(F.col("score") >= least)


def models_by_number(samples: DataFrame, files: DataFrame, number_path: str = "$.process_number") -> DataFrame:
    """samples left joined to whole_files by the number in their metadata: (id, number, gold_xml, problem), problem where none is found."""
    n = samples.select("id", F.get_json_object("metadata", number_path).cast("int").alias("number"))
    f = files.where(F.col("stem").rlike(r"\d+")).select(F.regexp_extract("stem", r"(\d+)", 1).cast("int").alias("number"), F.col("text").alias("gold_xml"))
    return n.join(f, "number", "left").select("id", "number", "gold_xml", F.when(F.col("number").isNull(), "no number").when(F.col("gold_xml").isNull(), "no file").alias("problem"))


def json_lines(spark: SparkSession, path: str, known: Sequence[str], text_field: str = "text") -> DataFrame:
    """JSON lines: known keys as string columns (text_field as raw_text), all others as one JSON object in metadata. Bad lines give nulls."""
    m = F.from_json("value", "map<string,string>")
    keys = [k for k in known if k != text_field]
    rest = F.map_filter("m", lambda k, v: ~k.isin(*keys, text_field))
    df = spark.read.text(path).where(F.trim("value") != "").select(m.alias("m"))
    return df.select(*[F.col("m")[k].alias(k) for k in keys], F.col("m")[text_field].alias("raw_text"), F.when(F.size(rest) > 0, F.to_json(rest)).alias("metadata"))


def markdown_pages(spark: SparkSession, root: str, listing: str, least_score: int = 40) -> DataFrame:
    """Pages that a JSON list of {path, score} admits: (path, title, text), cleaned, title from the front matter."""
    wanted = spark.read.option("multiLine", True).json(listing).where(F.col("score") >= least_score).select(F.regexp_extract("path", NAME, 1).alias("name"), F.col("path").alias("listed"), "score")
    pages = whole_files(spark, root, "*.md")
    return pages.join(wanted, "name").where(F.col("path").endswith(F.col("listed"))).select("listed", "score", X.frontmatter_title(F.col("text")).alias("title"), X.clean_markdown(F.col("text")).alias("text"))


def training_log(spark: SparkSession, path: str, count_pattern: str = r"(?:examples used|exemplos usados)\s+(\d+)") -> DataFrame:
    """(name, n_examples, least_loss) of each log file: the first count it states and the least eval_loss."""
    losses = F.regexp_extract_all("text", F.lit(r"eval_loss['\"]?[:=]\s*([0-9.]+(?:e-?\d+)?)"), F.lit(1))
    return whole_files(spark, path).select("name", F.nullif(F.regexp_extract("text", f"(?i){count_pattern}", 1), F.lit("")).cast("int").alias("n_examples"), F.array_min(F.transform(losses, lambda x: x.cast("double"))).alias("least_loss"))


def trainer_state(spark: SparkSession, path: str) -> DataFrame:
    """(series, step, epoch, loss) from a trainer state file's log_history: series train or eval."""
    h = spark.read.option("multiLine", True).schema("log_history array<struct<step:int,epoch:double,loss:double,eval_loss:double>>").json(path).select(F.explode("log_history").alias("h")).select("h.*")
    train = h.where("loss is not null").select(F.lit("train").alias("series"), "step", "epoch", "loss")
    return train.union(h.where("eval_loss is not null").select(F.lit("eval"), "step", "epoch", "eval_loss"))


def prompt(spark: SparkSession, path: str) -> DataFrame:
    """(name, text, sha256) of prompt files: the digest says which text produced a row."""
    return whole_files(spark, path).select("name", "text", F.sha2("text", 256).alias("sha256"))


# ---- views and sinks ----

def stage_view(df: DataFrame, source: str, stage: str) -> str:
    """A temporary view <source>__<stage> of a samples table; names that are no plain identifiers are refused."""
    for x in (source, stage):
        if not x.isidentifier():
            raise ValueError(f"{x!r} is no identifier")
    df.where((F.col("source") == source) & (F.col("stage") == stage)).createOrReplaceTempView(f"{source}__{stage}")
    return f"{source}__{stage}"


def stage_views(spark: SparkSession) -> list[str]:
    """The names of the temporary views that stage_view has made, in order."""
    return sorted(t.name for t in spark.catalog.listTables() if t.isTemporary and "__" in t.name)


def append(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Appends history rows; by: version columns that become folders, so slices can be read and replaced alone."""
    df.write.mode("append").partitionBy(*by).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Overwrites the folders that df has rows for and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, series: str | None = None) -> None:
    """CSV with a header; with series, a folder for each of its values."""
    w = df.write.mode("overwrite").option("header", True)
    (w.partitionBy(series) if series else w).csv(path)


def manifest(df: DataFrame, label: str, held_out: DataFrame, key: str, text: str | None = None) -> DataFrame:
    """One row of JSON: rows and keys of an export, and of its texts the lengths at the quartiles and the greatest. Fails when a held-out
    key is in it."""
    leaked = df.join(held_out.select(key), key, "left_semi").agg(F.count("*").alias("n_leaked"))
    said = df.agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"))
    one = said.join(F.broadcast(leaked))  # one row each
    more = []
    if text:
        q = quantiles(df.select(F.length(text).alias("n_chars")), [], "n_chars", [0.25, 0.5, 0.75, 1.0])
        one, more = one.join(F.broadcast(q)), [F.struct("q25", "q50", "q75", F.col("q100").alias("max")).alias("n_chars")]
    return one.select(F.when(F.col("n_leaked") > 0, F.raise_error(F.concat(F.lit("held-out rows in the export: "), F.col("n_leaked").cast("string")))).otherwise(F.to_json(F.struct(F.lit(label).alias("label"), "n_rows", "n_keys", *more))).alias("manifest"))
