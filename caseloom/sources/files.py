"""Readers of the pipeline's files: texts, id lists, runs, JSON relations, feature and prediction tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.functions import ids
from caseloom.functions.text import stripped
from caseloom.operators.ranking import ordered_distinct, positions_of, slice_by_ids, top_in_run_order
from caseloom.operators.sampling import sample_rows

NORMALIZERS = {"plain": ids.plain_id, "padded": ids.padded_id, "label": ids.label_id, "none": lambda c: c}
STRINGS = "array<string>"
_GROUP = T.StructType([T.StructField("qid", T.StringType()), T.StructField("query", T.StringType())])
_PASSAGE = T.StructType([T.StructField("pid", T.StringType()), T.StructField("passage", T.StringType())])
GROUPED = T.StructType([T.StructField("qry", _GROUP), T.StructField("pos", T.ArrayType(_PASSAGE)), T.StructField("neg", T.ArrayType(_PASSAGE))])
PAIR = T.StructType([T.StructField(c, T.StringType()) for c in ("qid", "pid", "qry", "psg")])
STATE = "global_step long, log_history array<map<string,string>>"


# --- texts -------------------------------------------------------------------------------------------------------


def read_texts(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """(case_id, text): one row for each file with the suffix; the id is the stem, the text is stripped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
    stem = F.regexp_replace(F.col("_metadata.file_name"), re.escape(suffix) + "$", "")
    texts = files.select(F.url_decode(F.replace(stem, F.lit("+"), F.lit("%2B"))).alias("case_id"), stripped(F.col("content").cast("string")).alias("text"))
    empty = [(name.removesuffix(suffix), "") for name in _empty_files(spark, path) if name.endswith(suffix)]
    return texts.union(spark.createDataFrame(empty, "case_id string, text string")) if empty else texts


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files without a byte, which Spark's readers pass over; only names reach the driver, as in any listing."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return [f.getPath().getName() for f in listed if f.isFile() and f.getLen() == 0]


def texts_of(texts: DataFrame, wanted: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, text) of the wanted ids: the id as it is, else zero-filled to six; "" where there is neither."""
    named = texts.select(F.col("case_id").alias("_id"), "text")
    exact = wanted.select(key).distinct().join(named, F.col(key) == F.col("_id"), "left").select(key, F.col("text").alias("_exact"))
    padded = exact.join(named, F.lpad(key, 6, "0") == F.col("_id"), "left")
    return padded.select(key, F.coalesce("_exact", F.when(F.length(key) < 6, F.col("text")), F.lit("")).alias("text"))


def missing_texts(texts: DataFrame, wanted: DataFrame, key: str = "case_id") -> DataFrame:
    found = texts.select(F.col("case_id").alias(key)).distinct()
    rest = wanted.select(key).distinct().join(found, key, "left_anti")
    return rest.join(found.withColumnRenamed(key, "_id"), (F.lpad(key, 6, "0") == F.col("_id")) & (F.length(key) < 6), "left_anti")


def read_paragraph_tree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Cases (query_id, text) and paragraphs (query_id, par_id, text) of a tree <case>/entailed_fragment.txt, <case>/paragraphs/<par>.txt."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path).select(F.col("_metadata.file_path").alias("p"), F.col("content").cast("string").alias("value"))
    heads = files.where(F.col("p").rlike("/entailed_fragment\\.txt$")).select(F.regexp_extract("p", r"([^/]+)/entailed_fragment\.txt$", 1).alias("query_id"), stripped(F.col("value")).alias("text"))
    pars = files.where(F.col("p").rlike("/paragraphs/[^/]+\\.txt$"))
    return heads, pars.select(F.regexp_extract("p", r"([^/]+)/paragraphs/[^/]+$", 1).alias("query_id"), F.regexp_extract("p", r"/([^/]+)\.txt$", 1).alias("par_id"), stripped(F.col("value")).alias("text"))


# --- lists and runs ----------------------------------------------------------------------------------------------


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) in file order. Line numbers grow with position; a file that is split keeps their order."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")


def read_ids(spark: SparkSession, path: str, whole_line: bool = False, distinct: bool = True, normalize: str = "padded", limit: int = -1) -> DataFrame:
    """(pos, query_id) of an id list: the first token of each line, or all of it; blank lines are skipped.

    ``distinct`` keeps first occurrences; a limit of 0 or more keeps the first so many lines.
    """
    lines = numbered_lines(spark, path).withColumn("_t", stripped(F.col("value"))).where("_t != ''")
    token = F.col("_t") if whole_line else F.element_at(F.split("_t", r"(?U)\s+"), 1)
    out = lines.select(F.col("line_no").alias("pos"), NORMALIZERS[normalize](token).alias("query_id"))
    out = ordered_distinct(out, "query_id", "pos") if distinct else out
    return out.orderBy("pos").limit(limit) if limit >= 0 else out


def read_run(spark: SparkSession, path: str, min_fields: int = 6, exact: bool = False) -> DataFrame:
    """(line_no, query_id, q0, candidate_id, rank, score, run_tag) of a run file; lines with fewer fields are skipped, with ``exact`` those with more too."""
    fields = F.size("f")
    lines = numbered_lines(spark, path).withColumn("f", F.split(stripped(F.col("value")), r"(?U)\s+")).where(fields == min_fields if exact else fields >= min_fields)
    f = lambda i: F.get("f", F.lit(i))
    return lines.select("line_no", f(0).alias("query_id"), f(1).alias("q0"), f(2).alias("candidate_id"), f(3).try_cast("int").alias("rank"), f(4).try_cast("double").alias("score"), f(5).alias("run_tag"))


def run_top_k(run: DataFrame, k: int, skip_self: bool = True, numeric: bool = True) -> DataFrame:
    """The first k lines of each query in file order, self skipped first; ids as numbers (N5) or as they are."""
    key = ids.numeric_id if numeric else (lambda c: c)
    rows = run.select("line_no", key(F.col("query_id")).alias("query_id"), key(F.col("candidate_id")).alias("candidate_id"), "score")
    return top_in_run_order(rows.where("query_id != candidate_id") if skip_self else rows, k)


def run_by_rank(run: DataFrame, k: int) -> DataFrame:
    """Rows whose own rank column is at most k, with run ids (N4); the run is read with ``exact``."""
    return run.where(F.col("rank") <= k).select(ids.run_id(F.col("query_id")).alias("query_id"), ids.run_id(F.col("candidate_id")).alias("candidate_id"), "rank", "score")


# --- JSON relations ----------------------------------------------------------------------------------------------


def read_relation(spark: SparkSession, path: str, normalize: str = "padded") -> DataFrame:
    """(query_id, candidate_id, pos) of a JSON object query -> candidates, first occurrences in order.

    The path may also be a folder of files of one such object each, as ``write_relation`` makes them. A file that holds no
    object is an error; values that are no lists count as empty; empty ids are dropped.
    """
    whole = spark.read.text(path, wholetext=True)
    bad = whole.where(~F.col("value").rlike(r"(?s)^\s*\{.*\}\s*$") | F.from_json("value", "map<string,string>").isNull()).limit(1).count()
    if bad:
        raise ValueError(f"{path}: JSON must be an object")
    pairs = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("q", "c"))
    each = pairs.select("q", F.posexplode(F.coalesce(F.from_json("c", STRINGS), F.array().cast(STRINGS))).alias("pos", "c"))
    norm = NORMALIZERS[normalize]
    out = each.select(norm(F.col("q")).alias("query_id"), norm(F.col("c")).alias("candidate_id"), "pos").where("query_id != '' and candidate_id != ''")
    return out.groupBy("query_id", "candidate_id").agg(F.min("pos").alias("pos"))


def relation_queries(spark: SparkSession, path: str, normalize: str = "plain") -> DataFrame:
    """(pos, query_id): the keys of a JSON object in order."""
    keys = spark.read.text(path, wholetext=True).select(F.posexplode(F.map_keys(F.from_json("value", "map<string,string>"))).alias("pos", "q"))
    return ordered_distinct(keys.select("pos", NORMALIZERS[normalize](F.col("q")).alias("query_id")), "query_id", "pos")


def labels_of(labels: DataFrame, queries: DataFrame, numeric: bool = True) -> DataFrame:
    """Distinct labels of the given queries, ids as numbers (N5) or as they are."""
    key = ids.numeric_id if numeric else (lambda c: c)
    wanted = queries.select(key(F.col("query_id")).alias("query_id")).distinct()
    return labels.select(key(F.col("query_id")).alias("query_id"), key(F.col("candidate_id")).alias("candidate_id")).distinct().join(wanted, "query_id", "left_semi")


def read_grouped(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GROUPED).json(path, multiLine=True)


def read_prediction_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIR).json(path, multiLine=True)


def read_prompts(spark: SparkSession, path: str, prompt: str = "prompt", answer: str = "label", n: int = -1, seed: int = 42) -> DataFrame:
    """(text) of JSON lines: prompt and answer joined; of all, or of n rows in seeded order."""
    texts = spark.read.json(path).select(F.concat(F.col(prompt), F.col(answer)).alias("text"))
    return texts if n < 0 else sample_rows(texts, n, seed, "text")


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """(path, global_step, log_history) of <path>/checkpoint-*/trainer_state.json; unreadable files have nulls and are left out."""
    files = spark.read.text(f"{path}/checkpoint-*/trainer_state.json", wholetext=True)
    parsed = files.select(F.regexp_replace("_metadata.file_path", "/trainer_state\\.json$", "").alias("path"), F.from_json("value", STATE).alias("s"))
    return parsed.select("path", "s.*").where("global_step is not null and log_history is not null")


# --- tables ------------------------------------------------------------------------------------------------------


def feature_type(name: str) -> T.DataType:
    """Type of a feature column by its name."""
    if name in ("query_id", "candidate_id"):
        return T.StringType()
    if name == "label":
        return T.ByteType()
    return T.IntegerType() if name == "year_diff" or name.endswith(("_rank", "_length", "_num", "_year")) else T.FloatType()


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A feature CSV; only its header is read to find the columns."""
    names = spark.read.option("header", "true").csv(path).columns
    schema = T.StructType([T.StructField(n, feature_type(n)) for n in names])
    return spark.read.schema(schema).option("header", "true").csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, candidate_id, label, rank_score, rank_position): scores ranked anew; a null label is 0."""
    names = spark.read.option("header", "true").csv(path).columns
    if lost := {"query_id", "candidate_id", "pred_score"} - set(names):
        raise ValueError(f"{path} lacks {sorted(lost)}")
    types = {"label": T.ByteType(), "pred_score": T.FloatType(), "pred_rank": T.IntegerType()}
    rows = spark.read.schema(T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])).option("header", "true").csv(path)
    label = F.coalesce("label", F.lit(0)).cast("tinyint") if "label" in names else F.lit(0).cast("tinyint")
    out = rows.select(ids.padded_id(F.col("query_id")).alias("query_id"), ids.padded_id(F.col("candidate_id")).alias("candidate_id"), label.alias("label"), F.col("pred_score").alias("rank_score"))
    return out.withColumn("rank_position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rank_score"), "candidate_id")))


def read_vectors(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(case_id, pos, embedding) from Parquet; with wanted (case_id, pos) those in its order, and the ids that are missing."""
    rows = spark.read.parquet(path)
    return (rows, None) if wanted is None else slice_by_ids(rows, wanted, "case_id")


def split_corpus(df: DataFrame, test_share: float = 0.001, seed: int = 42, shuffle: bool = False) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the text; the text column is required. With ``shuffle`` both have a column pos, their place in seeded order."""
    if "text" not in df.columns:
        raise ValueError("the corpus needs a text column")
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce("text", F.lit("")))), 1, 8), 16, 10).cast("long")
    test = number < int(test_share * (1 << 32))
    parts = df.where(~test), df.where(test)
    order = [F.md5(F.concat_ws("|", F.lit(f"{seed}:order"), "text")), F.col("text")]
    return tuple(positions_of(p, order) for p in parts) if shuffle else parts
