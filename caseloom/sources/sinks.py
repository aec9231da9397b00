"""Writers of the pipeline's files, and the lines they write.

Files are partitioned and ordered by ranges, so they read in order one after the other; ``single`` makes one file, for results that fit one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from caseloom.functions.text import LINE_BREAK, corpus_text, stripped

SUBMISSION = "^[!-~]+ [!-~]+ [!-~]+$"


@F.pandas_udf(StringType())
def number_text(values: pd.Series) -> pd.Series:
    """The shortest text that reads back as the same double, as Python writes it: 0.0001, 1e-05, 12.0; null stays null."""
    return pd.Series([None if v is None or v is pd.NA else repr(float(v)) for v in values.astype(object).where(values.notna(), None)], dtype=object)


def run_lines(run: DataFrame, tag: str) -> DataFrame:
    """(value): "query Q0 candidate rank score tag"."""
    score = number_text(F.col("score").cast("double"))
    return run.select(F.concat_ws(" ", "query_id", F.lit("Q0"), "candidate_id", F.col("rank").cast("string"), score, F.lit(tag)).alias("value"))


def submission_lines(run: DataFrame, tag: str) -> DataFrame:
    """(value): "query candidate tag"."""
    return run.select(F.concat_ws(" ", "query_id", "candidate_id", F.lit(tag)).alias("value"))


def bad_submission_lines(lines: DataFrame) -> DataFrame:
    """One row: lines, and those that aren't three ASCII columns with one space between them."""
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.coalesce(~F.col("value").rlike(SUBMISSION), F.lit(True))).alias("bad"))


def _in_order(df: DataFrame, single: bool, *order: str) -> DataFrame:
    return (df.coalesce(1) if single else df.repartitionByRange(*order)).sortWithinPartitions(*order)


def write_run(run: DataFrame, path: str, tag: str, single: bool = False) -> None:
    placed = _in_order(run, single, "query_id", "rank")
    run_lines(placed, tag).write.mode("overwrite").text(path)


def write_submission(run: DataFrame, path: str, tag: str, queries: DataFrame | None = None, rank: str = "rank", single: bool = False) -> None:
    """In the order of ``queries`` (query_id, pos) and rank, or by query."""
    placed = run.join(queries.select("query_id", F.col("pos").alias("_pos")), "query_id") if queries is not None else run.withColumn("_pos", F.lit(0))
    placed = _in_order(placed, single, "_pos", "query_id", rank)
    submission_lines(placed, tag).write.mode("overwrite").text(path)


def write_vectors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def relation_json(relation: DataFrame, position: str = "pos") -> DataFrame:
    """(value): a line of JSON for each query, "query": [candidates in order]."""
    listed = relation.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(position, "candidate_id"))), lambda x: x["candidate_id"]).alias("candidates"))
    pair = F.to_json(F.create_map(F.col("query_id"), F.col("candidates")))
    return listed.select("query_id", F.substring(pair, F.lit(2), F.length(pair) - 2).alias("value"))


def write_relation(relation: DataFrame, path: str, single: bool = False, position: str = "pos") -> None:
    """Files of one JSON object each, {"query": [candidates], ...}, queries in order; ``read_relation`` reads the folder."""
    lines = _in_order(relation_json(relation, position), single, "query_id")
    _framed(lines.select("value"), "{", "}").write.mode("overwrite").text(path)


def _framed(lines: DataFrame, opening: str, closing: str) -> DataFrame:
    """(value): the lines of each partition that has any, with commas between and the brackets around them."""

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = opening
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([before + ",\n".join(batch.column(0).to_pylist())])], ["value"])
                before = ","
        if before == ",":
            yield pa.RecordBatch.from_arrays([pa.array([closing])], ["value"])

    return lines.mapInArrow(framed, "value string")


def write_candidates(run: DataFrame, path: str, rank: str = "rank") -> None:
    """Candidates of each query by rank, in the form of ``write_relation``."""
    write_relation(run, path, position=rank)


def candidates_by_rank(run: DataFrame, rank: str = "rank") -> DataFrame:
    """(query_id, candidates) ordered by rank."""
    return run.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(rank, "candidate_id"))), lambda x: x["candidate_id"]).alias("candidates"))


def write_features(df: DataFrame, path: str) -> None:
    """Parquet partitioned by split, if there is one."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy("split") if "split" in df.columns else writer).parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", "true").csv(path)


def write_corpus(texts: DataFrame, path: str) -> None:
    """JSON lines {"id", "contents"}; the lines of a text are joined without a separator."""
    texts.select(F.col("case_id").alias("id"), corpus_text(F.col("text")).alias("contents")).write.mode("overwrite").json(path)


def write_topics(queries: DataFrame, path: str) -> DataFrame:
    """query<TAB>text of queries that have a text; returns the ids of those that have none."""
    has = F.coalesce(stripped(F.col("text")) != "", F.lit(False))
    line = F.concat_ws("\t", "query_id", F.regexp_replace("text", rf"\t|{LINE_BREAK}", " "))
    queries.where(has).select(line.alias("value")).write.mode("overwrite").text(path)
    return queries.where(~has).select("query_id")


def append_result(df: DataFrame, path: str) -> None:
    """Adds rows (model_name, topk, trec_file, f1, precision, recall, notes) to the experiment log."""
    df.select("model_name", "topk", "trec_file", "f1", "precision", "recall", "notes").write.mode("append").parquet(path)


def year_log(features: DataFrame, position: str = "pos") -> DataFrame:
    """(case_id, year, source) of the first row of each case; of rows at one position the least (year, source)."""
    first = F.min(F.struct(position, "year", F.col("year_source").alias("source"))).alias("y")
    return features.groupBy("case_id").agg(first).select("case_id", "y.year", "y.source")


def write_samples(df: DataFrame, path: str) -> None:
    """Files of one JSON array each, one object for each row; Spark reads the folder with ``multiLine``."""
    _framed(df.select(F.to_json(F.struct("*")).alias("value")), "[", "]").write.mode("overwrite").text(path)


def rerank_lines(df: DataFrame) -> DataFrame:
    """(value): "query<TAB>passage<TAB>score"."""
    return df.select(F.concat_ws("\t", "qid", "pid", number_text(F.col("score").cast("double"))).alias("value"))


def entailment_lines(ranked: DataFrame) -> DataFrame:
    """(value): "case paragraph score rank"."""
    return ranked.select(F.concat_ws(" ", "query_id", "candidate_id", number_text(F.col("score").cast("double")), F.col("rank").cast("string")).alias("value"))
