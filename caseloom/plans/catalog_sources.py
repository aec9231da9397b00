"""Queries of readers and writers: tables are written to the shared folder in a file's own form and read back.

Files that stand for lists with an order are one file; all others are as many as Spark makes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import ids
from caseloom.operators import ranking, sampling, statistics
from caseloom.plans.catalog import _WS, _n1, _n2, _pad, _run, _strip, cases, predictions, qrels, query, vectors
from caseloom.plans.tables import new_path, table
from caseloom.sources import config, files, sinks

_RAW_IDS = "SELECT row_number() OVER (ORDER BY query_id, candidate_id NULLS FIRST) AS line, query_id AS q FROM case_labels WHERE query_id IS NOT NULL"
_TOKEN = f"regexp_replace({_strip('q')}, '{_WS}.*$', '', 's')"


def _write_texts(texts: DataFrame, path: str, suffix: str = ".txt") -> str:
    """One file for each (name, text); names may have folders."""

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, text in zip(part["name"], part["text"]):
                system, target = fs.FileSystem.from_uri(f"{path}/{name}{suffix}")
                system.create_dir(target.rsplit("/", 1)[0])
                with system.open_output_stream(target) as out:
                    out.write(text.encode("utf-8", "surrogatepass"))
            yield part[["name"]]

    texts.select("name", "text").mapInPandas(write, "name string").count()
    return path


def _one_file(lines: DataFrame, path: str, *order: str) -> str:
    lines.coalesce(1).sortWithinPartitions(*order).select("value").write.text(path)
    return path


def _placed(df: DataFrame, position: str = "pos") -> DataFrame:
    return ranking.positions_of(df, [F.col(position)], "place").drop(position)


# --- texts -------------------------------------------------------------------------------------------------------


@query(f"SELECT case_id, {_strip('raw_text')} AS text FROM cases WHERE raw_text IS NOT NULL", "cases")
def src_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = cases(spark, d, "raw_text").where("raw_text is not null").select(F.col("case_id").alias("name"), F.col("raw_text").alias("text"))
    return files.read_texts(spark, _write_texts(rows, new_path(spark, "texts")))


def _short_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of labelled queries as they may be written: without leading zeros, and one that no case has."""
    return qrels(spark, d).select(F.regexp_replace("query_id", "^0+", "").alias("case_id")).union(spark.createDataFrame([("no such case",)], "case_id string"))


_SHORT = "(SELECT DISTINCT regexp_replace(query_id, '^0+', '') AS case_id FROM qrels UNION SELECT 'no such case')"


@query(
    f"""SELECT s.case_id, coalesce(a.raw_text, CASE WHEN length(s.case_id) < 6 THEN b.raw_text END, '') AS text FROM {_SHORT} s
    LEFT JOIN cases a ON a.case_id = s.case_id LEFT JOIN cases b ON b.case_id = {_pad('s.case_id')}""",
    "cases", "qrels",
)
def texts_of_ids(spark: SparkSession, d: str) -> DataFrame:
    return files.texts_of(cases(spark, d, "raw_text").select("case_id", F.col("raw_text").alias("text")), _short_ids(spark, d))


@query(f"SELECT s.case_id FROM {_SHORT} s WHERE s.case_id NOT IN (SELECT case_id FROM cases) AND (length(s.case_id) >= 6 OR {_pad('s.case_id')} NOT IN (SELECT case_id FROM cases))", "cases", "qrels")
def missing_texts(spark: SparkSession, d: str) -> DataFrame:
    return files.missing_texts(cases(spark, d, "raw_text"), _short_ids(spark, d))


@query("SELECT 'head' AS part, right('000' || n_nationkey, 3) AS query_id, NULL::VARCHAR AS par_id, n_name AS text FROM nation UNION ALL SELECT 'paragraph', right('000' || s_nationkey, 3), s_suppkey::VARCHAR, s_name FROM supplier")
def src_paragraph_tree(spark: SparkSession, d: str) -> DataFrame:
    """Nations stand for cases, their suppliers for paragraphs."""
    folder = lambda c: F.lpad(F.col(c).cast("string"), 3, "0")
    heads = table(spark, d, "nation").select(F.concat(folder("n_nationkey"), F.lit("/entailed_fragment")).alias("name"), F.col("n_name").alias("text"))
    pars = table(spark, d, "supplier").select(F.concat(folder("s_nationkey"), F.lit("/paragraphs/"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_name").alias("text"))
    a, b = files.read_paragraph_tree(spark, _write_texts(heads.union(pars), new_path(spark, "tree")))
    return a.select(F.lit("head").alias("part"), "query_id", F.lit(None).cast("string").alias("par_id"), "text").union(b.select(F.lit("paragraph"), "query_id", "par_id", "text"))


# --- id lists ----------------------------------------------------------------------------------------------------


def _id_file(spark: SparkSession, d: str) -> str:
    rows = table(spark, d, "case_labels").where("query_id is not null").select(F.col("query_id").alias("value"), "candidate_id")
    return _one_file(rows, new_path(spark, "ids"), "value", "candidate_id")


def _numbered(body: str, order: str = "line") -> str:
    return f"SELECT query_id, row_number() OVER (ORDER BY {order}) - 1 AS place FROM ({body})"


@query(_numbered(f"SELECT {_n2(_TOKEN)} AS query_id, min(line) AS line FROM ({_RAW_IDS}) WHERE {_strip('q')} <> '' GROUP BY 1"))
def ids_first_token(spark: SparkSession, d: str) -> DataFrame:
    return _placed(files.read_ids(spark, _id_file(spark, d)))


@query(_numbered(f"SELECT {_n1('q')} AS query_id, min(line) AS line FROM ({_RAW_IDS}) WHERE {_n1('q')} <> '' GROUP BY 1"))
def ids_whole_line(spark: SparkSession, d: str) -> DataFrame:
    return _placed(files.read_ids(spark, _id_file(spark, d), whole_line=True, normalize="plain"))


@query(_numbered(f"SELECT {_TOKEN} AS query_id, line FROM ({_RAW_IDS}) WHERE {_strip('q')} <> ''"))
def ids_repeated(spark: SparkSession, d: str) -> DataFrame:
    return _placed(files.read_ids(spark, _id_file(spark, d), distinct=False, normalize="none"))


@query(_numbered(f"SELECT {_n2(_TOKEN)} AS query_id, min(line) AS line FROM ({_RAW_IDS}) WHERE {_strip('q')} <> '' GROUP BY 1 ORDER BY 2 LIMIT 10"))
def ids_first_ten(spark: SparkSession, d: str) -> DataFrame:
    """The debugging limit of a list: its first ten ids."""
    return _placed(files.read_ids(spark, _id_file(spark, d), limit=10))


# --- relations ---------------------------------------------------------------------------------------------------

_RELATION = "SELECT query_id AS q, candidate_id AS c, row_number() OVER (PARTITION BY query_id ORDER BY candidate_id) - 1 AS p FROM case_labels WHERE query_id IS NOT NULL AND candidate_id IS NOT NULL"


def _relation_file(spark: SparkSession, d: str, single: bool = False) -> str:
    rows = table(spark, d, "case_labels").where("query_id is not null and candidate_id is not null").select("query_id", "candidate_id", F.lit(0).alias("pos"))
    sinks.write_relation(rows, path := new_path(spark, "relation"), single)
    return path


def _relation_sql(norm) -> str:
    return f"SELECT {norm('q')} AS query_id, {norm('c')} AS candidate_id, min(p)::INT AS pos FROM ({_RELATION}) WHERE {norm('q')} <> '' AND {norm('c')} <> '' GROUP BY 1, 2"


@query(_relation_sql(_n2))
def relation_padded(spark: SparkSession, d: str) -> DataFrame:
    return files.read_relation(spark, _relation_file(spark, d))


@query(_relation_sql(lambda x: f"replace({x}, '.txt', '')"))
def relation_label_ids(spark: SparkSession, d: str) -> DataFrame:
    return files.read_relation(spark, _relation_file(spark, d), "label")


@query(_numbered(f"SELECT {_n1('q')} AS query_id, min(q) AS line FROM ({_RELATION}) WHERE {_n1('q')} <> '' GROUP BY 1"))
def relation_keys(spark: SparkSession, d: str) -> DataFrame:
    return _placed(files.relation_queries(spark, _relation_file(spark, d, single=True)))


@query("SELECT DISTINCT try_cast(query_id AS BIGINT) AS query_id, try_cast(candidate_id AS BIGINT) AS candidate_id FROM qrels SEMI JOIN pred USING (query_id) WHERE try_cast(query_id AS BIGINT) IS NOT NULL", "qrels", "pred")
def labels_of_queries(spark: SparkSession, d: str) -> DataFrame:
    return files.labels_of(qrels(spark, d), predictions(spark, d))


@query("SELECT query_id, list(candidate_id ORDER BY rk) AS candidates FROM pred GROUP BY 1", "pred")
def candidates_json(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by rank, written as one relation and read again."""
    sinks.write_candidates(_run(spark, d), path := new_path(spark, "candidates"))
    return sinks.candidates_by_rank(files.read_relation(spark, path, "none"), "pos")


@query("SELECT query_id, list(candidate_id ORDER BY rk) AS candidates FROM pred GROUP BY 1", "pred")
def candidates_by_rank(spark: SparkSession, d: str) -> DataFrame:
    return sinks.candidates_by_rank(_run(spark, d))


# --- runs --------------------------------------------------------------------------------------------------------


def _run_file(spark: SparkSession, d: str) -> str:
    sinks.write_run(_run(spark, d).withColumn("score", F.col("rank_score")), path := new_path(spark, "run"), "tag", single=True)
    return path


@query("SELECT query_id || ' Q0 ' || candidate_id || ' ' || rk || ' ' || rank_score::DOUBLE || ' tag' AS value FROM pred", "pred")
def run_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.run_lines(_run(spark, d).withColumn("score", F.col("rank_score")), "tag")


@query("SELECT query_id, 'Q0' AS q0, candidate_id, rk::INT AS rank, rank_score::DOUBLE AS score, 'tag' AS run_tag FROM pred", "pred")
def src_run(spark: SparkSession, d: str) -> DataFrame:
    return files.read_run(spark, _run_file(spark, d), exact=True).drop("line_no")


_IN_ORDER = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rk) AS place FROM (SELECT {0} AS query_id, {1} AS candidate_id, rk FROM pred) WHERE query_id <> candidate_id"


@query(f"SELECT query_id, candidate_id FROM ({_IN_ORDER.format('query_id', 'candidate_id')}) WHERE place <= 5", "pred")
def run_top5(spark: SparkSession, d: str) -> DataFrame:
    return files.run_top_k(files.read_run(spark, _run_file(spark, d)), 5, numeric=False).select("query_id", "candidate_id")


@query(f"SELECT query_id, candidate_id FROM ({_IN_ORDER.format('try_cast(query_id AS BIGINT)', 'try_cast(candidate_id AS BIGINT)')}) WHERE place <= 5", "pred")
def run_top5_numbers(spark: SparkSession, d: str) -> DataFrame:
    return files.run_top_k(files.read_run(spark, _run_file(spark, d)), 5).select("query_id", "candidate_id")


@query(f"SELECT {_pad('query_id')} AS query_id, {_pad('candidate_id')} AS candidate_id, rk::INT AS rank FROM pred WHERE rk <= 10", "pred")
def run_first_ranks(spark: SparkSession, d: str) -> DataFrame:
    return files.run_by_rank(files.read_run(spark, _run_file(spark, d), exact=True), 10).select("query_id", "candidate_id", "rank")


@query("SELECT query_id || ' ' || candidate_id || ' tag' AS value FROM pred WHERE rk <= 5", "pred")
def submission(spark: SparkSession, d: str) -> DataFrame:
    sinks.write_submission(_run(spark, d).where("rank <= 5"), path := new_path(spark, "submission"), "tag")
    return spark.read.text(path)


@query("SELECT count(*) AS lines, count(*) FILTER (NOT regexp_full_match(v, '[!-~]+ [!-~]+ [!-~]+')) AS bad FROM (SELECT coalesce(court, '') || ' ' || case_id || ' tag' AS v FROM cases)", "cases")
def submission_check(spark: SparkSession, d: str) -> DataFrame:
    """Lines that begin with a court's name as it is spelled: blanks and other scripts make them bad."""
    lines = cases(spark, d, "court").select(F.concat(F.coalesce("court", F.lit("")), F.lit(" "), "case_id", F.lit(" tag")).alias("value"))
    return sinks.bad_submission_lines(lines)


@query("SELECT query_id || chr(9) || candidate_id || chr(9) || rank_score::DOUBLE AS value FROM pred", "pred")
def rerank_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.rerank_lines(_run(spark, d).select(F.col("query_id").alias("qid"), F.col("candidate_id").alias("pid"), F.col("rank_score").alias("score")))


@query("SELECT query_id || ' ' || candidate_id || ' ' || rank_score::DOUBLE || ' ' || rk AS value FROM pred", "pred")
def entailment_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.entailment_lines(_run(spark, d).withColumn("score", F.col("rank_score")))


# --- tables ------------------------------------------------------------------------------------------------------


@query("SELECT case_id, pos FROM (SELECT DISTINCT candidate_id AS case_id, 7 AS pos FROM qrels) SEMI JOIN case_vectors USING (case_id)", "qrels")
def src_vectors(spark: SparkSession, d: str) -> DataFrame:
    sinks.write_vectors(table(spark, d, "case_vectors").distinct(), path := new_path(spark, "vectors"))
    wanted = qrels(spark, d).select(F.col("candidate_id").alias("case_id"), F.lit(7).alias("pos")).distinct()
    return files.read_vectors(spark, path, wanted)[0].select("case_id", "pos")


@query("SELECT case_id FROM (SELECT DISTINCT candidate_id AS case_id FROM qrels) ANTI JOIN case_vectors USING (case_id)", "qrels")
def src_vectors_missing(spark: SparkSession, d: str) -> DataFrame:
    wanted = qrels(spark, d).select(F.col("candidate_id").alias("case_id"), F.lit(7).alias("pos")).distinct()
    return ranking.slice_by_ids(table(spark, d, "case_vectors"), wanted, "case_id")[1].select("case_id")


_CSV = ("query_id", "candidate_id", "bm25_score", "bm25_rank", "query_length", "len_diff", "query_citation_num", "doc_year", "year_diff", "label")


@query("SELECT " + ", ".join(_CSV) + " FROM ltr_features")
def src_features(spark: SparkSession, d: str) -> DataFrame:
    sinks.write_table(table(spark, d, "ltr_features").select(*_CSV), path := new_path(spark, "features"))
    return files.read_features(spark, path)


@query(
    f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, candidate_id)::INT AS rank_position
    FROM (SELECT {_n2('query_id')} AS query_id, {_n2('candidate_id')} AS candidate_id, coalesce(label, 0)::TINYINT AS label, rank_score FROM pred)""",
    "pred",
)
def src_predictions(spark: SparkSession, d: str) -> DataFrame:
    sinks.write_table(predictions(spark, d).select("query_id", "candidate_id", F.col("rank_score").alias("pred_score"), "label"), path := new_path(spark, "predictions"))
    return files.read_predictions(spark, path)


@query("SELECT query_id, candidate_id, label, 'valid' AS split FROM pred WHERE label IS NOT NULL UNION ALL SELECT query_id, candidate_id, label, 'test' FROM pred WHERE label IS NULL", "pred")
def feature_file(spark: SparkSession, d: str) -> DataFrame:
    rows = predictions(spark, d).select("query_id", "candidate_id", "label", F.when(F.col("label").isNull(), "test").otherwise("valid").alias("split"))
    sinks.write_features(rows, path := new_path(spark, "frame"))
    return spark.read.parquet(path)


@query(r"SELECT case_id AS id, regexp_replace(coalesce(raw_text, ''), '\r\n|\n|\r', '', 'g') AS contents FROM cases", "cases")
def corpus_json(spark: SparkSession, d: str) -> DataFrame:
    sinks.write_corpus(cases(spark, d, "raw_text").withColumnRenamed("raw_text", "text"), path := new_path(spark, "corpus"))
    return spark.read.schema("id string, contents string").json(path)


@query(f"SELECT case_id AS query_id FROM cases WHERE clean_text IS NULL OR {_strip('clean_text')} = ''", "cases")
def topics_without_text(spark: SparkSession, d: str) -> DataFrame:
    rows = cases(spark, d, "clean_text").select(F.col("case_id").alias("query_id"), F.col("clean_text").alias("text"))
    return sinks.write_topics(rows, new_path(spark, "topics"))


@query(rf"SELECT case_id || chr(9) || regexp_replace(raw_text, '\t|\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]', ' ', 'g') AS value FROM cases WHERE {_strip('raw_text')} <> ''", "cases")
def topics_tsv(spark: SparkSession, d: str) -> DataFrame:
    rows = cases(spark, d, "raw_text").select(F.col("case_id").alias("query_id"), F.col("raw_text").alias("text"))
    sinks.write_topics(rows, path := new_path(spark, "topics"))
    return spark.read.text(path)


@query("SELECT p_brand AS model_name, 5 AS topk, 'run' AS trec_file, sum(p_size)::DOUBLE AS f1, min(p_size)::DOUBLE AS precision, max(p_size)::DOUBLE AS recall, i AS notes FROM part, (SELECT unnest(['1', '2']) AS i) GROUP BY p_brand, i")
def experiment_log(spark: SparkSession, d: str) -> DataFrame:
    """Brands stand for experiments, logged twice."""
    rows = table(spark, d, "part").groupBy(F.col("p_brand").alias("model_name")).agg(*[f("p_size").cast("double").alias(n) for f, n in ((F.sum, "f1"), (F.min, "precision"), (F.max, "recall"))])
    path = new_path(spark, "log")
    for turn in ("1", "2"):
        sinks.append_result(rows.withColumns({"topk": F.lit(5), "trec_file": F.lit("run"), "notes": F.lit(turn)}), path)
    return spark.read.parquet(path)


@query("SELECT case_id, r.year AS year, r.source AS source FROM (SELECT case_id, min({'t': coalesce(loaded_at, TIMESTAMP '1970-01-01'), 'year': year, 'source': year_source}) AS r FROM case_features WHERE case_id IS NOT NULL GROUP BY 1)")
def year_log(spark: SparkSession, d: str) -> DataFrame:
    """Versions of a case in the order they were loaded: the first counts."""
    rows = table(spark, d, "case_features").where("case_id is not null").withColumn("pos", F.coalesce("loaded_at", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")))
    return sinks.year_log(rows)


# --- nested JSON -------------------------------------------------------------------------------------------------


@query("SELECT query_id, candidate_id AS positive_id, [query_id, candidate_id] AS negative_ids FROM qrels", "qrels")
def contrastive_json(spark: SparkSession, d: str) -> DataFrame:
    rows = qrels(spark, d).select("query_id", F.col("candidate_id").alias("positive_id"), F.array("query_id", "candidate_id").alias("negative_ids"))
    sinks.write_samples(rows, path := new_path(spark, "samples"))
    return spark.read.schema("query_id string, positive_id string, negative_ids array<string>").json(path, multiLine=True)


@query("SELECT q.query_id AS qid, 'q ' || q.query_id AS query, q.candidate_id AS pos, n.n::BIGINT AS negatives FROM qrels q JOIN (SELECT query_id, count(*) AS n FROM qrels GROUP BY 1) n USING (query_id)", "qrels")
def src_grouped(spark: SparkSession, d: str) -> DataFrame:
    """A grouped sample for each query: its candidates as positives, and as negatives too."""
    passage = F.struct(F.col("candidate_id").alias("pid"), F.lit("text").alias("passage"))
    listed = qrels(spark, d).groupBy("query_id").agg(F.collect_list(passage).alias("pos"))
    rows = listed.select(F.struct(F.col("query_id").alias("qid"), F.concat(F.lit("q "), "query_id").alias("query")).alias("qry"), "pos", F.col("pos").alias("neg"))
    sinks.write_samples(rows, path := new_path(spark, "grouped"))
    read = files.read_grouped(spark, path)
    return read.select("qry.qid", "qry.query", F.explode("pos.pid").alias("pos"), F.size("neg").cast("long").alias("negatives"))


@query("SELECT query_id AS qid, candidate_id AS pid, 'q' AS qry, 'p ' || candidate_id AS psg FROM qrels", "qrels")
def src_prediction_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = qrels(spark, d).select(F.col("query_id").alias("qid"), F.col("candidate_id").alias("pid"), F.lit("q").alias("qry"), F.concat(F.lit("p "), "candidate_id").alias("psg"))
    sinks.write_samples(rows, path := new_path(spark, "pairs"))
    return files.read_prediction_pairs(spark, path)


def _prompts(spark: SparkSession, d: str) -> str:
    rows = table(spark, d, "documents").select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("prompt"), F.coalesce("docket", F.lit("none")).alias("label"))
    rows.write.json(path := new_path(spark, "prompts"))
    return path


@query("SELECT 'doc ' || doc_id || coalesce(docket, 'none') AS text FROM documents")
def src_prompts(spark: SparkSession, d: str) -> DataFrame:
    return files.read_prompts(spark, _prompts(spark, d))


@query("SELECT text FROM (SELECT 'doc ' || doc_id || coalesce(docket, 'none') AS text FROM documents) ORDER BY md5('42|' || text), text LIMIT 50")
def src_prompts_sample(spark: SparkSession, d: str) -> DataFrame:
    """The feature is the sample: 50 prompts in seeded order."""
    return files.read_prompts(spark, _prompts(spark, d), n=50)


@query("SELECT doc_id, CASE WHEN ('0x' || substr(md5('42|' || coalesce(text, '')), 1, 8))::BIGINT < 429496729 THEN 'test' ELSE 'train' END AS split FROM documents")
def corpus_split(spark: SparkSession, d: str) -> DataFrame:
    train, test = files.split_corpus(table(spark, d, "documents").select("doc_id", "text"), 0.1)
    return train.select("doc_id", F.lit("train").alias("split")).union(test.select("doc_id", F.lit("test")))


def _states(spark: SparkSession, d: str) -> DataFrame:
    """Nations stand for checkpoints, whose steps are their keys."""
    step = F.col("n_nationkey").cast("string")
    state = F.to_json(F.struct(F.col("n_nationkey").cast("long").alias("global_step"), F.array(F.create_map(F.lit("step"), step, F.lit("f1"), F.col("n_regionkey").cast("string"))).alias("log_history")))
    rows = table(spark, d, "nation").select(F.concat(F.lit("checkpoint-"), step, F.lit("/trainer_state")).alias("name"), state.alias("text"))
    return files.read_states(spark, _write_texts(rows, new_path(spark, "states"), ".json"))


@query("SELECT 'checkpoint-' || n_nationkey AS path, n_nationkey::BIGINT AS global_step, n_regionkey::VARCHAR AS f1 FROM nation")
def src_states(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d).select(F.regexp_extract("path", "[^/]+$", 0).alias("path"), "global_step", F.col("log_history")[0]["f1"].alias("f1"))


@query("SELECT 'checkpoint-' || max(n_nationkey) AS path, max(n_nationkey)::BIGINT AS number FROM nation")
def latest_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    return sampling.latest_numbered(_states(spark, d)).select(F.regexp_extract("path", "[^/]+$", 0).alias("path"), "number")


# --- settings ----------------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('fixed_topk', 2), ('ratio_cutoff', 54), ('largest_gap_cutoff', 81)) t(mode, settings)")
def config_grid(spark: SparkSession, d: str) -> DataFrame:
    """Settings by mode of a payload with two k, where an option that is blank changes nothing."""
    settings = config.cutoff_grid({"fixed_topk": {"k_values": [3, 4]}}, {"ratio_p": ""}).settings()
    return statistics.counter(spark.createDataFrame([(s.mode,) for s in settings], "mode string"), "mode").select(F.col("value").alias("mode"), F.col("count").cast("int").alias("settings"))


@query("SELECT * FROM (VALUES ('flag', 'False'), ('list', '(1, 2)'), ('scope', 'model'), ('source', 'raw'), ('key', 'b=c')) t(name, value)")
def config_values(spark: SparkSession, d: str) -> DataFrame:
    """A flag, a list, the choice of a scope file and of a vector source, and a name of a key file."""
    path = _one_file(spark.createDataFrame([("# note",), ("export A='b=c'",)], "value string"), new_path(spark, "keys"), "value")
    lines = "\n".join(r.value for r in spark.read.text(path).collect())  # two lines
    values = {
        "flag": config.flag("No"), "list": config.numbers("1, ,2"), "scope": config.first_given(None, " ", "model", "shared"),
        "source": config.vector_source("raw", None, {"raw": "raw", "processed": "p"}), "key": config.parse_keys(lines)["A"],
    }
    return spark.createDataFrame([(k, str(v)) for k, v in values.items()], "name string, value string")


# --- selections --------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT query_id, candidate_id FROM pred SEMI JOIN qrels USING (query_id) WHERE query_id <> candidate_id", "pred", "qrels")
def labelled_without_self(spark: SparkSession, d: str) -> DataFrame:
    return ranking.without_self(ranking.of_queries(predictions(spark, d), qrels(spark, d))).select("query_id", "candidate_id")


@query(f"SELECT DISTINCT {_n1('query_id')} AS query_id FROM case_labels WHERE query_id IS NOT NULL AND {_n1('query_id')} <> ''")
def distinct_in_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "case_labels").select(ids.plain_id(F.col("query_id")).alias("query_id"), F.lit(0).alias("pos"))
    return ranking.ordered_distinct(rows, "query_id", "pos").select("query_id")


@query(
    """SELECT id, part::INT AS part, pos FROM (SELECT id, min({'part': part, 'pos': pos}) AS f FROM (SELECT query_id AS id, 0 AS part, n AS pos FROM (SELECT query_id, count(*) AS n FROM qrels GROUP BY 1)
    UNION ALL SELECT query_id, 1, n FROM (SELECT query_id, count(*) AS n FROM pred GROUP BY 1)) GROUP BY 1), LATERAL (SELECT f.part AS part, f.pos AS pos)""",
    "qrels", "pred",
)
def ordered_union(spark: SparkSession, d: str) -> DataFrame:
    """Labelled queries before those of the run; positions stand for places in either list."""
    placed = lambda df: df.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("pos"))
    return ranking.ordered_union(placed(qrels(spark, d)), placed(predictions(spark, d).select("query_id")), "id", "pos")


@query(
    """SELECT row_number() OVER (ORDER BY query_id) - 1 AS pos, query_id FROM (SELECT query_id FROM qrels WHERE query_id NOT IN (SELECT case_id FROM cases)
    UNION SELECT query_id FROM qrels WHERE query_id NOT IN (SELECT case_id FROM vec))""",
    "qrels", "cases", "vec",
)
def missing_ids(spark: SparkSession, d: str) -> DataFrame:
    """Queries whose text or vector is missing, sorted."""
    q = qrels(spark, d).select("query_id").distinct()
    texts = q.join(cases(spark, d).select(F.col("case_id").alias("query_id")), "query_id", "left_anti")
    return ranking.sorted_union(texts, q.join(vectors(spark, d, "query_id"), "query_id", "left_anti"), "query_id")


@query(
    """SELECT row_number() OVER (ORDER BY candidate_id) - 1 AS pos, candidate_id FROM (SELECT DISTINCT candidate_id FROM pred SEMI JOIN qrels USING (query_id))
    WHERE candidate_id IN (SELECT case_id FROM vec)""",
    "pred", "qrels", "vec",
)
def candidate_override(spark: SparkSession, d: str) -> DataFrame:
    return ranking.candidate_override(predictions(spark, d), qrels(spark, d), vectors(spark, d, "candidate_id"))


@query("SELECT case_id AS query_id, 'listed' AS kind FROM cases WHERE case_id IN (SELECT query_id FROM qrels) UNION ALL SELECT case_id, 'all' FROM cases", "cases", "qrels")
def split_selection(spark: SparkSession, d: str) -> DataFrame:
    """Cases that the labels list, and all of them where there is no list."""
    all_ids = cases(spark, d).select(F.col("case_id").alias("query_id"))
    listed = ranking.split_selection(all_ids, qrels(spark, d)).withColumn("kind", F.lit("listed"))
    return listed.union(ranking.split_selection(all_ids, None).withColumn("kind", F.lit("all")))


@query(
    f"""WITH held AS (SELECT DISTINCT CASE c % 3 WHEN 0 THEN query_id WHEN 1 THEN query_id || '.txt' ELSE regexp_replace(query_id, '^0+', '') END AS key, query_id, candidate_id
    FROM (SELECT *, ('0x' || substr(md5(query_id), 1, 4))::INT AS c FROM qrels))
    SELECT query_id, candidate_id FROM held""",
    "qrels",
)
def scope_fallback_keys(spark: SparkSession, d: str) -> DataFrame:
    """A scope whose keys are written in three ways gives every query its candidates."""
    from caseloom.operators import scope

    q, c = qrels(spark, d), F.conv(F.substring(F.md5("query_id"), 1, 4), 16, 10).cast("int") % 3
    key = F.when(c == 0, F.col("query_id")).when(c == 1, F.concat("query_id", F.lit(".txt"))).otherwise(F.regexp_replace("query_id", "^0+", ""))
    return scope.scope_of_queries(q, q.select(key.alias("query_id"), "candidate_id", F.lit(0).alias("pos"))).select("query_id", "candidate_id")


@query("SELECT query_id, candidate_id FROM qrels ORDER BY md5(concat_ws('|', '7', query_id, candidate_id)), query_id, candidate_id LIMIT 40", "qrels")
def quick_sample(spark: SparkSession, d: str) -> DataFrame:
    """The feature is the sample: 40 pairs in seeded order."""
    return sampling.sample_rows(qrels(spark, d), 40, 7, "query_id", "candidate_id")
