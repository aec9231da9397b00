"""Queries over the test tables, one for each operator, and the SQL that another engine checks them with.

Tables stand for the pipeline's own: ``case_features`` for cases (current rows), ``ltr_features`` for predictions (the
latest row of a pair), ``case_labels`` for relevant pairs, ``case_vectors`` and ``embeddings`` for vectors,
``query_topics`` for topics, ``documents`` for token statistics, ``events`` for training logs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import ids, text
from caseloom.operators import cutoff, dense, features, lexical, metrics, ranking, sampling, scope, statistics
from caseloom.plans.tables import current_rows, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SLACK = 1
_WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _pad(x: str, n: int = 6) -> str:
    return f"CASE WHEN length({x}) < {n} THEN lpad({x}, {n}, '0') ELSE {x} END"


def _n1(x: str) -> str:
    return rf"regexp_replace({_strip(x)}, '\.txt$', '')"


def _n2(x: str, n: int = 6) -> str:
    return f"CASE WHEN regexp_full_match({_n1(x)}, '[0-9]+') THEN {_pad(_n1(x), n)} ELSE {_n1(x)} END"


CTES = {
    "cases": "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY loaded_at DESC NULLS LAST) rn FROM case_features WHERE case_id IS NOT NULL) WHERE rn = 1",
    "pred": """SELECT query_id, candidate_id, bm25_score, qld_score, bm25_ngram_score, dense_score, label, query_year, doc_year, coalesce(bm25_score, 0)::FLOAT AS rank_score,
               row_number() OVER (PARTITION BY query_id ORDER BY coalesce(bm25_score, 0)::FLOAT DESC, candidate_id) AS rk
               FROM (SELECT *, row_number() OVER (PARTITION BY query_id, candidate_id ORDER BY scored_at DESC) rn FROM ltr_features) WHERE rn = 1""",
    "qrels": f"SELECT DISTINCT {_n2('query_id')} AS query_id, {_n2('candidate_id')} AS candidate_id FROM case_labels WHERE query_id IS NOT NULL AND candidate_id IS NOT NULL",
    "vec": "SELECT DISTINCT case_id, embedding::DOUBLE[] AS v FROM case_vectors WHERE embedding IS NOT NULL",
    "scope": f"SELECT p.query_id, p.candidate_id FROM pred p SEMI JOIN qrels USING (query_id) WHERE p.query_year = 0 OR p.doc_year <= p.query_year + {SLACK}",
}
_NEEDS = {"scope": ("pred", "qrels")}


def sql(body: str, *ctes: str) -> str:
    wanted: list[str] = []
    for name in ctes:
        wanted += [n for n in (*_NEEDS.get(name, ()), name) if n not in wanted]
    if not wanted:
        return body
    head = "WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in wanted)
    return head + ", " + body.removeprefix("WITH ") if body.startswith("WITH ") else head + " " + body


def query(oracle: str | None = None, *ctes: str):
    """Registers a query under its function's name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = sql(oracle, *ctes)
        return f

    return register


def cases(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return current_rows(table(spark, d, "case_features"), "case_id", "loaded_at", list(columns))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    names = ("bm25_score", "qld_score", "bm25_ngram_score", "dense_score", "label", "query_year", "doc_year")
    last = table(spark, d, "ltr_features").groupBy("query_id", "candidate_id").agg(F.max_by(F.struct(*names), "scored_at").alias("r"))
    return last.select("query_id", "candidate_id", "r.*").withColumn("rank_score", F.coalesce("bm25_score", F.lit(0.0)).cast("float"))


def qrels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "case_labels").where("query_id is not null and candidate_id is not null")
    return rows.select(ids.padded_id(F.col("query_id")).alias("query_id"), ids.padded_id(F.col("candidate_id")).alias("candidate_id")).distinct()


def vectors(spark: SparkSession, d: str, key: str) -> DataFrame:
    return table(spark, d, "case_vectors").where("embedding is not null").select(F.col("case_id").alias(key), "embedding").distinct()


def year_scope(spark: SparkSession, d: str) -> DataFrame:
    """In-scope pairs of the labelled queries; the others have no scope."""
    return scope.in_scope_by_year(predictions(spark, d), SLACK).join(qrels(spark, d).select("query_id").distinct(), "query_id", "left_semi").select("query_id", "candidate_id")


def r6(name: str):
    return F.round(name, 6).alias(name)


# --- ids ---------------------------------------------------------------------------------------------------------


@query(
    rf"""SELECT DISTINCT query_id AS raw_id, {_n1("query_id")} AS n1, {_n2("query_id")} AS n2, {_n2("query_id", 8)} AS n3, {_pad("query_id")} AS n4_run,
    replace(query_id, '.txt', '') AS n4_label, try_cast({_strip("split_part(query_id, '.', 1)")} AS BIGINT) AS n5 FROM case_labels"""
)
def normalize_case_id(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("query_id")
    return table(spark, d, "case_labels").select(
        c.alias("raw_id"), ids.plain_id(c).alias("n1"), ids.padded_id(c).alias("n2"), ids.padded_id(c, 8).alias("n3"), ids.run_id(c).alias("n4_run"), ids.label_id(c).alias("n4_label"), ids.numeric_id(c).alias("n5")
    ).distinct()


@query("SELECT DISTINCT query_id FROM pred ANTI JOIN qrels USING (query_id)", "pred", "qrels")
def missing_queries(spark: SparkSession, d: str) -> DataFrame:
    return scope.missing_queries(predictions(spark, d), qrels(spark, d))


@query("SELECT query_id, candidate_id FROM qrels", "qrels")
def labels_normalized(spark: SparkSession, d: str) -> DataFrame:
    return qrels(spark, d)


# --- scope -------------------------------------------------------------------------------------------------------

_QYEARS = "(SELECT q.query_id, CASE WHEN c.year IS NULL OR c.year < 0 THEN 0 ELSE c.year END AS year FROM (SELECT DISTINCT query_id FROM qrels) q LEFT JOIN cases c ON c.case_id = q.query_id)"
_CYEARS = "(SELECT case_id AS candidate_id, CASE WHEN year IS NULL OR year < 0 THEN 0 ELSE year END AS year FROM cases)"


def _years(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    known = cases(spark, d, "year").select("case_id", F.greatest(F.coalesce("year", F.lit(0)), F.lit(0)).alias("year"))
    q = qrels(spark, d).select("query_id").distinct().join(known, F.col("query_id") == F.col("case_id"), "left").select("query_id", F.coalesce("year", F.lit(0)).alias("year"))
    return q, known.select(F.col("case_id").alias("candidate_id"), "year", F.lit(0).alias("pos"))


@query(f"SELECT q.query_id, c.candidate_id FROM {_QYEARS} q JOIN {_CYEARS} c ON q.year = 0 OR c.year <= q.year + {SLACK} WHERE q.query_id <> c.candidate_id", "cases", "qrels")
def scope_pairs(spark: SparkSession, d: str) -> DataFrame:
    q, c = _years(spark, d)
    return scope.build_scope(q, c, SLACK, "all", exclude_self=True).select("query_id", "candidate_id")


@query(f"SELECT q.query_id, count(c.candidate_id) AS candidates FROM {_QYEARS} q LEFT JOIN {_CYEARS} c ON q.year <> 0 AND c.year <= q.year + {SLACK} GROUP BY 1", "cases", "qrels")
def scope_sizes(spark: SparkSession, d: str) -> DataFrame:
    q, c = _years(spark, d)
    return scope.scope_sizes(q, c, SLACK, "none")


@query(
    f"""SELECT count(*) AS queries, round(avg(n), 6) AS avg_candidates, count(*) FILTER (year = 0) AS unknown_query_years, (SELECT count(*) FROM {_CYEARS}) AS candidates,
    (SELECT count(*) FROM {_CYEARS} WHERE year = 0) AS unknown_candidate_years
    FROM (SELECT q.query_id, any_value(q.year) AS year, count(c.candidate_id) AS n FROM {_QYEARS} q LEFT JOIN {_CYEARS} c ON q.year <> 0 AND c.year <= q.year + {SLACK} GROUP BY 1)""",
    "cases", "qrels",
)
def scope_stats(spark: SparkSession, d: str) -> DataFrame:
    q, c = _years(spark, d)
    return scope.scope_stats(scope.scope_sizes(q, c, SLACK, "none"), q, c).withColumn("avg_candidates", F.round("avg_candidates", 6))


@query(f"SELECT query_id, candidate_id FROM pred WHERE query_year = 0 OR doc_year <= query_year + {SLACK}", "pred")
def scope_year(spark: SparkSession, d: str) -> DataFrame:
    return scope.in_scope_by_year(predictions(spark, d), SLACK).select("query_id", "candidate_id")


@query("SELECT query_id, candidate_id FROM pred SEMI JOIN scope USING (query_id, candidate_id)", "scope")
def filter_run_empty(spark: SparkSession, d: str) -> DataFrame:
    return scope.filter_by_scope(predictions(spark, d), year_scope(spark, d), scope.Missing.EMPTY).select("query_id", "candidate_id")


_KEPT = "(SELECT p.* FROM pred p LEFT JOIN scope s USING (query_id, candidate_id) WHERE s.query_id IS NOT NULL OR p.query_id NOT IN (SELECT query_id FROM scope))"


@query(f"SELECT query_id, candidate_id FROM {_KEPT}", "scope")
def filter_run_keep(spark: SparkSession, d: str) -> DataFrame:
    return scope.filter_by_scope(predictions(spark, d), year_scope(spark, d), scope.Missing.KEEP).select("query_id", "candidate_id")


@query(
    f"SELECT query_id, candidate_id, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, candidate_id)::INT AS rank_position FROM {_KEPT} WHERE query_id <> candidate_id", "scope"
)
def legal_filter(spark: SparkSession, d: str) -> DataFrame:
    return scope.legal_filter(predictions(spark, d), year_scope(spark, d))[0].select("query_id", "candidate_id", "rank_position")


@query(
    """SELECT count(*) AS rows_before, count(*) FILTER (NOT o AND NOT own) AS rows_after, count(*) FILTER (o) AS removed_by_scope, count(*) FILTER (own) AS removed_by_self,
    count(DISTINCT query_id) FILTER (NOT scoped) AS missing_scope_queries, count(DISTINCT query_id) - count(DISTINCT query_id) FILTER (NOT o AND NOT own) AS empty_queries
    FROM (SELECT *, NOT o AND query_id = candidate_id AS own FROM (SELECT p.query_id, p.candidate_id, sq.query_id IS NOT NULL AS scoped, sq.query_id IS NOT NULL AND s.query_id IS NULL AS o
    FROM pred p LEFT JOIN scope s USING (query_id, candidate_id) LEFT JOIN (SELECT DISTINCT query_id FROM scope) sq ON sq.query_id = p.query_id))""",
    "scope",
)
def legal_filter_counts(spark: SparkSession, d: str) -> DataFrame:
    return scope.legal_filter(predictions(spark, d), year_scope(spark, d))[1]


# --- ranks and dense scores --------------------------------------------------------------------------------------


@query(
    """SELECT query_id, candidate_id, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC NULLS LAST, candidate_id)::INT AS bm25_rank,
    row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN isnan(dense_score) THEN NULL ELSE dense_score END DESC NULLS LAST, candidate_id)::INT AS dense_rank FROM pred""",
    "pred",
)
def feature_ranks(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d).withColumn("dense_score", F.when(~F.isnan("dense_score"), F.col("dense_score")))
    p = ranking.rank_by_candidate(p, "bm25_score", "bm25_rank")
    return ranking.rank_by_candidate(p, "dense_score", "dense_rank").select("query_id", "candidate_id", "bm25_rank", "dense_rank")


def _topics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_topics").select("query_id", "embedding")


_TOP5 = """SELECT query_id, candidate_id, round(s, 6) AS score, rk::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, candidate_id) rk
FROM (SELECT q.query_id, v.case_id AS candidate_id, round({}, 9) AS s FROM (SELECT query_id, embedding::DOUBLE[] AS e FROM query_topics WHERE embedding IS NOT NULL) q, vec v WHERE q.query_id <> v.case_id)) WHERE rk <= 5"""


@query(_TOP5.format("list_inner_product(q.e, v.v)"), "vec")
def dense_dot_top5(spark: SparkSession, d: str) -> DataFrame:
    return dense.top_similar(_topics(spark, d), vectors(spark, d, "candidate_id"), 5, "dot").withColumn("score", F.round("score", 6))


@query(_TOP5.format("list_inner_product(q.e, v.v) / (greatest(sqrt(list_inner_product(q.e, q.e)), 1e-12) * greatest(sqrt(list_inner_product(v.v, v.v)), 1e-12))"), "vec")
def dense_cos_top5(spark: SparkSession, d: str) -> DataFrame:
    return dense.top_similar(_topics(spark, d), vectors(spark, d, "candidate_id"), 5, "cos").withColumn("score", F.round("score", 6))


@query(
    "SELECT p.query_id, p.candidate_id, round(list_inner_product(a.v, b.v), 6) AS score FROM pred p JOIN vec a ON a.case_id = p.query_id JOIN vec b ON b.case_id = p.candidate_id", "pred", "vec"
)
def dense_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = predictions(spark, d).select("query_id", "candidate_id")
    return dense.pair_similarity(pairs, vectors(spark, d, "query_id"), vectors(spark, d, "candidate_id")).withColumn("score", F.round("score", 6))


@query(
    """SELECT query_id, candidate_id, rk::INT AS rank FROM (SELECT p.query_id, p.candidate_id, row_number() OVER (PARTITION BY p.query_id ORDER BY round(list_inner_product(a.v, b.v)
    / (greatest(sqrt(list_inner_product(a.v, a.v)), 1e-12) * greatest(sqrt(list_inner_product(b.v, b.v)), 1e-12)), 9) DESC, p.candidate_id) rk
    FROM scope p JOIN vec a ON a.case_id = p.query_id JOIN vec b ON b.case_id = p.candidate_id) WHERE rk <= 5""",
    "scope", "vec",
)
def dense_cos_scoped(spark: SparkSession, d: str) -> DataFrame:
    scored = dense.pair_similarity(year_scope(spark, d), vectors(spark, d, "query_id"), vectors(spark, d, "candidate_id"), "cos").withColumn("score", F.round("score", 9))
    return ranking.rank_by_position(scored, "score", "candidate_id", k=5).select("query_id", "candidate_id", "rank")


@query(
    """SELECT query_id, candidate_id, round(max(s), 6) AS chunk_sim_max, round(avg(s), 6) AS chunk_sim_mean, round(avg(s) FILTER (r <= 2), 6) AS chunk_sim_top2_mean
    FROM (SELECT a.c AS query_id, b.c AS candidate_id, list_inner_product(a.e, b.e) AS s, row_number() OVER (PARTITION BY a.c, b.c ORDER BY list_inner_product(a.e, b.e) DESC) AS r
    FROM (SELECT vec_id // 3 AS c, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT vec_id // 3 AS c, embedding::DOUBLE[] AS e FROM embeddings) b ON b.c = a.c + 1) GROUP BY 1, 2"""
)
def chunk_sims(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "embeddings").select(F.expr("vec_id div 3").alias("c"), "embedding")
    keys = chunks.select("c").distinct()
    pairs = keys.select(F.col("c").alias("query_id"), (F.col("c") + 1).alias("candidate_id")).join(keys, F.col("candidate_id") == F.col("c"), "left_semi")
    out = dense.chunk_similarities(pairs, chunks.withColumnRenamed("c", "query_id"), chunks.withColumnRenamed("c", "candidate_id"))
    return out.select("query_id", "candidate_id", r6("chunk_sim_max"), r6("chunk_sim_mean"), r6("chunk_sim_top2_mean"))


# --- metrics -----------------------------------------------------------------------------------------------------

_PRF = """SELECT tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM (SELECT count(*) FILTER (p AND r) AS tp, count(*) FILTER (p AND NOT r) AS fp, count(*) FILTER (NOT p) AS fn
FROM (SELECT a.query_id IS NOT NULL AS p, b.query_id IS NOT NULL AS r FROM ({}) a FULL JOIN ({}) b USING (query_id, candidate_id)))"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("tp", "fp", "fn", r6("precision"), r6("recall"), r6("f1"))


_BY_DENSE = """SELECT query_id, candidate_id FROM (SELECT query_id, candidate_id, row_number() OVER (PARTITION BY query_id
ORDER BY CASE WHEN isnan(dense_score) THEN NULL ELSE dense_score END DESC NULLS LAST, candidate_id) AS r FROM pred WHERE query_id <> candidate_id) WHERE r <= 5"""


def _dense_top5(spark: SparkSession, d: str) -> DataFrame:
    p = ranking.without_self(predictions(spark, d)).withColumn("dense_score", F.when(~F.isnan("dense_score"), F.col("dense_score")))
    return ranking.rank_by_candidate(p, "dense_score", k=5)


@query(_PRF.format(f"SELECT * FROM ({_BY_DENSE}) WHERE query_id IN (SELECT query_id FROM qrels)", "SELECT * FROM qrels"), "pred", "qrels")
def dense_micro_prf5(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.evaluate(_dense_top5(spark, d), qrels(spark, d)))


@query(
    _PRF.format(f"SELECT * FROM ({_BY_DENSE}) WHERE query_id IN (SELECT query_id FROM qrels)", f"SELECT * FROM qrels WHERE query_id IN (SELECT query_id FROM ({_BY_DENSE}))"), "pred", "qrels"
)
def dense_micro_prf5_answered(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.evaluate(_dense_top5(spark, d), qrels(spark, d), skip_unanswered=True))


@query(
    """SELECT count(e.query_id) AS expected, count(p.query_id) AS predicted, count(*) FILTER (p.query_id IS NULL) AS missing, count(*) FILTER (e.query_id IS NULL) AS unexpected
    FROM (SELECT DISTINCT query_id FROM qrels) e FULL JOIN (SELECT DISTINCT query_id FROM pred) p ON e.query_id = p.query_id""",
    "pred", "qrels",
)
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return metrics.coverage(predictions(spark, d), qrels(spark, d))


_NDCG = """SELECT query_id, round(sum(y) FILTER (rk <= 5) / 5, 6) AS p_at_5, round(CASE WHEN sum(y) > 0 THEN sum(y) FILTER (rk <= 5) / sum(y) ELSE 0 END, 6) AS r_at_5,
round(CASE WHEN sum(y) > 0 THEN sum(y / log2(rk + 1)) FILTER (rk <= 10) / list_sum(list_transform(range(1, least(sum(y), 10)::BIGINT + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg_at_10,
sum(y)::BIGINT AS relevant FROM (SELECT query_id, rk, coalesce(label, 0)::DOUBLE AS y FROM pred) GROUP BY 1"""


@query(_NDCG, "pred")
def ndcg10(spark: SparkSession, d: str) -> DataFrame:
    ranked = ranking.rank_by_candidate(predictions(spark, d).withColumn("label", F.coalesce("label", F.lit(0))), "rank_score")
    return metrics.rank_metrics(ranked).select("query_id", r6("p_at_5"), r6("r_at_5"), r6("ndcg_at_10"), "relevant")


@query(
    """SELECT query_id, candidate_id FROM (SELECT q.query_id, d.candidate_id, row_number() OVER (PARTITION BY q.query_id ORDER BY i) AS r
    FROM (SELECT query_id, ('0x' || substr(md5('42|' || query_id), 1, 13))::BIGINT AS start, unnest(range(0, least(5, n - 1) + 1)) AS i FROM (SELECT DISTINCT query_id FROM qrels), (SELECT count(DISTINCT candidate_id) AS n FROM qrels)) q
    JOIN (SELECT candidate_id, row_number() OVER (ORDER BY md5('42|' || candidate_id), candidate_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT candidate_id FROM qrels)) d
    ON d.place = (q.start + q.i) % d.n WHERE q.query_id <> d.candidate_id) WHERE r <= 5""",
    "qrels",
)
def random_baseline(spark: SparkSession, d: str) -> DataFrame:
    return metrics.random_baseline(qrels(spark, d), 5)


# --- cutoffs -----------------------------------------------------------------------------------------------------

_GRID = cutoff.Grid()
_RATIO = cutoff.Setting("ratio_cutoff", p=0.85, l=1, h=7)
_GAP = cutoff.Setting("largest_gap_cutoff", n=20, buffer=1, l=1, h=7)
#: k of a query for settings in the columns mode, k, p, l, h, gn, buffer; of prediction ranks up to 30.
_K = """SELECT s.*, r.query_id, r.n, r.total, CASE s.mode WHEN 'fixed_topk' THEN least(s.k, r.n)
WHEN 'ratio_cutoff' THEN least(greatest((SELECT count(*) FROM (SELECT unnest(r.sc[1:least(s.h, r.n)]) AS x) WHERE x >=
  (CASE WHEN r.sc[1] > 0 THEN s.p * r.sc[1]::DOUBLE WHEN r.sc[1] < 0 THEN r.sc[1]::DOUBLE / s.p ELSE 0 END)::FLOAT), least(s.l, r.n)), s.h, r.n)
ELSE CASE WHEN r.n < 2 THEN least(r.n, s.l) ELSE least(greatest(coalesce((SELECT arg_max(i, {'g': r.sc[i] - r.sc[i + 1], 'i': -i}) FROM (SELECT unnest(range(1, least(s.gn, r.n))) AS i)), 1) + s.buffer, s.l), s.h, r.n) END END AS kk
FROM settings s, rows r"""
_ROWS = "SELECT query_id, count(*) AS n, sum(coalesce(label, 0))::BIGINT AS total, list(rank_score ORDER BY rk) AS sc FROM pred GROUP BY 1"


def _settings_sql(settings: list[cutoff.Setting]) -> str:
    rows = ", ".join(f"('{s.mode}', '{s.params}', {s.k}, {s.p}::DOUBLE, {s.l}, {s.h}, {s.n}, {s.buffer})" for s in settings)
    return f"SELECT * FROM (VALUES {rows}) AS t(mode, params, k, p, l, h, gn, buffer)"


def _k_sql(*settings: cutoff.Setting) -> str:
    return f"WITH settings AS ({_settings_sql(list(settings))}), rows AS ({_ROWS}) {_K}"


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.rankings(predictions(spark, d), cutoff.depth_of(_GRID.settings()))


def _k_query(setting: cutoff.Setting):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _ranked(spark, d).select("query_id", cutoff.cutoff_k(setting).alias("cutoff_k"))

    return run


for _name, _setting in (("cutoff_fixed", cutoff.Setting("fixed_topk", k=5)), ("cutoff_ratio", _RATIO), ("cutoff_gap", _GAP)):
    QUERIES[_name] = _k_query(_setting)
    ORACLE[_name] = sql(f"SELECT query_id, kk::INT AS cutoff_k FROM ({_k_sql(_setting)})", "pred")

_EVALUATED = f"""SELECT mode, params, any_value(k) AS k, any_value(p) AS p, any_value(l) AS l, any_value(h) AS h, any_value(gn) AS gn, any_value(buffer) AS buffer,
sum(tp)::BIGINT AS tp, sum(kk - tp)::BIGINT AS fp, sum(total - tp)::BIGINT AS fn, avg(r5 / 5) AS p5, avg(CASE WHEN total > 0 THEN r5 / total ELSE 0 END) AS rr5,
avg(CASE WHEN total > 0 THEN dcg / list_sum(list_transform(range(1, least(total, 10) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END) AS nd, avg(kk) AS ar, median(kk)::DOUBLE AS mr, min(kk) AS mn, max(kk) AS mx, count(*) AS qc
FROM (SELECT x.mode, x.params, x.query_id, any_value(x.k) AS k, any_value(x.p) AS p, any_value(x.l) AS l, any_value(x.h) AS h, any_value(x.gn) AS gn, any_value(x.buffer) AS buffer, any_value(x.kk) AS kk, any_value(x.total) AS total,
 coalesce(sum(y.lab) FILTER (y.rk <= x.kk), 0) AS tp, coalesce(sum(y.lab) FILTER (y.rk <= least(x.kk, 5)), 0) AS r5, coalesce(sum(y.lab / log2(y.rk + 1)) FILTER (y.rk <= least(x.kk, 10)), 0) AS dcg
 FROM ({_k_sql(*_GRID.settings())}) x LEFT JOIN (SELECT query_id, rk, coalesce(label, 0)::BIGINT AS lab FROM pred WHERE rk <= 30) y USING (query_id) GROUP BY 1, 2, 3) GROUP BY 1, 2"""
_SCORED = f"SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS ff FROM ({_EVALUATED})"
_GRID_COLUMNS = "mode, params, tp, fp, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(ff, 6) AS f1, round(p5, 6) AS p_at_5, round(rr5, 6) AS r_at_5, round(nd, 6) AS ndcg_at_10, round(ar, 6) AS avg_retained, mr AS median_retained, mn::BIGINT AS min_retained, mx::BIGINT AS max_retained, qc AS query_count"
_BEST = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY round(ff, 9) DESC, round(re, 9) DESC, round(pr, 9) DESC, CASE WHEN mode = 'fixed_topk' THEN k ELSE h END, CASE WHEN mode = 'ratio_cutoff' THEN l ELSE buffer END,
CASE WHEN mode = 'ratio_cutoff' THEN p ELSE gn END, l, ar, params DESC) AS place FROM ({_SCORED})) WHERE place = 1"""


def _grid_columns(df: DataFrame) -> DataFrame:
    kept = ["tp", "fp", "fn", "median_retained", "min_retained", "max_retained", "query_count"]
    return df.select("mode", "params", *kept, *[r6(c) for c in ("precision", "recall", "f1", "p_at_5", "r_at_5", "ndcg_at_10", "avg_retained")])


@query(f"SELECT {_GRID_COLUMNS} FROM ({_SCORED})", "pred")
def cutoff_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid_columns(cutoff.evaluate_settings(_ranked(spark, d), _GRID.settings()))


@query(f"SELECT {_GRID_COLUMNS} FROM ({_BEST})", "pred")
def cutoff_best(spark: SparkSession, d: str) -> DataFrame:
    return _grid_columns(cutoff.best_settings(cutoff.evaluate_settings(_ranked(spark, d), _GRID.settings())))


@query(f"SELECT mode, params FROM ({_BEST}) ORDER BY round(ff, 9) DESC, round(re, 9) DESC, round(pr, 9) DESC, ar, mode DESC, params DESC LIMIT 1", "pred")
def cutoff_best_mode(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.best_mode(cutoff.best_settings(cutoff.evaluate_settings(_ranked(spark, d), _GRID.settings()))).select("mode", "params")


@query(f"SELECT p.query_id, p.candidate_id, x.kk::INT AS cutoff_k, p.rk::INT AS selected_rank FROM pred p JOIN ({_k_sql(_RATIO)}) x USING (query_id) WHERE p.rk <= x.kk", "pred")
def cutoff_selected(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.select_rows(predictions(spark, d), _RATIO).select("query_id", "candidate_id", "cutoff_k", "selected_rank")


@query(
    f"""SELECT x.query_id, any_value(x.n) AS num_candidates, any_value(x.kk)::INT AS retained_count, round(any_value(x.kk) / any_value(x.n), 6) AS retained_ratio, any_value(x.total) AS num_relevant,
    coalesce(sum(p.label) FILTER (p.rk <= x.kk), 0)::BIGINT AS true_positive FROM ({_k_sql(_GAP)}) x JOIN pred p USING (query_id) GROUP BY 1""",
    "pred",
)
def cutoff_query_stats(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.query_stats(_ranked(spark, d), _GAP).withColumn("retained_ratio", F.round("retained_ratio", 6))


# --- lexical -----------------------------------------------------------------------------------------------------

_TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_BIGRAMS = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"


def _lexical_sql(score: str, unit: str = "t") -> str:
    return f"""WITH d0 AS (SELECT case_id AS doc_id, {_TOKENS.format("clean_text")} AS t FROM cases), d AS (SELECT doc_id, {unit} AS t FROM d0),
    q0 AS (SELECT query_id, {_TOKENS.format('"text"')} AS t FROM query_topics), q AS (SELECT query_id, {unit} AS t FROM q0),
    post AS (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY 1, 2),
    terms AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM post GROUP BY 1), c AS (SELECT (SELECT count(*) FROM d) AS n, (SELECT sum(tf) FROM post) AS total),
    qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(t) AS term FROM q) GROUP BY 1, 2),
    s AS (SELECT query_id, doc_id AS candidate_id, round(sum({score}), 6) AS score FROM qt JOIN terms USING (term) JOIN post USING (term), c GROUP BY 1, 2)
    SELECT query_id, candidate_id, score, rk::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score::FLOAT DESC, candidate_id) AS rk FROM s) WHERE rk <= 10"""


def _bm25_sql(k1: float, b: float) -> str:
    return f"qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * dl / (total / n)))"


def _search(spark: SparkSession, d: str, kind: str, n: int = 1) -> DataFrame:
    index = lexical.build_index(cases(spark, d, "clean_text"), "case_id", "clean_text", n)
    score = {"bm25": lambda: lexical.bm25(index, 3.0, 1.0), "qld": lambda: lexical.dirichlet(index, 1000.0), "ngram": lambda: lexical.bm25(index, 0.9, 0.4)}[kind]()
    return lexical.lexical_search(index, lexical.query_terms(table(spark, d, "query_topics"), "query_id", "text", n), score, 10, decimals=6)


@query(_lexical_sql(_bm25_sql(3.0, 1.0)), "cases")
def bm25_top10(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "bm25")


@query(_lexical_sql("qtf * greatest(0, ln(1 + tf / (1000.0::DOUBLE * ((cf + 1.0::DOUBLE) / (total + 1.0::DOUBLE)))) + ln(1000.0::DOUBLE / (dl + 1000.0::DOUBLE)))"), "cases")
def qld_top10(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "qld")


@query(_lexical_sql(_bm25_sql(0.9, 0.4), _BIGRAMS.format("t")), "cases")
def bm25_bigram_top10(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "ngram", 2)


@query(f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT term, case_id, count(*) AS tf FROM (SELECT case_id, unnest({_TOKENS.format('clean_text')}) AS term FROM cases) GROUP BY 1, 2) GROUP BY 1", "cases")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return lexical.build_index(cases(spark, d, "clean_text"), "case_id", "clean_text").terms


# --- text --------------------------------------------------------------------------------------------------------


@query(
    "SELECT case_id, " + ", ".join(rf"len(regexp_extract_all(coalesce(raw_text, ''), '\b{t}\b'))::INT AS {c}" for c, t in features.COUNTS.items()) + " FROM cases", "cases"
)
def placeholder_counts(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d, "raw_text").select("case_id", *[text.placeholder_count(F.col("raw_text"), t).alias(c) for c, t in features.COUNTS.items()])


def _clean_sql(x: str) -> str:
    out = f"translate(coalesce({x}, ''), chr(9) || chr(13) || chr(10), '   ')"
    for t in text.PLACEHOLDERS:
        out = f"replace(replace({out}, '<{t}>', ' '), '{t}', ' ')"
    return _strip(f"regexp_replace({out}, '{_WS}+', ' ', 'g')")


@query(f"SELECT case_id, md5({_clean_sql('raw_text')}) AS digest, length({_clean_sql('raw_text')})::INT AS n FROM cases", "cases")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    c = text.clean_text(F.col("raw_text"))
    return cases(spark, d, "raw_text").select("case_id", c.alias("c")).select("case_id", F.md5("c").alias("digest"), F.length("c").alias("n"))


@query(rf"SELECT case_id, coalesce(list_max(list_transform(regexp_extract_all(coalesce(raw_text, ''), '{text.SCOPE_YEAR}', 1), lambda y: y::INT)), 0) AS year FROM cases", "cases")
def year_max(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d, "raw_text").select("case_id", text.max_year(F.col("raw_text")).alias("year"))


def _years_sql(x: str) -> str:
    return rf"list_transform(regexp_extract_all({x}, '{text.CASE_YEAR}', 1), lambda y: y::INT)"


def _first_sql(x: str, pattern: str, group: int) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '{pattern.replace('(?imd)', '(?im)')}', {group}), lambda m: list_max({_years_sql('m')})), lambda y: y IS NOT NULL)[1]"


_HEADER = r"array_to_string(regexp_split_to_array(t, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]')[1:120], chr(10))"
_YEAR = f"""SELECT case_id, coalesce(e, n, f, g, -1) AS year, CASE WHEN e IS NOT NULL THEN 'header_explicit' WHEN n IS NOT NULL THEN 'neutral_citation' WHEN f IS NOT NULL THEN 'front_regex'
WHEN g IS NOT NULL THEN 'fallback_global_max' ELSE 'missing' END AS source FROM (SELECT case_id, coalesce({", ".join(_first_sql("h", p, 1) for p in text.DATE_LINES)}) AS e,
coalesce({", ".join(_first_sql("h", p, 0) for p in text.NEUTRAL_CITATIONS)}) AS n, (list_sort(list_transform(list_distinct(fy), lambda y: {{'n': len(list_filter(fy, lambda x: x = y)), 'y': y}}), 'DESC')[1]).y AS f, list_max({_years_sql("t")}) AS g
FROM (SELECT case_id, t, {_HEADER} AS h, {_years_sql("left(t, 12000)")} AS fy FROM (SELECT case_id, coalesce(raw_text, '') AS t FROM cases)))"""


@query(_YEAR, "cases")
def year_priority(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d, "raw_text").select("case_id", text.case_year(F.col("raw_text")).alias("y")).select("case_id", "y.year", "y.source")


_LINES = r"regexp_split_to_array(coalesce({}, ''), '\r\n|\n|\r')"


@query(rf"SELECT case_id, md5(array_to_string({_LINES.format('raw_text')}, '')) AS digest FROM cases", "cases")
def corpus_text(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d, "raw_text").select("case_id", F.md5(text.corpus_text(F.col("raw_text"))).alias("digest"))


@query(
    f"SELECT case_id, md5(CASE WHEN length(t) > 30000 THEN left(t, 10000) ELSE t END) AS digest, length(t)::INT AS n FROM (SELECT case_id, array_to_string(list_transform({_LINES.format('raw_text')}, lambda l: {_strip('replace(l, chr(9), chr(32))')}), '') AS t FROM cases)",
    "cases",
)
def query_text(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("raw_text")
    return cases(spark, d, "raw_text").select("case_id", F.md5(text.query_text(c)).alias("digest"), F.length(text.query_text(c, 1 << 30)).alias("n"))


@query(f"SELECT case_id, md5(array_to_string(regexp_split_to_array({_strip('left(t, 10000)')}, '{_WS}+')[1:900], ' ')) AS digest FROM (SELECT case_id, {_clean_sql('raw_text')} AS t FROM cases)", "cases")
def truncated_query(spark: SparkSession, d: str) -> DataFrame:
    c = text.truncated_query(text.clean_text(F.col("raw_text")))
    return cases(spark, d, "raw_text").select("case_id", F.md5(F.rtrim(c)).alias("digest"))


@query(f"SELECT case_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END::INT AS words, (length(r) - length(replace(r, chr(10), '')))::INT AS breaks FROM (SELECT case_id, coalesce(raw_text, '') AS r, {_strip(f'''regexp_replace(coalesce(raw_text, ''), '{_WS}+', ' ', 'g')''')} AS t FROM cases)", "cases")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("raw_text")
    return cases(spark, d, "raw_text").select("case_id", text.word_count(c).alias("words"), text.line_breaks(c).alias("breaks"))


@query(
    """SELECT case_id, t AS summary FROM (SELECT case_id, trim(CASE WHEN strpos(u, chr(10)) > 0 THEN left(u, length(u) - strpos(reverse(u), chr(10))) ELSE left(r, length(r) - 1) END) AS t FROM (
    SELECT case_id, r, CASE WHEN strpos(r, '- Topic') > 0 THEN left(r, strpos(r, '- Topic') - 1) ELSE left(r, length(r) - 1) END AS u FROM (
    SELECT case_id, 'x' || clean_text || chr(10) || '- Topic ' || case_id AS r FROM cases WHERE clean_text IS NOT NULL AND clean_text <> ''))) WHERE t <> ''""",
    "cases",
)
def summary_extract(spark: SparkSession, d: str) -> DataFrame:
    """The cases have no summaries, so each clean text is made one."""
    made = cases(spark, d, "clean_text").where("clean_text is not null and clean_text != ''")
    c = F.concat(F.lit("Summary:x"), "clean_text", F.lit("\n- Topic "), "case_id")
    return made.select("case_id", text.summary(c).alias("summary")).where("summary is not null")


# --- features ----------------------------------------------------------------------------------------------------


@query(
    f"""WITH f AS (SELECT case_id, year, len({_TOKENS.format("clean_text")}) AS length, citation_num AS c, reference_num AS r, fragment_num AS g FROM cases),
    j AS (SELECT p.query_id, p.candidate_id, coalesce(CASE WHEN isnan(p.dense_score) THEN 0 ELSE p.dense_score END, 0)::FLOAT AS dense_score, coalesce(p.bm25_score, 0)::FLOAT AS bm25_score,
    coalesce(a.length, 0) AS ql, coalesce(b.length, 0) AS dl, coalesce(a.c, 0) AS qc, coalesce(b.c, 0) AS dc, coalesce(a.g, 0) AS qg, coalesce(b.r, 0) AS dr, coalesce(a.year, -1) AS qy, coalesce(b.year, -1) AS dy
    FROM pred p LEFT JOIN f a ON a.case_id = p.query_id LEFT JOIN f b ON b.case_id = p.candidate_id)
    SELECT query_id, candidate_id, bm25_score, dense_score, ql::INT AS query_length, dl::INT AS doc_length, ql::FLOAT / greatest(dl, 1)::FLOAT AS len_ratio, abs(ql - dl)::INT AS len_diff, qc AS query_citation_num, qg AS query_fragment_num, dr AS doc_reference_num,
    dc::FLOAT / greatest(dl, 1)::FLOAT AS doc_citation_ratio, qy AS query_year, dy AS doc_year, CASE WHEN qy = -1 OR dy = -1 THEN 0 ELSE qy - dy END AS year_diff,
    row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, candidate_id)::INT AS bm25_rank, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, candidate_id)::INT AS dense_rank FROM j""",
    "cases", "pred",
)
def ltr_features(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d, "clean_text", "year", *features.COUNTS)
    attributes = c.select("case_id", "year", *features.COUNTS, lexical.analyzed_length(F.col("clean_text")).alias("length"))
    pairs = predictions(spark, d).select("query_id", "candidate_id", "bm25_score", "qld_score", "bm25_ngram_score", "dense_score")
    out = features.feature_frame(pairs, attributes)
    kept = ["query_id", "candidate_id", "bm25_score", "dense_score", "query_length", "doc_length", "len_diff", "query_citation_num", "query_fragment_num", "doc_reference_num", "query_year", "doc_year", "year_diff", "bm25_rank", "dense_rank", "len_ratio", "doc_citation_ratio"]
    return out.select(*kept)


@query("SELECT p.query_id, p.candidate_id, (q.query_id IS NOT NULL)::TINYINT AS label FROM pred p LEFT JOIN qrels q USING (query_id, candidate_id)", "pred", "qrels")
def labelled_pairs(spark: SparkSession, d: str) -> DataFrame:
    return features.with_labels(predictions(spark, d).select("query_id", "candidate_id"), qrels(spark, d))


# --- training data -----------------------------------------------------------------------------------------------


@query(
    "SELECT query_id, CASE WHEN r <= floor(n * 0.8) THEN 'train' ELSE 'valid' END AS split FROM (SELECT query_id, row_number() OVER (ORDER BY md5('42|' || query_id), query_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT query_id FROM qrels))",
    "qrels",
)
def split_hash(spark: SparkSession, d: str) -> DataFrame:
    return sampling.split_queries(qrels(spark, d))


_POOL = "SELECT p.query_id, p.candidate_id, p.rk FROM pred p ANTI JOIN qrels q USING (query_id, candidate_id) WHERE p.rk <= 100"


def _run(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank_by_candidate(predictions(spark, d), "rank_score")


@query(f"SELECT q.query_id, q.candidate_id AS positive_id, list(n.candidate_id ORDER BY n.rk)[1:15] AS negative_ids FROM qrels q JOIN ({_POOL}) n USING (query_id) GROUP BY 1, 2 HAVING count(*) >= 15", "pred", "qrels")
def hard_neg_first15(spark: SparkSession, d: str) -> DataFrame:
    return sampling.hard_negatives(_run(spark, d), qrels(spark, d))


@query(
    f"""SELECT query_id, positive_id, list(candidate_id ORDER BY h, candidate_id)[1:15] AS negative_ids FROM (SELECT q.query_id, q.candidate_id AS positive_id, n.candidate_id,
    md5(concat_ws('|', '289', q.query_id, q.candidate_id, n.candidate_id)) AS h FROM qrels q JOIN ({_POOL}) n USING (query_id)) GROUP BY 1, 2 HAVING count(*) >= 15""",
    "pred", "qrels",
)
def hard_neg_hash15(spark: SparkSession, d: str) -> DataFrame:
    return sampling.hard_negatives(_run(spark, d), qrels(spark, d), seed=289)


_DRAW = "('0x' || substr(md5(concat_ws('|', {}, query_id, positive_id, i)), 1, 13))::BIGINT"


@query(
    f"""SELECT query_id, positive_id, CASE WHEN len(l) >= 15 THEN l[1:15] ELSE list_transform(range(1, 16), lambda i: l[({_DRAW.format("'42'")} % len(l)) + 1]) END AS negative_ids
    FROM (SELECT query_id, positive_id, list(candidate_id ORDER BY h, candidate_id) AS l FROM (SELECT q.query_id, q.candidate_id AS positive_id, n.candidate_id, md5(concat_ws('|', '42', q.query_id, q.candidate_id, n.candidate_id)) AS h
    FROM qrels q JOIN (SELECT query_id, candidate_id FROM pred ANTI JOIN qrels USING (query_id, candidate_id)) n USING (query_id)) GROUP BY 1, 2)""",
    "pred", "qrels",
)
def random_neg(spark: SparkSession, d: str) -> DataFrame:
    return sampling.random_negatives(predictions(spark, d), qrels(spark, d))


_GUMBEL = f"""SELECT query_id, positive_id, list(candidate_id ORDER BY g DESC, candidate_id)[1:15] AS negative_ids FROM (SELECT q.query_id, q.candidate_id AS positive_id, n.candidate_id,
round(n.s - ln(-ln((('0x' || substr(md5(concat_ws('|', '{42 * 1_000_003}', q.query_id, q.candidate_id, n.candidate_id)), 1, 13))::BIGINT + 0.5) / 4503599627370496)), 9) AS g
FROM qrels q JOIN (SELECT query_id, candidate_id, dense_score::DOUBLE AS s FROM pred ANTI JOIN qrels USING (query_id, candidate_id) WHERE dense_score IS NOT NULL AND NOT isnan(dense_score) AND query_id <> candidate_id) n USING (query_id))
GROUP BY 1, 2 HAVING count(*) >= 15"""


def _adaptive(spark: SparkSession, d: str) -> DataFrame:
    scored = predictions(spark, d).where(~F.isnan("dense_score")).select("query_id", "candidate_id", F.col("dense_score").cast("double").alias("score"))
    return sampling.adaptive_negatives(scored, qrels(spark, d))


@query(_GUMBEL, "pred", "qrels")
def adaptive_neg(spark: SparkSession, d: str) -> DataFrame:
    """Of queries with at least 15 candidates, as its SQL says; ``adaptive_neg_all`` has those with fewer too."""
    return _adaptive(spark, d).where(F.size(F.array_distinct("negative_ids")) == 15)


@query(
    f"""SELECT query_id, positive_id, CASE WHEN len(l) >= 15 THEN l[1:15] ELSE list_transform(range(1, 16), lambda i: l[len(list_filter(c, lambda x: x < ({_DRAW.format("'42:0'")} + 0.5) / 4503599627370496 * c[-1])) + 1]) END AS negative_ids
    FROM (SELECT query_id, positive_id, l, list_transform(range(1, len(w) + 1), lambda i: list_sum(w[1:i])) AS c FROM (SELECT query_id, positive_id, l, list_transform(s, lambda x: exp(x - list_max(s))) AS w
    FROM (SELECT query_id, positive_id, list(candidate_id ORDER BY g DESC, candidate_id) AS l, list(s ORDER BY g DESC, candidate_id) AS s FROM (SELECT q.query_id, q.candidate_id AS positive_id, n.candidate_id, n.s,
    round(n.s - ln(-ln((('0x' || substr(md5(concat_ws('|', '{42 * 1_000_003}', q.query_id, q.candidate_id, n.candidate_id)), 1, 13))::BIGINT + 0.5) / 4503599627370496)), 9) AS g
    FROM qrels q JOIN (SELECT query_id, candidate_id, dense_score::DOUBLE AS s FROM pred ANTI JOIN qrels USING (query_id, candidate_id) WHERE dense_score IS NOT NULL AND NOT isnan(dense_score) AND query_id <> candidate_id) n USING (query_id)) GROUP BY 1, 2)))""",
    "pred", "qrels",
)
def adaptive_neg_all(spark: SparkSession, d: str) -> DataFrame:
    """Of every query with a candidate; those with fewer than 15 draw with replacement."""
    return _adaptive(spark, d)


_BODY = 126


@query(
    f"""SELECT seq_id, md5(array_to_string(list(tok ORDER BY place), ',')) AS digest FROM (SELECT (start + i - 1) // {_BODY} AS seq_id, start + i - 1 AS place, t[i] AS tok
    FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM (SELECT t, (sum(len(t)) OVER (ORDER BY doc_id) - len(t))::BIGINT AS start FROM (SELECT doc_id, {_TOKENS.format('"text"')} AS t FROM documents)))) GROUP BY 1 HAVING count(*) = {_BODY}"""
)
def pack_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Words stand for tokens; a sequence is shown by the digest of its body."""
    docs = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("ids"))
    packed = sampling.pack_tokens(docs, "ids", "doc_id", _BODY + 2, "[CLS]", "[SEP]", "[PAD]")
    return packed.select("seq_id", F.md5(F.array_join(F.slice("input_ids", 2, _BODY), ",")).alias("digest"))


_LENGTHS = f"SELECT len({_TOKENS.format(chr(34) + 'text' + chr(34))}) AS n FROM documents"


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.size(text.tokens(F.col("text"))).alias("n"))


@query(
    f"""SELECT docs, sampled, round(avg_tokens, 6) AS avg_tokens, median_tokens, min_tokens, max_tokens, round(avg_tokens * docs, 3) AS estimated_tokens, greatest(floor(avg_tokens * docs / 510), 1)::BIGINT AS estimated_sequences
    FROM (SELECT count(*) AS docs, count(*) FILTER (n > 0) AS sampled, avg(n) FILTER (n > 0) AS avg_tokens, median(n) FILTER (n > 0) AS median_tokens, min(n) FILTER (n > 0) AS min_tokens, max(n) FILTER (n > 0) AS max_tokens FROM ({_LENGTHS}))"""
)
def packed_length(spark: SparkSession, d: str) -> DataFrame:
    return sampling.packed_length(_lengths(spark, d), "n").withColumns({"avg_tokens": F.round("avg_tokens", 6), "estimated_tokens": F.round("estimated_tokens", 3)})


@query(
    """SELECT path, step, value FROM (SELECT user_id::VARCHAR AS path, max(event_id) AS step, round(arg_max(value, event_id), 6) AS value FROM events WHERE user_id IS NOT NULL GROUP BY 1 HAVING arg_max(value, event_id) IS NOT NULL)
    ORDER BY value DESC, path LIMIT 1"""
)
def best_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """A user's events stand for the log of a checkpoint, whose step is the last of them."""
    entry = F.create_map(F.lit("step"), F.col("event_id").cast("string"), F.lit("score"), F.round("value", 6).cast("string"))
    states = table(spark, d, "events").where("user_id is not null").groupBy(F.col("user_id").cast("string").alias("path")).agg(F.max("event_id").alias("global_step"), F.collect_list(entry).alias("log_history"))
    return sampling.best_checkpoint(states, "score")


# --- statistics --------------------------------------------------------------------------------------------------


@query(
    """SELECT count(*) AS queries, sum(n)::BIGINT AS pairs, round(avg(n), 6) AS mean_labels, max(n) AS most, arg_max(query_id, {'n': n, 'p': -p}) AS most_query, min(n) AS fewest, arg_min(query_id, {'n': n, 'p': p}) AS fewest_query
    FROM (SELECT q.query_id, count(*) AS n, any_value(p) AS p FROM qrels q JOIN (SELECT query_id, row_number() OVER (ORDER BY query_id) AS p FROM (SELECT DISTINCT query_id FROM qrels)) USING (query_id) GROUP BY 1)""",
    "qrels",
)
def label_stats(spark: SparkSession, d: str) -> DataFrame:
    q = qrels(spark, d)
    placed = ranking.positions_of(q.select("query_id").distinct(), [F.col("query_id")])
    return statistics.label_statistics(q.join(placed, "query_id")).withColumn("mean_labels", F.round("mean_labels", 6))


@query("SELECT n AS value, count(*) AS count FROM (SELECT query_id, count(*) AS n FROM qrels GROUP BY 1) GROUP BY 1", "qrels")
def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    return statistics.label_distribution(qrels(spark, d))


@query(
    f"SELECT t::INT AS threshold, count(*) FILTER (n > t) AS over, round(count(*) FILTER (n > t) / count(*), 6) AS share, round(avg(n), 6) AS mean FROM ({_LENGTHS}), (SELECT unnest([0, 1024, 2048, 4096, 6144, 8192, 12288]) AS t) GROUP BY 1"
)
def token_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return statistics.token_thresholds(_lengths(spark, d), "n").select("threshold", "over", r6("share"), r6("mean"))


@query(f"SELECT b::INT AS bin, (b * 513)::INT AS low, count(n) AS count FROM (SELECT unnest(range(0, 20)) AS b) LEFT JOIN (SELECT n FROM ({_LENGTHS}) WHERE n <= 10000) ON n // 513 = b GROUP BY 1, 2")
def token_hist(spark: SparkSession, d: str) -> DataFrame:
    return statistics.histogram(_lengths(spark, d), "n")


@query(f"SELECT round(avg(n), 6) AS mean, min(n)::INT AS min, max(n)::INT AS max, round(greatest(0, avg(n) - 5 * stddev_pop(n)), 4) AS range_low, round(avg(n) + 5 * stddev_pop(n), 4) AS range_high FROM ({_LENGTHS})")
def length_summary(spark: SparkSession, d: str) -> DataFrame:
    return statistics.length_summary(_lengths(spark, d), "n").select(r6("mean"), "min", "max", F.round("range_low", 4).alias("range_low"), F.round("range_high", 4).alias("range_high"))


@query("SELECT query_id, count(*) AS size, min(rk)::INT AS first FROM pred GROUP BY 1", "pred")
def group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return statistics.group_sizes(_run(spark, d), "query_id", "rank")


@query(
    """SELECT right('000' || c::VARCHAR, 3) AS query_id, right('000' || c::VARCHAR, 3) || right('000' || p::VARCHAR, 3) AS candidate_id, (y IS NOT NULL)::INT AS label FROM
    (SELECT DISTINCT l_orderkey % 1000 AS c, l_linenumber AS p, max(CASE WHEN l_returnflag = 'R' THEN 1 END) OVER (PARTITION BY l_orderkey % 1000, l_linenumber) AS y, max(CASE WHEN l_returnflag = 'R' THEN 1 END) OVER (PARTITION BY l_orderkey % 1000) AS any_y FROM lineitem) WHERE any_y IS NOT NULL"""
)
def task2_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the same last three digits stand for a case, as its SQL says; ``task2_flatten_all`` has a case for each order."""
    return _flatten(table(spark, d, "lineitem").withColumn("l_orderkey", F.pmod("l_orderkey", F.lit(1000))))


def _flatten(lines: DataFrame) -> DataFrame:
    """An order stands for a case, its lines for paragraphs, returned ones for entailing ones."""
    lines = lines.select(F.col("l_orderkey").cast("string").alias("query_id"), F.col("l_linenumber").cast("string").alias("par_id"), "l_returnflag")
    heads = lines.select("query_id").distinct().withColumn("text", F.lit("fragment"))
    return statistics.flatten_paragraphs(heads, lines, lines.where("l_returnflag = 'R'"))[0]


@query(
    f"""SELECT q AS query_id, q || {_pad("p", 3)} AS candidate_id, label FROM (SELECT {_pad("l_orderkey::VARCHAR", 3)} AS q, l_linenumber::VARCHAR AS p, max((l_returnflag = 'R')::INT) AS label FROM lineitem GROUP BY 1, 2)
    WHERE q IN (SELECT {_pad("l_orderkey::VARCHAR", 3)} FROM lineitem WHERE l_returnflag = 'R')"""
)
def task2_flatten_all(spark: SparkSession, d: str) -> DataFrame:
    return _flatten(table(spark, d, "lineitem"))
