"""Inverted index and lexical scores: BM25, query likelihood with Dirichlet smoothing, and word n-grams.

The index is three tables. Only postings of query terms are joined; the collection's figures are one row. Document
lengths are exact, where the usual engine rounds them to a byte.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.text import ngrams, tokens
from caseloom.operators.lexical_kernel import DOCS, QUERIES, TERMS, part_scores
from caseloom.operators.ranking import rank_by_candidate
from caseloom.plans.tables import ship, written

#: Words and documents of one part of ``bm25_search``, about.
PART_WORDS, PART_DOCS = 6_000_000, 24_000


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # term, doc_id, tf, dl
    terms: DataFrame  # term, df, cf
    docs: int
    total_tokens: int

    @property
    def average_length(self) -> float:
        return self.total_tokens / self.docs if self.docs else 0.0


def _units(words: DataFrame, n: int) -> DataFrame:
    """Adds _u, the words or runs of n words of _w. A row's words are made once, before the lambda that slices them."""
    return words.withColumn("_u", ngrams(F.col("_w"), n) if n > 1 else F.col("_w"))


def build_index(docs: DataFrame, doc_id: str, text: str, n: int = 1, stopwords: tuple[str, ...] = (), analyze: Callable[[Column], Column] | None = None) -> Index:
    """Index over words, or over runs of n words. Every document counts, also those without any word; null texts are empty.
    ``analyze`` makes the words of a text; ``analyzer.english_tokens`` stems and drops stop words.

    Postings are written once and read by all scorers.
    """
    listed = _units(docs.select(F.col(doc_id).alias("doc_id"), _words(text, stopwords, analyze)), n)
    counted = listed.select("doc_id", F.size("_u").alias("dl"), F.explode("_u").alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    postings = written(counted, "postings")
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    return Index(postings, terms, docs.count(), postings.agg(F.sum("tf")).first()[0] or 0)


def _words(text: str, stopwords: tuple[str, ...], analyze: Callable[[Column], Column] | None) -> Column:
    return (analyze(F.col(text)) if analyze else tokens(F.col(text), stopwords)).alias("_w")


def query_terms(queries: DataFrame, query_id: str, text: str, n: int = 1, stopwords: tuple[str, ...] = (), analyze: Callable[[Column], Column] | None = None) -> DataFrame:
    """(query_id, term, qtf)"""
    listed = _units(queries.select(F.col(query_id).alias("query_id"), _words(text, stopwords, analyze)), n)
    return listed.select("query_id", F.explode("_u").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def _idf(docs: int) -> Column:
    return F.log(1 + (F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))


def bm25(index: Index, k1: float, b: float) -> Column:
    idf = _idf(index.docs)
    length = 1 - b + b * F.col("dl") / F.lit(max(index.average_length, 1e-9))
    return F.col("qtf") * idf * F.col("tf") / (F.col("tf") + k1 * length)


def dirichlet(index: Index, mu: float) -> Column:
    p = (F.col("cf") + 1.0) / (index.total_tokens + 1.0)
    return F.col("qtf") * F.greatest(F.lit(0.0), F.log(1 + F.col("tf") / (mu * p)) + F.log(mu / (F.col("dl") + mu)))


def lexical_scores(index: Index, terms: DataFrame, score: Column) -> DataFrame:
    """(query_id, candidate_id, score) of every document that shares a term with the query."""
    joined = terms.join(index.terms, "term").join(index.postings, "term")
    return joined.groupBy("query_id", F.col("doc_id").alias("candidate_id")).agg(F.sum(score).alias("score"))


def lexical_search(index: Index, terms: DataFrame, score: Column, k: int, decimals: int | None = None) -> DataFrame:
    """The k best documents of each query with rank; k is held between 1 and the number of documents.

    ``decimals`` rounds scores before they are ranked, so that the order of addition can't turn ties.
    """
    scored = lexical_scores(index, terms, score)
    if decimals is not None:
        scored = scored.withColumn("score", F.round("score", decimals))
    return rank_by_candidate(scored, "score", k=min(max(k, 1), max(index.docs, 1)))


def bm25_search(docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query_text: str, k1: float, b: float, k: int, decimals: int | None = None) -> DataFrame:
    """``lexical_search`` with ``bm25`` for many or long queries, without a row for each posting that a query meets.

    Documents are dealt to parts as lists of hashed words, and all queries pass by each part in a task of its own, which leaves k rows
    a query. Work is that of a matrix product of queries and documents; what is shuffled is the documents once and the queries once a
    part. Hashes are 64 bits of a seed under which all words differ. Ids are unique.
    """
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(F.col(doc_id).cast("string").alias("id"), tokens(F.col(text)).alias("_w"))
    q = queries.select(F.col(query_id).cast("string").alias("id"), tokens(F.col(query_text)).alias("_w"))
    distinct = lambda df, own, asked: df.select(F.size("_w").alias("_n"), F.array_distinct("_w").alias("_w")).select("_n", F.posexplode("_w").alias("_at", "term")).select(
        "term", F.lit(own).alias("df"), F.lit(asked).alias("asked"), (F.when(F.col("_at") == 0, F.col("_n")).otherwise(0) * own).alias("words")
    )
    terms = distinct(d, 1, 0).unionByName(distinct(q, 0, 1)).groupBy("term").agg(F.sum("df").alias("df"), F.max("asked").alias("asked"), F.sum("words").alias("words"))
    terms, n = written(terms, "terms"), docs.count()
    seed, hashed = 0, lambda term: F.xxhash64(F.lit(seed), term)
    while (r := terms.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(hashed(F.col("term"))).alias("hashes"), F.sum("words").alias("words")).first()).n > r.hashes:
        seed += 1
    words = r.words or 0
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-words // PART_WORDS), -(-n // PART_DOCS))
    listed = lambda df, kind, part: df.select(F.lit(kind).alias("kind"), "id", F.sort_array(F.transform("_w", hashed)).alias("terms"), F.lit(None).cast("double").alias("idf"), part.alias("_p"))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    known = terms.where("asked = 1 and df > 0").select(F.lit(TERMS).alias("kind"), F.lit(None).cast("string").alias("id"), F.array(hashed(F.col("term"))).alias("terms"), _idf(n).alias("idf"), every.alias("_p"))
    rows = known.unionByName(listed(d, DOCS, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))).unionByName(listed(q, QUERIES, every))
    k = min(max(k, 1), max(n, 1))
    dealt = rows.repartitionById(parts, "_p").sortWithinPartitions("kind").select("kind", "id", "terms", "idf")
    scored = dealt.mapInArrow(part_scores(k, k1, b, max(words / n if n else 0.0, 1e-9), decimals), "query_id string, candidate_id string, score double")
    if decimals is not None:
        scored = scored.withColumn("score", F.round("score", decimals))
    return rank_by_candidate(scored, "score", k=k)


def pair_scores(pairs: DataFrame, scores: DataFrame, name: str, default: float = 0.0) -> DataFrame:
    """pairs with a score column; pairs that have none get the default."""
    found = scores.select("query_id", "candidate_id", F.col("score").alias(name))
    return pairs.join(found, ["query_id", "candidate_id"], "left").withColumn(name, F.coalesce(name, F.lit(default)))


def analyzed_length(c: Column, stopwords: tuple[str, ...] = ()) -> Column:
    return F.size(tokens(c, stopwords))
