"""Boundaries to models: batch encoders, pair scorers, and rankers over the feature frame.

Encoders and scorers are callables the user brings; they run in Arrow batches inside tasks and are made once for each
task. No ranking ensemble ships with Spark, so ``Ranker`` has a pairwise logistic and a boosted-tree fit; their scores
are not those of a list-wise ensemble.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.ranking import rank_by_candidate
from caseloom.plans.tables import spread

Encoder = Callable[[list[str]], np.ndarray]


def encode_texts(df: DataFrame, key: str, text: str, make_encoder: Callable[[], Encoder], batch_size: int = 64, normalize: bool = False) -> DataFrame:
    """(key, embedding): vectors of texts; a null text is encoded as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                vectors = np.asarray(encode([t or "" for t in part.column(1).to_pylist()]), np.float32)
                if normalize:
                    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                offsets = pa.array(np.arange(0, vectors.size + 1, vectors.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))], [key, "embedding"])

    return spread(df.select(key, F.col(text).alias("_t"))).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, embedding array<float>")


def fuse_chunks(chunks: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """(key, embedding): weighted mean of a key's chunk vectors, at unit length."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    each = chunks.select(key, F.posexplode("embedding").alias("_i", "_x"), w.alias("_w"))
    summed = each.groupBy(key, "_i").agg((F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias("_m"))
    vector = summed.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("_v"))
    norm = F.greatest(F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    return vector.select(key, F.transform("_v", lambda x: (x / norm).cast("float")).alias("embedding"))


def score_pairs(pairs: DataFrame, query: str, passage: str, make_scorer: Callable[[], Callable[[list[tuple[str, str]]], np.ndarray]], short: str | None = None, least_words: int = 11) -> DataFrame:
    """pairs with a score from a cross-encoder; passages of fewer words than ``least_words`` are replaced by ``short`` if given."""
    names = pairs.schema.names
    text = F.col(passage) if short is None else F.when(F.size(F.split(F.trim(passage), r"\s+")) < least_words, short).otherwise(F.col(passage))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make_scorer()
        for batch in batches:
            q, p = (batch.column(len(names) + i).to_pylist() for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(np.asarray(score(list(zip(q, p))), np.float64))], [*names, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return spread(pairs.select(*names, F.coalesce(query, F.lit("")).alias("_q"), F.coalesce(text, F.lit("")).alias("_p"))).mapInArrow(run, kinds + ", score double")


class Ranker:
    """Fits the feature frame and predicts scores and ranks."""

    def __init__(self, features: list[str], kind: str = "pairwise", negatives: int = 15, trees: int = 50, depth: int = 5, seed: int = 42) -> None:
        if kind not in ("pairwise", "trees"):
            raise ValueError("kind must be 'pairwise' or 'trees'")
        self.features, self.kind, self.negatives, self.trees, self.depth, self.seed = features, kind, negatives, trees, depth, seed
        self.model = None

    def _frame(self, df: DataFrame) -> DataFrame:
        filled = df.withColumns({c: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c)), F.lit(0)).cast("double") for c in self.features})
        return VectorAssembler(inputCols=self.features, outputCol="_x").transform(filled)

    def fit(self, df: DataFrame) -> Ranker:
        """Pairwise: differences between each relevant row and some seeded others of its query, in both directions."""
        frame = self._frame(df).withColumn("label", F.coalesce("label", F.lit(0)).cast("double"))
        if self.kind == "trees":
            self.model = GBTRegressor(featuresCol="_x", labelCol="label", maxIter=self.trees, maxDepth=self.depth, seed=self.seed).fit(frame)
            return self
        rows = frame.select("query_id", "candidate_id", "label", vector_to_array("_x").alias("_a"))
        pos = rows.where("label > 0").select("query_id", F.col("candidate_id").alias("_p"), F.col("_a").alias("_up"))
        # so many negatives of a query meet each of its positives, in seeded order: pairs stay linear in positives
        order = F.xxhash64(F.lit(self.seed), "query_id", "candidate_id")
        first = Window.partitionBy("query_id").orderBy(order, "candidate_id")
        few = rows.where("label <= 0").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= self.negatives)
        neg = few.groupBy("query_id").agg(F.collect_list(F.struct("_r", "_a")).alias("_n"))
        pairs = pos.join(neg, "query_id").select("_up", F.explode("_n").alias("_n")).select(F.zip_with("_up", F.col("_n._a"), lambda a, b: a - b).alias("_d"))
        both = pairs.select(F.explode(F.array(F.struct(F.col("_d").alias("d"), F.lit(1.0).alias("y")), F.struct(F.transform("_d", lambda v: -v).alias("d"), F.lit(0.0).alias("y")))).alias("s")).select("s.*")
        from pyspark.ml.functions import array_to_vector

        self.model = LogisticRegression(featuresCol="x", labelCol="y", fitIntercept=False, regParam=1e-3).fit(both.select(array_to_vector("d").alias("x"), "y"))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """df with pred_score (single precision) and pred_rank."""
        frame = self._frame(df)
        if self.kind == "trees":
            scored = self.model.transform(frame).withColumnRenamed("prediction", "pred_score")
        else:
            weights = F.array(*[F.lit(float(w)) for w in self.model.coefficients.toArray()])
            product = F.zip_with(vector_to_array("_x"), weights, lambda a, b: a * b)
            scored = frame.withColumn("pred_score", F.aggregate(product, F.lit(0.0), lambda s, v: s + v))
        return rank_by_candidate(scored.withColumn("pred_score", F.col("pred_score").cast("float")).drop("_x"), "pred_score", "pred_rank")
