"""New cases as a stream: an addition, not a counterpart of anything in the batch pipeline.

Each row is mapped by the same expressions as in batch; there is no state, so files that arrive late or again give the
rows they would give in batch, and ``current_rows`` picks among them on reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caseloom.operators.features import COUNTS, case_features

SCHEMA = "case_id string, raw_text string, loaded_at timestamp"


def case_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)


def featured(cases: DataFrame) -> DataFrame:
    """(case_id, loaded_at, clean_text, year, year_source, length, counts) of each arriving row."""
    keyed = cases.withColumn("case_id", F.struct("case_id", "loaded_at"))
    out = case_features(keyed, clean=None)
    return out.select("case_id.case_id", "case_id.loaded_at", "clean_text", "year", "year_source", "length", *COUNTS)


def start(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends features of new cases to ``target`` until what is there is read."""
    stream = featured(case_stream(spark, source)).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).outputMode("append").start()
