"""Tables, the shared folder, and the current row of a key."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_SHIPPED: set[str] = set()
_WRITTEN: list[str] = []


def ship(spark: SparkSession) -> None:
    """Makes this package importable for the executors' Python, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="caseloom-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="caseloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends or by ``discard``."""
    path = f"{shared_dir(spark)}/caseloom-{name}-{uuid.uuid4().hex[:12]}"
    if not _WRITTEN:
        atexit.register(lambda: discard(spark))
    _WRITTEN.append(path)
    return path


def discard(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables written in this session from the ``since``-th on; for long sessions, once their results are used.

    ``len(written_paths())`` before a query says where its own begin.
    """
    while len(_WRITTEN) > since:
        _delete(spark, _WRITTEN.pop())


def written_paths() -> tuple[str, ...]:
    return tuple(_WRITTEN)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; the folder's owner clears it
        pass


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows of df as a table in the shared folder, read again: lineage ends here and lost executors don't matter."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def threshold_bytes(spark: SparkSession) -> int:
    """The session's broadcast limit in bytes; below 0: never."""
    return int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if so many rows stay under the session's limit; else Spark shuffles it."""
    return F.broadcast(df) if rows * row_bytes <= threshold_bytes(df.sparkSession) else df


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: a small file is one partition, but costly work waits on it."""
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def current_rows(df: DataFrame, key: str, order: str, payload: list[str]) -> DataFrame:
    """(key, payload) of the row with the latest ``order`` of each key; rows of no key are left out.

    A null ``order`` is earlier than any other. Of rows with the same ``order`` the one with the largest hash of
    the payload counts (equal rows are one). Only keys with several rows are shuffled: their latest ``order`` comes
    from the two narrow columns and is broadcast under the session's limit, or joined by shuffle beyond it.
    """
    if not payload:
        return df.where(F.col(key).isNotNull()).select(key).distinct()
    df = df.where(F.col(key).isNotNull()).select(*dict.fromkeys([key, order, *payload]))  # other columns can't clash
    many = (
        df.groupBy(F.col(key).alias("_key"))
        .agg(F.count(F.lit(1)).alias("_n"), F.max(order).alias("_latest"))
        .where("_n > 1")
        .select("_key", "_latest")
    )
    many = written(many, "many-rows")
    side = small(many, many.count(), 100)
    joined = df.join(side, F.col(key) == F.col("_key"), "left")
    single = joined.where(F.col("_key").isNull()).select(key, *payload)
    narrow = joined.where(F.col("_key").isNotNull() & F.col(order).eqNullSafe(F.col("_latest"))).select(key, *payload)
    packed = F.struct(F.xxhash64(*payload).alias("_h"), *[F.col(c) for c in payload])
    chosen = narrow.groupBy(key).agg(F.max(packed).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in payload])
    return single.unionByName(chosen)


def column_or(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default
