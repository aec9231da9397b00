"""Per-document text quality statistics and how far they lie from running prose (problem 8).

Each document gets STATISTICS (see ``prose_kernel``). The common words they count are the corpus's own: the words that the
most documents of a declared language have. For each language, the mean and covariance of prose over all statistics are estimated from all
its documents, robustly: the documents nearest to the medians are a first core, concentration steps replace it by those nearest
in Mahalanobis distance, and reweighting steps by all that lie within the cutoff. A document's distance is that to the prose of the language
that it is nearest to; it is the sum of one contribution for each statistic, c_j = (x - m)_j (S^-1 (x - m))_j.

A document is no prose if its squared distance is beyond the cutoff: the split of the logarithms of all distances into two
classes of the largest variance between them (Otsu), but at least the 0.999 quantile of chi-squared. No statistic has a
threshold of its own. S has RIDGE times the squared spread of all documents added, and RESOLUTION at least, only so that it isn't singular.

Passes over the documents add up moments by language and by bin of the logarithm of the distance, so one pass gives both the quantile that
bounds a core and the core's mean and covariance; what reaches the driver are BINS rows for each language.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.prose_kernel import SHAPE, STATISTICS, statistics, vocabulary
from caseloom.plans.tables import small, spread, written

#: Documents of a language from which its own prose is estimated. A rarer one is compared in SHAPE with the prose of all.
ENOUGH = 40
#: Common words of a language, at most, and the least share of its documents that have each.
COMMON, COMMON_SHARE = 100, 0.05
#: Share of a language's documents in its first core; concentration and reweighting steps.
CORE, CONCENTRATIONS, REWEIGHTINGS = 0.75, 4, 3
RIDGE = 0.05
#: Differences of each statistic that mean nothing in a text of a few hundred characters; they keep S regular where prose is all alike.
RESOLUTION = np.array([0.1, 0.1, 0.01, 0.01, 0.03, 0.02, 0.1, 0.1])
#: Squared distance: the 0.999 quantile of chi-squared with 8 degrees of freedom.
LEAST_CUTOFF = 26.12
#: Bins of the logarithm of the squared distance, from LOWEST on, 20 to a unit.
BINS, LOWEST, FINE = 500, -5.0, 20
_P = len(STATISTICS)
_PAIRS = np.triu_indices(_P)
_SHAPE = [STATISTICS.index(s) for s in SHAPE]
Models = dict[str, tuple[np.ndarray, np.ndarray]]


def declared(lang: Column) -> Column:
    """The first two letters of a language code in small letters, so that spellings agree; "" for none and for undetermined."""
    code = F.coalesce(F.substring(F.lower(F.trim(lang)), 1, 2), F.lit(""))
    return F.when(code == "un", "").otherwise(code)


def common_words(df: DataFrame, text: str, lang: str) -> dict[str, tuple[str, ...]]:
    """Languages by common word: the COMMON words in the most documents of each declared language of ENOUGH documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter[str]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for language, found in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(found)), pa.array(list(found)), pa.array(list(found.values()), pa.int64())], ["language", "word", "n"])
            seen.clear()

        for batch in batches:
            for language, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = seen.setdefault(language, Counter())
                own.update(vocabulary(t))
                own[""] += 1  # the documents themselves
            if sum(map(len, seen.values())) > 300_000:
                yield from flushed()
        yield from flushed()

    rows = df.where(F.col(text).isNotNull()).select(declared(F.col(lang)).alias("language"), F.col(text).alias("text")).where("language != ''")
    counts = spread(rows).mapInArrow(count, "language string, word string, n long").groupBy("language", "word").agg(F.sum("n").alias("n"))
    counts = written(counts, "word-counts")
    sizes = counts.where(f"word = '' and n >= {ENOUGH}").select("language", F.col("n").alias("documents"))  # one row for each language
    frequent = counts.where("word != ''").join(small(sizes, sizes.count(), 20), "language").where(f"n >= {COMMON_SHARE} * documents")
    # of these a language has no more than the words of a document divided by the share
    place = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "word"))
    best = frequent.withColumn("place", place).where(f"place <= {COMMON}")
    out: dict[str, tuple[str, ...]] = {}
    for row in best.orderBy("language", "place").select("language", "word").collect():  # COMMON rows for each language
        out[row.word] = (*out.get(row.word, ()), row.language)
    return out


def document_statistics(df: DataFrame, keys: list[str], text: str, lang: str) -> DataFrame:
    """(keys, language, STATISTICS) of rows whose text has a visible character; null and blank texts give no row, repeated rows give their own.

    The language is the one whose common words the text has most of; a text of none has the declared one if that is too rare for common words.
    """
    speaking = common_words(df, text, lang)
    modelled = {lang for of in speaking.values() for lang in of}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist())
            found = [(i, s[0] or (d if d not in modelled else ""), s[1]) for i, (t, d) in enumerate(rows) if (s := statistics(t, speaking))]
            at = pa.array([i for i, _, _ in found], pa.int64())
            values = np.array([v for _, _, v in found]).reshape(-1, _P)
            columns = [batch.column(i).take(at) for i in range(len(keys))] + [pa.array([language for _, language, _ in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(v) for v in values.T], [*keys, "language", *STATISTICS])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    rows = df.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text"), declared(F.col(lang)).alias("_declared"))
    return spread(rows).mapInArrow(run, f"{kinds}, language string, " + ", ".join(f"{s} double" for s in STATISTICS))


def _contributions(x: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Contributions to the squared distance, by row and statistic."""
    d = x - mean
    return d * (d @ inverse)


def _nearest(x: np.ndarray, languages: np.ndarray, models: Models) -> np.ndarray:
    """Contributions to the squared distance from the prose of the nearest language.

    Texts of a language without a model are compared in SHAPE alone, the sum brought to the scale of all statistics.
    """
    out, least = np.zeros_like(x), np.full(len(x), np.inf)
    rare = ~np.isin(languages, ["", *models])
    for mean, inverse in models.values():
        parts = _contributions(x, mean, inverse)
        if rare.any():
            part = np.ix_(_SHAPE, _SHAPE)
            shape = np.linalg.inv(np.linalg.inv(inverse)[part])
            parts[rare] = 0.0
            parts[np.ix_(rare, _SHAPE)] = _contributions(x[np.ix_(rare, _SHAPE)], mean[_SHAPE], shape) * _P / len(SHAPE)
        distance = parts.sum(axis=1)
        nearer = distance < least
        out[nearer], least[nearer] = parts[nearer], distance[nearer]
    return out


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATISTICS])


def _moments(stats: DataFrame, models: Models, own: bool) -> dict[str, np.ndarray]:
    """(BINS, 1 + P + P (P + 1) / 2) by language: number, sums and sums of products of its documents by bin of the log distance,
    which is that to their own language's model or to the nearest one's."""
    names = ["n", *(f"s{i}" for i in range(_P)), *(f"p{i}" for i in range(len(_PAIRS[0])))]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            x, languages = _matrix(batch), np.array(batch.column("language").to_pylist(), object)
            for lang in set(languages.tolist()):
                if own and lang not in models:
                    continue
                rows = x[languages == lang]
                parts = _contributions(rows, *models[lang]) if own else _nearest(rows, np.full(len(rows), lang, object), models)
                at = np.clip((np.log(np.maximum(parts.sum(axis=1), 1e-9)) - LOWEST) * FINE, 0, BINS - 1).astype(int)
                values = np.column_stack([np.ones(len(rows)), rows, rows[:, _PAIRS[0]] * rows[:, _PAIRS[1]]])
                np.add.at(total.setdefault(lang, np.zeros((BINS, len(names)))), at, values)
        for lang, sums in total.items():
            at = np.flatnonzero(sums[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), *(pa.array(c) for c in sums[at].T)], ["language", "bin", *names])

    partial = stats.select("language", *STATISTICS).mapInArrow(add, "language string, bin int, " + ", ".join(f"{c} double" for c in names))
    out: dict[str, np.ndarray] = {}
    for row in partial.groupBy("language", "bin").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out.setdefault(row.language, np.zeros((BINS, len(names))))[row.bin] = row[2:]
    return out


def _model(sums: np.ndarray, ridge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and inverse covariance of prose from the sums over a core."""
    n, mean = sums[0], sums[1 : 1 + _P] / sums[0]
    cov = np.zeros((_P, _P))
    cov[_PAIRS] = sums[1 + _P :] / n
    cov = cov + np.triu(cov, 1).T - np.outer(mean, mean)
    return mean, np.linalg.inv(cov + np.diag(ridge))


def _split(counts: np.ndarray) -> float:
    """Squared distance at the split of the binned log distances into two classes with the largest variance between them."""
    n, at = counts.sum(), np.arange(BINS)
    below, mass = np.cumsum(counts), np.cumsum(counts * at)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below / n * (1 - below / n) * (mass / below - (mass[-1] - mass) / (n - below)) ** 2
    between = np.nan_to_num(between, nan=0.0, posinf=0.0)
    # empty bins between the classes tie: the middle of them
    return float(np.exp(LOWEST + (np.flatnonzero(between >= between.max() * (1 - 1e-12)).mean() + 1) / FINE))


def prose_models(stats: DataFrame) -> tuple[Models, float]:
    """Mean and inverse covariance of prose by language (only for "" where no language has ENOUGH documents), and the cutoff."""
    percentiles = [F.percentile_approx(s, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(1000)).alias(s) for s in STATISTICS]
    spreads = [F.stddev_pop(s).alias(f"sd_{s}") for s in STATISTICS]
    rows = stats.rollup("language").agg(F.grouping("language").alias("whole"), F.count(F.lit(1)).alias("n"), *percentiles, *spreads).collect()
    whole = next((r for r in rows if r.whole), None)
    if whole is None or not whole.n:
        return {}, LEAST_CUTOFF
    scale = np.array([max((whole[s][2] - whole[s][0]) / 1.349, 0.1 * whole[f"sd_{s}"], 1e-6) for s in STATISTICS]) ** 2
    ridge = np.maximum(RIDGE * scale, RESOLUTION**2)
    usable = [r for r in rows if not r.whole and r.language and r.n >= ENOUGH]
    if not usable:
        stats, usable = stats.withColumn("language", F.lit("")), [whole]
    models = {("" if r.whole else r.language): (np.array([r[s][1] for s in STATISTICS]), np.diag(1 / np.maximum(scale, RESOLUTION**2))) for r in usable}
    for _ in range(CONCENTRATIONS):
        for lang, sums in _moments(stats, models, True).items():
            below = np.cumsum(sums[:, 0])
            models[lang] = _model(sums[: np.searchsorted(below, CORE * below[-1]) + 1].sum(axis=0), ridge)
    cutoff = LEAST_CUTOFF
    for step in range(REWEIGHTINGS + 1):
        moments = _moments(stats, models, False)
        cutoff = max(LEAST_CUTOFF, _split(sum(m[:, 0] for m in moments.values())))
        if step < REWEIGHTINGS:
            last = math.ceil((math.log(cutoff) - LOWEST) * FINE)
            cores = {lang: moments[lang][:last].sum(axis=0) for lang in models if lang in moments}
            models |= {lang: _model(core, ridge) for lang, core in cores.items() if core[0] >= _P}
    return models, cutoff


def _scored(stats: DataFrame, models: Models, cutoff: float) -> DataFrame:
    """Adds the squared distance, each statistic's contribution and whether the document is no prose."""
    parts = [f"of_{s}" for s in STATISTICS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _nearest(_matrix(batch), np.array(batch.column("language").to_pylist(), object) if set(models) != {""} else np.full(batch.num_rows, "", object), models)
            distance = out.sum(axis=1)
            new = [pa.array(distance), *(pa.array(c) for c in out.T), pa.array(distance > cutoff)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "distance", *parts, "unprosaic"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema] + ["distance double", *(f"{c} double" for c in parts), "unprosaic boolean"]
    return stats.mapInArrow(run, ", ".join(kinds))


def text_quality(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(key, language, STATISTICS, distance, of_STATISTIC..., unprosaic) of every row whose text has a visible character."""
    stats = written(document_statistics(df, [key], text, lang), "statistics")
    return _scored(stats, *prose_models(stats))
