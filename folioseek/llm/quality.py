"""Quality rules: base counts of each text and robust multivariate outliers.

Counts are turned into five statistics, and for each language and source the
minimum covariance determinant is found by concentration steps: distances by
the current estimate, mean and covariance of the nearest half, and again. Two
starts are refined (median with quartile range, mean with covariance); the one
with the smaller determinant is kept, scaled to be consistent, and reweighted
once. A document whose squared Mahalanobis distance exceeds `cutoff` (40.9: one in
ten million by the chi-squared distribution with 5 degrees of freedom) is an
outlier.

Statistics are whole thousandths, so that sums do not depend on the order of
rows and results are the same on every run. A concentration step is one
aggregation to (cell, distance bin) and a running sum over at most some hundred
bins; nothing grows with a cell. Only built-in expressions are used.

Cases: a null or blank text has no words and fails the base rules; a null
language or source is a value of its own; cells with fewer than `min_rows`
texts are pooled by language, then altogether, and if the pool is still too
small all its texts count as near; repeated rows are judged each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WHITE, saved, small_side, split_words

P = 5
_AXES = range(P)
_PAIRS = [(i, j) for i in _AXES for j in range(i + 1)]
SCALE = 1000
# Least standard deviation per axis: log words, log word length, and roots of
# the shares of symbols, repeated lines and repeated words. Without it an axis
# that is constant in half of the texts would make every other value an outlier.
FLOORS = (0.25, 0.05, 0.05, 0.15, 0.15)
# Quantiles of the chi-squared distribution with 5 degrees of
# freedom, and the share of that with 7 below the second of them.
CHI2_HALF, CHI2_975, SHARE_975 = 4.3515, 12.8325, 0.9240
BINS_PER_DOUBLING = 16


def base_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """Words, symbols, repeated lines and repeated three-word windows of each text.

    Windows are compared by their 64-bit hash inside one text.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
    rows = docs.select(*keep, text.alias("text")).select(
        *keep,
        split_words(F.col("text")).alias("words"),
        lines.alias("lines"),
        F.length(F.translate("text", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", "")))
        .cast("long")
        .alias("n_symbols"),
    )
    n = F.size("words")
    window_hash = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(
            F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)
        ),
    )
    rows = rows.select(
        *keep,
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, window_hash).alias("hashes"),
    )
    by_hash = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    rows = rows.withColumn("sorted", F.when(repeats, by_hash)).drop("hashes")

    def hash_at(j: Column) -> Column:
        return F.get("sorted", j)["h"]

    twice = F.filter(
        "sorted",
        lambda e, j: F.coalesce(e["h"] == hash_at(j - 1), F.lit(False))
        | F.coalesce(e["h"] == hash_at(j + 1), F.lit(False)),
    )
    covered = F.flatten(
        F.transform(twice, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2))
    )
    return rows.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        F.coalesce(F.size(F.array_distinct(covered)), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _statistics() -> list[Column]:
    """The transformed statistics as whole thousandths."""
    words = F.greatest("n_words", F.lit(1))
    chars = F.greatest("word_chars", F.lit(1))
    lines = F.greatest("n_lines", F.lit(1))
    values = (
        F.log1p("n_words"),
        F.log(chars / words),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / lines),
        F.sqrt(F.col("n_repeat_words") / words),
    )
    return [F.round(v * SCALE).cast("long").alias(f"x{i}") for i, v in enumerate(values)]


def _cells(rows: DataFrame, min_rows: int) -> DataFrame:
    """Add `cell`: language and source, or a pool of those that are too small."""
    lang, source = F.coalesce("lang", F.lit("\x01")), F.coalesce("source", F.lit("\x01"))
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") < min_rows
    of_lang = sizes.filter(small).groupBy("lang").agg(F.sum("n").alias("n_lang"))
    cell = (
        F.when(~small, F.concat(F.lit("cell:"), lang, F.lit("\x02"), source))
        .when(F.col("n_lang") >= min_rows, F.concat(F.lit("lang:"), lang))
        .otherwise(F.lit("rest"))
    )
    named = (
        sizes.join(of_lang.withColumnRenamed("lang", "lang_"), F.col("lang").eqNullSafe(F.col("lang_")), "left")
        .select(F.col("lang").alias("lang_"), F.col("source").alias("source_"), cell.alias("cell"))
    )
    same = F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_"))
    return rows.join(small_side(saved(named, "names")), same, "left").drop("lang_", "source_")


def _sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        *(F.sum(f"x{i}").alias(f"s{i}") for i in _AXES),
        *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in _PAIRS),
    ]


def _estimate(sums: DataFrame, *keep: str, factor: Column | None = None) -> DataFrame:
    """Mean and Cholesky factor of the covariance, from counts and sums."""
    factor = F.lit(1.0) if factor is None else factor
    n = F.col("n").cast("double")
    mean = {i: F.col(f"s{i}") / n for i in _AXES}
    rows = sums.select(
        *keep,
        *(mean[i].alias(f"m{i}") for i in _AXES),
        *(
            (
                factor * (F.col(f"s{i}{j}") / n - mean[i] * mean[j])
                + (F.lit((FLOORS[i] * SCALE) ** 2) if i == j else F.lit(0.0))
            ).alias(f"c{i}{j}")
            for i, j in _PAIRS
        ),
    )
    return _cholesky(rows, *keep)


def _cholesky(rows: DataFrame, *keep: str) -> DataFrame:
    """c00.. to the lower triangle l00.., and the log determinant."""
    lower = []
    for i, j in _PAIRS:
        rest = f"c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        value = f"sqrt(greatest({rest}, 1D))" if i == j else f"({rest}) / l{j}{j}"
        lower.append(f"{value} AS l{i}{j}")
    logdet = " + ".join(f"2 * ln(l{i}{i})" for i in _AXES)
    return rows.selectExpr(
        *keep, *(f"m{i}" for i in _AXES), *lower, f"round({logdet}, 9) AS logdet"
    )


def _with_distance(rows: DataFrame, estimates: DataFrame, how: str = "inner") -> DataFrame:
    """Add `d2`, the squared Mahalanobis distance by the estimate of the cell."""
    found = rows.join(small_side(estimates), "cell", how)
    z = []
    for i in _AXES:
        rest = f"x{i} - m{i}" + "".join(f" - l{i}{k} * z{k}" for k in range(i))
        z.append(f"({rest}) / l{i}{i} AS z{i}")
    d2 = " + ".join(f"z{i} * z{i}" for i in _AXES)
    return found.selectExpr("*", *z, f"{d2} AS d2").drop(*(f"z{i}" for i in _AXES))


def _nearest_half(points: DataFrame, estimates: DataFrame) -> DataFrame:
    """Counts and sums of the nearest half of each cell and start, and its radius."""
    bin_ = F.floor(BINS_PER_DOUBLING * F.log2(F.col("d2") + 1e-6)).cast("int")
    by_bin = (
        _with_distance(points, estimates)
        .withColumn("bin", bin_)
        .groupBy("cell", "start", "bin")
        .agg(*_sums())
    )
    cell = Window.partitionBy("cell", "start")
    before = F.coalesce(
        F.sum("n").over(cell.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    half = F.floor((F.sum("n").over(cell) + P + 1) / 2)
    names = ["n", *(f"s{i}" for i in _AXES), *(f"s{i}{j}" for i, j in _PAIRS)]
    return (
        by_bin.withColumn("before", before)
        .withColumn("half", half)
        .filter("before < half")
        .groupBy("cell", "start")
        .agg(
            *(F.sum(c).alias(c) for c in names),
            F.pow(F.lit(2.0), (F.max("bin") + 1) / BINS_PER_DOUBLING).alias("radius"),
        )
    )


def _starts(points: DataFrame) -> DataFrame:
    """Two first estimates of each cell."""
    classic = _estimate(points.groupBy("cell").agg(*_sums()), "cell")
    quarters = points.groupBy("cell").agg(
        *(F.percentile(f"x{i}", [0.25, 0.5, 0.75]).alias(f"q{i}") for i in _AXES)
    )
    spread = {i: (F.get(f"q{i}", F.lit(2)) - F.get(f"q{i}", F.lit(0))) / 1.349 for i in _AXES}
    zero = F.lit(0.0)
    robust = quarters.select(
        "cell",
        *(F.get(f"q{i}", F.lit(1)).alias(f"m{i}") for i in _AXES),
        *(
            (F.pow(spread[i], 2) + F.lit((FLOORS[i] * SCALE) ** 2) if i == j else zero).alias(f"c{i}{j}")
            for i, j in _PAIRS
        ),
    )
    return (
        _cholesky(robust, "cell")
        .withColumn("start", F.lit(0))
        .unionByName(classic.withColumn("start", F.lit(1)))
    )


def robust_estimates(points: DataFrame, min_rows: int, steps: int) -> DataFrame:
    """Mean and covariance factor of each cell of `points` (cell, x0..x4)."""
    large = points.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= min_rows)
    estimates = saved(_starts(points).join(large.select("cell"), "cell", "left_semi"), "mcd")
    for _ in range(steps):
        estimates = saved(
            _estimate(_nearest_half(points, estimates), "cell", "start", "radius", factor=F.lit(1.0)),
            "mcd",
        )
    best = estimates.groupBy("cell").agg(F.min(F.struct("logdet", "start")).alias("b"))
    chosen = estimates.join(
        best.select("cell", F.col("b.start").alias("start")), ["cell", "start"], "left_semi"
    )
    # The radius of the half belongs to the estimate before; after the steps both agree.
    stretch = F.greatest(F.sqrt(F.col("radius") / CHI2_HALF), F.lit(1.0))
    scaled = chosen.select(
        "cell",
        *(f"m{i}" for i in _AXES),
        *((F.col(f"l{i}{j}") * stretch).alias(f"l{i}{j}") for i, j in _PAIRS),
    )
    near = _with_distance(points, saved(scaled, "mcd")).filter(F.col("d2") <= CHI2_975)
    return _estimate(
        near.groupBy("cell").agg(*_sums()), "cell", factor=F.lit(0.975 / SHARE_975)
    )


def quality_verdicts(
    docs: DataFrame,
    id_col: str = "doc_id",
    cutoff: float = 40.9,
    min_rows: int = 60,
    steps: int = 6,
) -> DataFrame:
    """Counts, `base_failed`, the distance `d2` and `kept` for each row of `docs`."""
    ids = docs.withColumn("__id", F.col(id_col)).select("__id", "text", "lang", "source")
    counted = base_counts(ids, "__id", "lang", "source")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = saved(
        counted.select("*", failed.alias("base_failed"), *_statistics()), "quality"
    )
    points = saved(_cells(rows, min_rows), "cells")
    with_words = points.filter("n_words > 0").select("cell", *(f"x{i}" for i in _AXES))
    estimates = saved(robust_estimates(with_words, min_rows, steps), "mcd")
    judged = _with_distance(points, estimates, "left")
    near = F.coalesce(F.col("d2") <= cutoff, F.lit(True))
    return judged.select(
        F.col("__id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & near).alias("kept"),
        F.round("d2", 6).alias("d2"),
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", **parameters) -> DataFrame:
    """The rows of `docs` that neither fail the base rules nor are outliers.

    Each row is judged by its own text, language and source: rows with one id, or
    without any, may differ.
    """
    parts = [F.col(id_col).cast("string"), "text", "lang", "source"]
    own = F.md5(F.to_json(F.array(*parts)).cast("binary"))
    judged = docs.select(own.alias("row"), "text", "lang", "source")
    good = quality_verdicts(judged, "row", **parameters).filter("kept")
    good = good.select(F.col("row").alias("good_row")).distinct()
    return docs.join(good.hint("shuffle_hash"), own == F.col("good_row"), "left_semi")
