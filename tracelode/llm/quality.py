"""Quality rules by robust multivariate outliers.

Counts are taken per text with built-in functions, then each (language, source)
group gets a minimum-covariance-determinant estimate of its transformed
statistics: from several starts, concentration steps (distances under the
current estimate, the group's h-quantile of them, moments of the rows within it)
until the determinant falls no further; the least determinant counts. The
estimate is regularised: every variance has a floor. All steps are partial
aggregations over a narrow table, so a hot group costs no task more than others.
No Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut

SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"

#: Share of a group that the estimate is fitted to.
SUPPORT = 0.75
#: Mean of the smallest 75 % of squared distances scales to a chi-square with four degrees of freedom by this.
CONSISTENCY = 1.0 / 0.6163
#: Squared distance beyond which a row is an outlier: chi-square with four degrees of freedom, far tail.
CUTOFF = 40.0
#: A covariance of four statistics needs more rows than statistics; no estimate, and no rejection by distance, below.
LEAST_ROWS = 5
#: A step counts as a gain if the logarithm of the determinant falls by more.
GAIN = 1e-6
#: Least standard deviation of each statistic: differences this small are never grounds for rejection.
FLOORS = (0.35, 0.35, 0.12, 0.12)
STATS = ("z0", "z1", "z2", "z3")


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, lang, source`` with the base counts of each whole text (null: no words)."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select("doc_id", "lang", "source", t.alias("t"))
    base = base.select(
        "doc_id", "lang", "source",
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split("t", SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
    )
    n = F.size("words")
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    base = base.select(
        "doc_id", "lang", "source", "n_symbols",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        grams.alias("grams"),
    )
    dup = F.size(F.array_distinct("grams")) < F.size("grams")
    placed = F.when(dup, F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).otherwise(F.array().cast("array<struct<g:bigint,i:int>>"))
    base = base.withColumn("placed", placed).drop("grams")
    same = lambda j, d: F.get("placed", j + d)["g"]
    twice = F.filter("placed", lambda x, j: F.coalesce(x["g"] == same(j, -1), F.lit(False)) | F.coalesce(x["g"] == same(j, 1), F.lit(False)))
    covered = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return base.withColumn("n_repeat_words", F.when(F.size("placed") > 0, F.size(F.array_distinct(covered))).otherwise(0).cast("long")).drop("placed")


def statistics(counts: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and the transformed statistics.

    Mean word length (log), symbols per 100 word characters (log), and the
    shares of repeated lines and of repeated words (arc sine of the root, which
    evens out the variance of shares).
    """
    w = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    root = lambda x: F.asin(F.sqrt(F.least(x, F.lit(1.0))))
    return counts.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "z0": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / w) * 2.0,
        "z1": F.log(1.0 + 100.0 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "z2": root(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "z3": root(F.col("n_repeat_words") / w),
    })


def _factor() -> dict[tuple[int, int], Column]:
    """Cholesky factor of the covariance ``c*`` as columns."""
    low: dict[tuple[int, int], Column] = {}
    for i in range(len(STATS)):
        for j in range(i + 1):
            rest = F.col(f"c{j}{i}")
            for k in range(j):
                rest = rest - low[i, k] * low[j, k]
            low[i, j] = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / low[j, j]
    return low


def _log_det() -> Column:
    low = _factor()
    return sum((2.0 * F.log(low[i, i]) for i in range(len(STATS))), F.lit(0.0)).alias("log_det")


_INVERSE = [f"w{i}{j}" for i in range(4) for j in range(i + 1)]


def _with_inverse(shapes: DataFrame) -> DataFrame:
    """Adds ``w*``, the inverse of the Cholesky factor, so that no row of the data has to divide or take roots.

    Every column is made in a step of its own, as nested expressions would repeat the
    ones inside them.
    """
    out = shapes
    for i in range(len(STATS)):
        for j in range(i + 1):
            rest = F.col(f"c{j}{i}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    for i in range(len(STATS)):
        for j in range(i, -1, -1):
            if i == j:
                value = 1.0 / F.col(f"l{i}{i}")
            else:
                value = -sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j + 1, i)), F.col(f"l{i}{j}") * F.col(f"w{j}{j}")) / F.col(f"l{i}{i}")
            out = out.withColumn(f"w{i}{j}", value)
    return out.drop(*[f"l{i}{j}" for i in range(4) for j in range(i + 1)])


def _distance() -> Column:
    """Squared Mahalanobis distance under mean ``m*`` and inverse factor ``w*``."""
    apart = [F.col(STATS[i]) - F.col(f"m{i}") for i in range(4)]
    solved = [sum((F.col(f"w{i}{j}") * apart[j] for j in range(1, i + 1)), F.col(f"w{i}0") * apart[0]) for i in range(4)]
    return sum((x * x for x in solved[1:]), solved[0] * solved[0])


def _moments(scale: float) -> list[Column]:
    p = range(len(STATS))
    out = [F.avg(STATS[i]).alias(f"m{i}") for i in p]
    for i in p:
        for j in range(i, len(STATS)):
            value = F.coalesce(F.covar_pop(STATS[i], STATS[j]), F.lit(0.0)) * scale
            out.append((value + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}"))
    return out


_SHAPE = [f"m{i}" for i in range(4)] + [f"c{i}{j}" for i in range(4) for j in range(i, 4)]


def _starts(fit: DataFrame) -> DataFrame:
    """Three estimates of every group: medians and absolute deviations; moments of the rows within two of these
    deviations in every statistic; moments of all rows."""
    accuracy = F.lit(2000)
    centre = fit.groupBy("grp").agg(*[F.percentile_approx(z, F.lit(0.5), accuracy).alias(f"m{i}") for i, z in enumerate(STATS)], F.count("*").alias("n"))
    centre = cut(centre.where(F.col("n") >= LEAST_ROWS).drop("n").repartition(1), "quality-centre")
    spread = fit.join(centre, "grp").groupBy("grp").agg(*[F.first(f"m{i}").alias(f"m{i}") for i in range(4)], *[F.percentile_approx(F.abs(F.col(z) - F.col(f"m{i}")), F.lit(0.5), accuracy).alias(f"d{i}") for i, z in enumerate(STATS)])
    spread = cut(spread.repartition(1), "quality-spread")
    wide = [F.pow(1.4826 * F.col(f"d{i}"), 2) + FLOORS[i] ** 2 for i in range(4)]
    shape = [(wide[i] if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in range(4) for j in range(i, 4)]
    first = spread.select("grp", F.lit(0).alias("start"), *[f"m{i}" for i in range(4)], *shape)
    inside = F.lit(True)
    for i, z in enumerate(STATS):
        inside = inside & (F.pow(F.col(z) - F.col(f"m{i}"), 2) <= 4.0 * wide[i])
    held = fit.join(spread, "grp").withColumn("inside", inside).select("grp", "inside", *STATS)
    near = held.where("inside").groupBy("grp").agg(*_moments(1.0)).withColumn("start", F.lit(1))
    whole = held.groupBy("grp").agg(*_moments(1.0)).withColumn("start", F.lit(2))
    return first.unionByName(near).unionByName(whole)


def estimates(fit: DataFrame) -> DataFrame:
    """``grp, m*, c*, w*, log_det`` of every group in ``fit`` (``grp`` and the statistics) with at least ``LEAST_ROWS`` rows.

    Tables of one row per group and start are one file each, whose size Spark
    checks before it sends them. Each round that goes on has lowered some group's
    determinant, of which there are finitely many, so the rounds end. A round takes
    only the groups and starts that the one before has moved.
    """
    order = F.struct("log_det", "start")
    keep = ["grp", "start", *_SHAPE, *_INVERSE, "log_det"]
    now = cut(_with_inverse(_starts(fit)).withColumn("log_det", F.lit(float("inf"))).repartition(1), "quality-fit")
    moving = now
    while True:
        far = fit.join(moving.drop("log_det"), "grp").select("grp", "start", *STATS, _distance().alias("d2"))
        edge = cut(far.groupBy("grp", "start").agg(F.percentile_approx("d2", F.lit(SUPPORT), F.lit(2000)).alias("edge")).repartition(1), "quality-edge")
        step = far.join(edge, ["grp", "start"]).where("d2 <= edge").groupBy("grp", "start").agg(*_moments(CONSISTENCY)).select("grp", "start", *_SHAPE, _log_det())
        step = cut(step.repartition(1), "quality-step")
        was = moving.select("grp", "start", F.col("log_det").alias("was"))
        better = step.join(was, ["grp", "start"]).where(F.col("was") - F.col("log_det") > GAIN).drop("was")
        # The others have settled: a further step from the same estimate would be the same.
        moving = cut(_with_inverse(better).select(*keep).repartition(1), "quality-moving")
        if moving.isEmpty():
            break
        now = cut(now.join(moving, ["grp", "start"], "left_anti").select(*keep).unionByName(moving).repartition(1), "quality-fit")
    best = now.groupBy("grp").agg(F.min_by(F.struct(*_SHAPE, *_INVERSE, "log_det"), order).alias("e"))
    return cut(best.select("grp", "e.*").repartition(1), "quality-best")


def outlier_flags(counts: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``counts`` with ``base_failed, distance, kept``.

    Estimates use the rows that pass the base rules; null language and source
    are groups of their own. A group with fewer than ``LEAST_ROWS`` such rows has
    no covariance: its rows have a null distance and are kept if they pass the
    base rules. A constant statistic can't make the covariance singular, as every
    variance has a floor. An empty table stays empty.
    """
    table = cut(statistics(counts), "quality-stats")
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    rows = table.withColumn("grp", F.concat_ws("\u0001", name("lang"), name("source")))
    found = estimates(rows.where(~F.col("base_failed")).select("grp", *STATS)).drop("log_det")
    out = rows.join(found, "grp", "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return out.select(*table.columns, "distance", kept.alias("kept"))
