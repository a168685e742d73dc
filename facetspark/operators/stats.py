"""Statistics and thresholds over whole tables: moments, order statistics, trims, cascades, one-dimensional k-means.

Order statistics are exact and need no global sort: approximate percentiles bracket each wanted rank, one aggregate
counts what lies below the brackets, and only the rows inside them are ranked, bracket by bracket.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Accuracy of the percentiles that bracket a rank.
ACCURACY = 2000


def round_half_up(x: float) -> int:
    return int(math.floor(x + 0.5))


#: Groups whose means may be broadcast.
FEW = 10_000


def order_statistics(df: DataFrame, value: str, of_count) -> list[float]:
    """The values at the sorted positions of_count(n) (from 0), n being the number of values; NULL and NaN left out."""
    v = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    n = v.count()
    wanted = of_count(n) if n else []
    if not wanted:
        return []
    slack = max(2.0 / ACCURACY, 0.0)
    share = [w / max(n - 1, 1) for w in wanted]
    at = v.agg(F.percentile_approx("v", [max(0.0, s - slack) for s in share], ACCURACY), F.percentile_approx("v", [min(1.0, s + slack) for s in share], ACCURACY)).first()
    brackets = list(zip(at[0], at[1]))
    got = v.agg(*[F.count_if(F.col("v") < lo).alias(f"b{i}") for i, (lo, _) in enumerate(brackets)], *[F.count_if(F.col("v") <= hi).alias(f"t{i}") for i, (_, hi) in enumerate(brackets)]).first()
    below = [got[f"b{i}"] for i in range(len(wanted))]
    for i, w in enumerate(wanted):
        if not below[i] <= w < got[f"t{i}"]:  # beyond the percentiles' accuracy: then all values are ranked
            brackets[i], below[i] = (float("-inf"), float("inf")), 0
    keys = F.array(*[F.when((F.col("v") >= lo) & (F.col("v") <= hi), i) for i, (lo, hi) in enumerate(brackets)])
    inside = v.select("v", F.explode(F.array_compact(keys)).alias("k")).groupBy("k", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("k").orderBy("v"))
    need = F.element_at(F.array(*[F.lit(w - below[i]) for i, w in enumerate(wanted)]), F.col("k") + 1)
    found = inside.withColumn("upto", upto).where(F.col("upto") > need).groupBy("k").agg(F.min("v").alias("v")).collect()  # a row for each rank
    return [v for _, v in sorted((r["k"], r["v"]) for r in found)]


def quantile_thresholds(df: DataFrame, value: str, k: int) -> list[float]:
    """k inner thresholds: the values at positions Round(i n / (k + 1)), i = 1..k."""
    return order_statistics(df, value, lambda n: [min(round_half_up(i * n / (k + 1)), n - 1) for i in range(1, k + 1)])


def level_thresholds(df: DataFrame, value: str, k: int, alpha: float) -> list[float]:
    """k equally spaced cut points between the order statistics at alpha and 1 - alpha; none for k below 2."""
    if k < 2:
        return []
    ends = order_statistics(df, value, lambda n: [round_half_up((n - 1) * alpha), round_half_up((n - 1) * (1 - alpha))])
    return spaced(*ends, k) if ends else []


def spaced(low: float, high: float, k: int) -> list[float]:
    return [low + (high - low) * i / (k - 1) for i in range(k)]


def linear_thresholds(levels: DataFrame, add: float, mult: float, k: int) -> DataFrame:
    """levels(level, sigma) to (level, i, threshold): k equal steps up to add + mult * sigma."""
    limit = F.lit(add) + F.lit(mult) * F.col("sigma")
    return levels.select("level", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"), limit.alias("limit")).select("level", "i", ((F.col("i") + 1) * F.col("limit") / (k + 1)).alias("threshold"))


def cascade_thresholds(df: DataFrame, level: str, value: str, k: int, alpha: float = 0.02, extend: bool = False) -> dict[int, list[float]]:
    """Level thresholds from the coarsest level down; each level's last one limits the next finer level.

    extend puts the last threshold at the 98 % value of all the level's values. A loop over the few levels, one exact
    order statistic each.
    """
    levels = sorted((r[0] for r in df.select(level).distinct().collect()), reverse=True)  # one row a level
    out, limit = {}, None
    for lev in levels:
        own = df.where(F.col(level) == lev)
        cut = own if limit is None else own.where(F.col(value) <= limit)
        found = level_thresholds(cut, value, k, alpha)
        if extend and found:
            top = order_statistics(own, value, lambda n: [round_half_up((n - 1) * 0.98)])[0]
            found = spaced(found[0], max(found[-1], top), k)
        out[lev], limit = found, found[-1] if found else limit
    return out


def moments(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, mean, population sigma, span, and (6 sigma - span) / span by keys."""
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sigma"), (F.max(value) - F.min(value)).alias("span"))
    return out.withColumn("ratio", F.try_divide(6 * F.col("sigma") - F.col("span"), F.col("span")))


def mean_absolute_deviation(df: DataFrame, value: str, *keys: str) -> DataFrame:
    means = df.groupBy(*keys).agg(F.avg(value).alias("_mean")).select(*[F.col(k).alias(f"_{k}") for k in keys], "_mean")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    few = not keys or means.limit(FEW + 1).count() <= FEW
    small = F.broadcast(means) if few else means
    whole = df.join(small, same) if keys else df.crossJoin(small)
    return whole.groupBy(*keys).agg(F.first("_mean").alias("mean"), F.avg(F.abs(F.col(value) - F.col("_mean"))).alias("deviation"))


def trim_search(df: DataFrame, value: str, cuts: int = 50) -> DataFrame:
    """lev, n, mean, sigma, ratio of the symmetric trim (lev % from both ends) whose ratio is nearest to 0.

    One ranking of the distinct values with their counts; the sums of every trim are differences of running sums, which
    are taken of values less a centre so that nothing cancels. Ties go to the smallest lev.
    """
    v = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    n, centre = v.agg(F.count("*"), F.avg("v")).first()
    if not n:
        return df.sparkSession.createDataFrame([], "lev int, n bigint, mean double, sigma double, ratio double")
    ends = [(lev, n * lev // 100, n - n * lev // 100) for lev in range(cuts) if n - 2 * (n * lev // 100) > 0]
    ranks = sorted({r for _, a, b in ends for r in (a, b - 1)})
    values = dict(zip(ranks, order_statistics(df, value, lambda _: ranks)))
    aggregates = []
    for lev, a, b in ends:
        lo, hi, c = values[a], values[b - 1], F.col("v") - centre
        inner = (F.col("v") > lo) & (F.col("v") < hi)
        aggregates += [F.count_if(inner).alias(f"n{lev}"), F.sum(F.when(inner, c)).alias(f"s{lev}"), F.sum(F.when(inner, c * c)).alias(f"q{lev}"), F.count_if(F.col("v") < lo).alias(f"l{lev}"), F.count_if(F.col("v") <= lo).alias(f"m{lev}")]
    got, rows = v.agg(*aggregates).first(), []
    for lev, a, b in ends:
        lo, hi, m = values[a], values[b - 1], b - a
        at_low = m if lo == hi else got[f"m{lev}"] - a
        at_high = 0 if lo == hi else m - at_low - got[f"n{lev}"]
        s = (got[f"s{lev}"] or 0.0) + at_low * (lo - centre) + at_high * (hi - centre)
        q = (got[f"q{lev}"] or 0.0) + at_low * (lo - centre) ** 2 + at_high * (hi - centre) ** 2
        sigma = math.sqrt(max(q / m - (s / m) ** 2, 0.0))
        if hi > lo:
            rows.append((lev, m, centre + s / m, sigma, (6 * sigma - (hi - lo)) / (hi - lo)))
    best = min(rows, key=lambda r: (abs(r[4]), r[0]), default=None)
    return df.sparkSession.createDataFrame([best] if best else [], "lev int, n bigint, mean double, sigma double, ratio double")


def kmeans_1d(df: DataFrame, value: str, k: int, rounds: int = 10, tolerance: float = 0.0) -> list[float]:
    """Sorted centres of Lloyd's iteration; seeds are every (n / k)-th value in order; an empty centre stays.

    One small aggregate a round; ties in distance go to the lower centre.
    """
    centres = order_statistics(df, value, lambda n: [min(i * (n // k), n - 1) for i in range(k)])
    for _ in range(rounds):
        table = F.array(*[F.struct(F.abs(F.col(value) - c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)])
        means = {r[0]: r[1] for r in df.where(F.col(value).isNotNull()).groupBy(F.array_min(table)["i"]).agg(F.avg(value)).collect()}  # k rows
        moved = [means.get(i, c) for i, c in enumerate(centres)]
        if max(abs(a - b) for a, b in zip(centres, moved)) <= tolerance:
            centres = moved
            break
        centres = moved
    return sorted(centres)


def group_average_median(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, average and upper median (position n div 2) by keys."""
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("average"), F.max(F.when(F.col("_i") == F.floor(F.col("_n") / 2), F.col(value))).alias("median"))


def zscore(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """value less its mean over sigma by keys; only centred where sigma is 0."""
    s = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sigma"))
    return df.join(s, list(keys)).withColumn("z", (F.col(value) - F.col("_mean")) / F.when(F.col("_sigma") > 0, F.col("_sigma")).otherwise(1.0)).drop("_mean", "_sigma")


def standardise(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """value over its population sigma by keys, not centred; NULL where sigma is 0."""
    return df.withColumn("response", F.try_divide(F.col(value), F.stddev_pop(value).over(Window.partitionBy(*keys))))


def gradient_cut(df: DataFrame, value: str) -> float:
    """min(q30, (q80 - min) / 100 + min) of gradient sizes."""
    low, q30, q80 = order_statistics(df, value, lambda n: [0, min(round_half_up(0.3 * n), n - 1), min(round_half_up(0.8 * n), n - 1)])
    return min(q30, (q80 - low) * 0.01 + low)


