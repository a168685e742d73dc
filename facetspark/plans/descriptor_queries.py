"""Queries over points, pairs, triples, statistics, encoding and the descriptor matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetspark.functions import expressions as X
from facetspark.operators import chains, features, graph, learn, mesh, pairs, stats
from facetspark.operators.numbering import numbered
from facetspark.plans.catalogue import DIST, EV, PAIRS, PTS, QT, TYPED, events_path, fx, items, levels_sql, query, table


def typed_items(spark: SparkSession, d: str) -> DataFrame:
    cuts = stats.quantile_thresholds(table(spark, d, "lineitem"), "l_quantity", 3)
    return items(spark, d).withColumn("type", F.col("flag") * 4 + X.bin_of(F.col("x"), cuts))


TYPES = 12


@query(f"""WITH {PTS}, {QT}, {TYPED}, {PAIRS}, {levels_sql('dt', 'prs', 5, 0.05)},
c AS (SELECT mol_id, (LEAST(t1, t2) * 12 + GREATEST(t1, t2)) * 6 + (SELECT count(*) FROM dt WHERE prs.dist >= dt.t) AS type FROM prs)
SELECT mol_id, CAST(type AS BIGINT) AS type, count(*) AS cnt FROM c GROUP BY ALL""")
def pair_histogram(spark: SparkSession, d: str) -> DataFrame:
    points = typed_items(spark, d)
    cuts = stats.level_thresholds(pairs.pairs(points), "dist", 5, 0.05)
    return pairs.pair_histogram(points, TYPES, cuts)


@query(f"""WITH {PTS}, {QT}, {TYPED}, lv AS (SELECT t.*, pl FROM typed t, generate_series(0, 3) AS g(pl) WHERE t.level IN (pl, pl + 1)),
c AS (SELECT a.mol_id, a.pl AS pair_level, (LEAST(a.type, b.type) * 12 + GREATEST(a.type, b.type)) * 5 + CAST(LEAST(floor({DIST} / 10), 4) AS BIGINT) AS type FROM lv a JOIN lv b ON a.mol_id = b.mol_id AND a.pl = b.pl AND a.p < b.p)
SELECT mol_id, CAST(pair_level AS INTEGER) AS pair_level, CAST(type AS BIGINT) AS type, count(*) AS cnt FROM c GROUP BY ALL""")
def pair_histogram_levels(spark: SparkSession, d: str) -> DataFrame:
    levelled = pairs.level_windows(typed_items(spark, d), 5, 1)
    return pairs.pair_histogram(levelled, TYPES, [10, 20, 30, 40], ("mol_id", "pair_level"))


@query(f"""WITH {PTS}, e AS (SELECT a.mol_id, a.p AS p, b.p AS q, {DIST} AS dist FROM pts a JOIN pts b ON a.mol_id = b.mol_id AND a.p < b.p),
s AS (SELECT x.mol_id, list_sort([CAST(x.dist >= 15 AS INT) + CAST(x.dist >= 30 AS INT), CAST(y.dist >= 15 AS INT) + CAST(y.dist >= 30 AS INT), CAST(z.dist >= 15 AS INT) + CAST(z.dist >= 30 AS INT)]) AS b
 FROM e x JOIN e y ON x.mol_id = y.mol_id AND x.q = y.p JOIN e z ON z.mol_id = x.mol_id AND z.p = x.p AND z.q = y.q)
SELECT mol_id, CAST((b[1] * 3 + b[2]) * 3 + b[3] AS BIGINT) AS type, count(*) AS cnt FROM s GROUP BY ALL""")
def triple_histogram(spark: SparkSession, d: str) -> DataFrame:
    return pairs.triple_histogram(items(spark, d).withColumn("type", F.lit(0)), [15, 30])


@query(f"""WITH {PTS}, {QT}, {TYPED}, {PAIRS}, h AS (SELECT mol_id, (LEAST(t1, t2) * 12 + GREATEST(t1, t2)) * 3 + CAST(dist >= 15 AS INT) + CAST(dist >= 30 AS INT) AS type, count(*) AS cnt FROM prs GROUP BY ALL)
SELECT CAST(type AS BIGINT) AS type, CAST(sum(cnt) AS BIGINT) AS total, count(*) AS n_objects FROM h GROUP BY type ORDER BY total DESC, type LIMIT 20""")
def md_matrix_top(spark: SparkSession, d: str) -> DataFrame:
    return pairs.top_types(pairs.pair_histogram(typed_items(spark, d), TYPES, [15, 30]), 20)


@query("""SELECT CAST(i AS INTEGER) AS i, v[LEAST(CAST(floor(i * n / 8.0 + 0.5) AS BIGINT), n - 1) + 1] AS threshold
FROM (SELECT list(l_extendedprice ORDER BY l_extendedprice) AS v, count(*) AS n FROM lineitem), generate_series(1, 7) AS g(i)""")
def quantile_thresholds(spark: SparkSession, d: str) -> DataFrame:
    cuts = stats.quantile_thresholds(table(spark, d, "lineitem"), "l_extendedprice", 7)
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(cuts)], "i int, threshold double")


@query(f"""WITH s AS (SELECT l_extendedprice AS dist FROM lineitem), {levels_sql('t', 's', 9, 0.05)} SELECT CAST(row_number() OVER (ORDER BY t) AS INTEGER) AS i, {fx('t')} AS threshold FROM t""")
def level_thresholds(spark: SparkSession, d: str) -> DataFrame:
    cuts = stats.level_thresholds(table(spark, d, "lineitem"), "l_extendedprice", 9, 0.05)
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(cuts)], "i int, threshold double").withColumn("threshold", X.fixed(F.col("threshold")))


@query(f"""WITH e AS (SELECT value AS dist, CAST(event_id % 3 AS INT) AS lev FROM events), {levels_sql('a', 'e', 4, 0.02, 'WHERE lev = 2')}, {levels_sql('b', 'e', 4, 0.02, 'WHERE lev = 1 AND dist <= (SELECT max(t) FROM a)')}, {levels_sql('c', 'e', 4, 0.02, 'WHERE lev = 0 AND dist <= (SELECT max(t) FROM b)')},
u AS (SELECT 2 AS level, t FROM a UNION ALL SELECT 1, t FROM b UNION ALL SELECT 0, t FROM c)
SELECT CAST(level AS INTEGER) AS level, CAST(row_number() OVER (PARTITION BY level ORDER BY t) - 1 AS INTEGER) AS i, {fx('t')} AS threshold FROM u""")
def cascade_thresholds(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("value").alias("dist"), F.pmod("event_id", F.lit(3)).cast("int").alias("level"))
    found = stats.cascade_thresholds(events, "level", "dist", 4)
    return spark.createDataFrame([(lev, i, t) for lev, ts in found.items() for i, t in enumerate(ts)], "level int, i int, threshold double").withColumn("threshold", X.fixed(F.col("threshold")))


@query(f"""SELECT CAST(l AS INTEGER) AS level, CAST(i AS INTEGER) AS i, {fx('(i + 1) * (8.0 + 1.35 * (0.5 + l * 0.25)) / 5')} AS threshold FROM generate_series(0, 9) AS a(l), generate_series(0, 3) AS b(i)""")
def linear_thresholds(spark: SparkSession, d: str) -> DataFrame:
    levels = spark.range(10).select(F.col("id").cast("int").alias("level"), (0.5 + F.col("id") * 0.25).alias("sigma"))
    return stats.linear_thresholds(levels, 8.0, 1.35, 4).withColumn("threshold", X.fixed(F.col("threshold")))


@query(f"""WITH s AS (SELECT p_retailprice AS v, row_number() OVER (ORDER BY p_retailprice) - 1 AS r, count(*) OVER () AS n FROM part),
t AS (SELECT lev, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS sigma, max(v) - min(v) AS span FROM s, generate_series(0, 49) AS g(lev) WHERE r >= n * lev // 100 AND r < n - n * lev // 100 GROUP BY lev)
SELECT CAST(lev AS INTEGER) AS lev, n, {fx('mean')} AS mean, {fx('sigma')} AS sigma, {fx('(6 * sigma - span) / span')} AS ratio FROM t ORDER BY abs((6 * sigma - span) / span), lev LIMIT 1""")
def trim_search(spark: SparkSession, d: str) -> DataFrame:
    found = stats.trim_search(table(spark, d, "part"), "p_retailprice")
    return found.withColumns({c: X.fixed(F.col(c)) for c in ("mean", "sigma", "ratio")})


@query(f"""WITH s AS (SELECT l_extendedprice AS dist FROM lineitem), {levels_sql('t', 's', 6, 0.05)} SELECT l_returnflag, CAST(b AS INTEGER) AS bin, count(*) AS n FROM (SELECT l_returnflag, (SELECT count(*) FROM t WHERE l_extendedprice >= t.t) AS b FROM lineitem) GROUP BY ALL""")
def bin_type(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    cuts = stats.level_thresholds(li, "l_extendedprice", 6, 0.05)
    return li.groupBy("l_returnflag", X.bin_of(F.col("l_extendedprice"), cuts).alias("bin")).agg(F.count("*").alias("n"))


@query("""SELECT CAST((CAST(floor((l_quantity - 1) / 5) AS BIGINT) * 11 + CAST(floor(l_discount * 100 + 0.5) AS BIGINT)) * 3 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS BIGINT) AS code, count(*) AS n FROM lineitem GROUP BY ALL""")
def compose_type(spark: SparkSession, d: str) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    code = X.mixed_radix([X.range_part(F.col("l_quantity"), 1, 50, 5), (X.rounded(F.col("l_discount") * 100), 11), (flag, 3)])
    return table(spark, d, "lineitem").groupBy(code.alias("code")).agg(F.count("*").alias("n"))


@query(f"""WITH {EV}, s AS (SELECT mol_id, v, lag(value) OVER w AS a, value AS b, lead(value) OVER w AS c FROM ev WINDOW w AS (PARTITION BY mol_id ORDER BY v))
SELECT CAST(CASE WHEN a + c - 2 * b > 0 THEN 2 WHEN (a - b) * (c - b) < 0 THEN 3 ELSE 1 END AS INTEGER) AS type, count(*) AS n FROM s WHERE a IS NOT NULL AND c IS NOT NULL GROUP BY ALL""")
def curvature_type(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("mol_id").orderBy("v")
    s = events_path(spark, d).select(F.lag("value").over(w).alias("a"), F.col("value").alias("b"), F.lead("value").over(w).alias("c")).where("a is not null and c is not null")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return s.groupBy(X.curvature_type((a - b) * (c - b), a + c - 2 * b).alias("type")).agg(F.count("*").alias("n"))


@query(f"""WITH s AS (SELECT l_returnflag AS f, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_extendedprice, {fx('(LEAST(GREATEST(l_extendedprice, m - 3 * s), m + 3 * s) - (m - 3 * s)) / s', 5)} AS scaled FROM lineitem JOIN s ON f = l_returnflag""")
def sigma_rescale(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    s = stats.moments(li, "l_extendedprice", "l_returnflag")
    out = li.join(F.broadcast(s), "l_returnflag").withColumn("scaled", X.fixed(X.rescale(F.col("l_extendedprice"), F.col("mean"), F.col("sigma")), 5))
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice", "scaled")


@query(f"""WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) / 2 AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, {fx('LEAST(GREATEST(l_extendedprice, m - 3 * s), m + 3 * s)', 3)} AS clamped FROM lineitem, s""")
def sigma_inverse(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    s = li.agg(F.avg("l_extendedprice").alias("m"), (F.stddev_pop("l_extendedprice") / 2).alias("s"))
    m, s_ = F.col("m"), F.col("s")
    back = X.unscale(X.rescale(F.col("l_extendedprice"), m, s_), m, s_)
    return li.join(F.broadcast(s)).select("l_orderkey", "l_linenumber", X.fixed(back, 3).alias("clamped"))


def _kmeans_sql(k: int, rounds: int) -> str:
    parts = [f"c0 AS (SELECT i, v[LEAST(i * (n // {k}), n - 1) + 1] AS c FROM (SELECT list(s_acctbal ORDER BY s_acctbal) AS v, count(*) AS n FROM supplier), generate_series(0, {k - 1}) AS g(i))"]
    for r in range(rounds):
        parts.append(f"c{r + 1} AS (SELECT o.i, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN (SELECT i, avg(s_acctbal) AS c FROM (SELECT s_acctbal, (SELECT i FROM c{r} ORDER BY abs(s_acctbal - c), i LIMIT 1) AS i FROM supplier) GROUP BY i) n USING (i))")
    return f"WITH {', '.join(parts)} SELECT CAST(row_number() OVER (ORDER BY c) AS INTEGER) AS i, {fx('c', 4)} AS centre FROM c{rounds}"


@query(_kmeans_sql(4, 6))
def kmeans_1d(spark: SparkSession, d: str) -> DataFrame:
    found = stats.kmeans_1d(table(spark, d, "supplier"), "s_acctbal", 4, 6)
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(found)], "i int, centre double").withColumn("centre", X.fixed(F.col("centre"), 4))


@query(f"""SELECT l_returnflag, l_linestatus, count(*) AS n, {fx('avg(l_extendedprice)', 4)} AS average, list(l_extendedprice ORDER BY l_extendedprice)[count(*) // 2 + 1] AS median FROM lineitem GROUP BY ALL""")
def group_average_median(spark: SparkSession, d: str) -> DataFrame:
    return stats.group_average_median(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag", "l_linestatus").withColumn("average", X.fixed(F.col("average"), 4))


@query(f"""WITH s AS (SELECT l_returnflag, l_extendedprice AS v, avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) SELECT l_returnflag, {fx('any_value(m)', 4)} AS mean, {fx('avg(abs(v - m))', 4)} AS deviation FROM s GROUP BY ALL""")
def mean_absolute_deviation(spark: SparkSession, d: str) -> DataFrame:
    out = stats.mean_absolute_deviation(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag")
    return out.withColumns({c: X.fixed(F.col(c), 4) for c in ("mean", "deviation")})


SIDE = "sqrt(({0}.x - {1}.x) * ({0}.x - {1}.x) + ({0}.y - {1}.y) * ({0}.y - {1}.y) + ({0}.z - {1}.z) * ({0}.z - {1}.z))"


def path_triangles(points: DataFrame) -> DataFrame:
    """The triangles of an object's points, each with the two after it."""
    return points.where("p >= 2").select("mol_id", *[(F.col("p") - 2 + k).alias(c) for c, k in (("t", 0), ("a", 0), ("b", 1), ("c", 2))])


@query(f"""WITH {PTS}, s AS (SELECT a.mol_id, a.flag + 1 AS seg, {SIDE.format('a', 'b')} AS u, {SIDE.format('b', 'c')} AS v, {SIDE.format('a', 'c')} AS w FROM pts a JOIN pts b ON a.mol_id = b.mol_id AND b.p = a.p + 1 JOIN pts c ON a.mol_id = c.mol_id AND c.p = a.p + 2),
q AS (SELECT seg, (u + v + w) / 2 AS h, u, v, w FROM s) SELECT CAST(seg AS INTEGER) AS seg, {fx('sum(sqrt(GREATEST(h * (h - u) * (h - v) * (h - w), 0)))', 2)} AS area FROM q GROUP BY seg""")
def area_by_segment(spark: SparkSession, d: str) -> DataFrame:
    points = items(spark, d)
    shaped = mesh.triangle_geometry(path_triangles(points), points).join(points.select("mol_id", F.col("p").alias("t"), (F.col("flag") + 1).alias("seg")), ["mol_id", "t"])
    whole = mesh.area_by_segment(shaped.select(F.lit(0).alias("mol_id"), "seg", "area"))
    return whole.select("seg", X.fixed(F.col("area"), 2).alias("area"))


@query(f"""WITH {PTS}, c AS (SELECT mol_id, flag, count(*) AS n FROM pts GROUP BY ALL) SELECT mol_id, CAST(flag AS INTEGER) AS flag FROM c QUALIFY row_number() OVER (PARTITION BY mol_id ORDER BY n DESC, flag) = 1""")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    from facetspark.operators.graph import majority

    return majority(items(spark, d).select("mol_id", "flag"), ["mol_id"], "flag")


@query(f"""WITH c AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS type, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings), s AS (SELECT type, avg(value) AS m, stddev_pop(value) AS s FROM c GROUP BY type)
SELECT vec_id AS mol_id, CAST(type AS INTEGER) AS type, {fx('(value - m) / CASE WHEN s > 0 THEN s ELSE 1 END', 5)} AS z FROM c JOIN s USING (type)""")
def zscore_columns(spark: SparkSession, d: str) -> DataFrame:
    return stats.zscore(cells(spark, d), "value", "type").select("mol_id", "type", X.fixed(F.col("z"), 5).alias("z"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as a long matrix: mol_id, type, value."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("mol_id"), F.posexplode("embedding").alias("type", "value")).withColumn("value", F.col("value").cast("double"))


@query(f"""WITH {EV} SELECT mol_id, CAST(v AS INTEGER) AS v, {fx('value / nullif(stddev_pop(value) OVER (PARTITION BY mol_id), 0)', 5)} AS response FROM ev""")
def std_response(spark: SparkSession, d: str) -> DataFrame:
    return stats.standardise(events_path(spark, d), "value", "mol_id").select("mol_id", "v", X.fixed(F.col("response"), 5).alias("response"))


@query("""WITH c AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS type, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings), v AS (SELECT type FROM c GROUP BY type HAVING var_samp(value) >= 0.0155)
SELECT CAST(type AS INTEGER) AS type FROM v WHERE NOT EXISTS (SELECT 1 FROM v w WHERE w.type < v.type AND (SELECT corr(a.value, b.value) FROM c a JOIN c b USING (vec_id) WHERE a.type = w.type AND b.type = v.type) > 0.12)""")
def variance_corr_filter(spark: SparkSession, d: str) -> DataFrame:
    return features.variance_corr_filter(cells(spark, d), "value", 0.0155, 0.12)


@query("""WITH c AS (SELECT vec_id AS mol_id, generate_subscripts(embedding, 1) - 1 AS type, CAST(unnest(embedding) AS DOUBLE) - 0.35 AS value FROM embeddings) SELECT CAST(type AS INTEGER) AS type, count(*) AS n FROM c GROUP BY type HAVING max(value) > 0""")
def nonzero_columns(spark: SparkSession, d: str) -> DataFrame:
    kept = features.nonzero_columns(cells(spark, d).withColumn("value", F.col("value") - 0.35), "value")
    return kept.groupBy("type").agg(F.count("*").alias("n"))


MED = "m AS (SELECT list(p_retailprice ORDER BY p_retailprice)[count(*) // 2 + 1] AS m FROM part)"


def labelled_parts(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    (cut,) = stats.order_statistics(part, "p_retailprice", lambda n: [n // 2])
    return part.select("p_partkey", "p_brand", "p_size", F.when(F.col("p_retailprice") > cut, 1).otherwise(-1).alias("y"))


@query(f"""WITH {MED}, l AS (SELECT p_partkey, p_brand, p_size, CASE WHEN p_retailprice > m THEN 1 ELSE -1 END AS y FROM part, m), g AS (SELECT p_brand, p_size FROM l GROUP BY ALL HAVING min(y) = max(y))
SELECT p_partkey, p_brand, p_size, CAST(y AS INTEGER) AS y FROM l JOIN g USING (p_brand, p_size)""")
def conflict_removal(spark: SparkSession, d: str) -> DataFrame:
    return learn.delete_conflicts(labelled_parts(spark, d), ["p_brand", "p_size"])


@query("""WITH s AS (SELECT quality AS y, count(*) AS n FROM labels GROUP BY 1), k AS (SELECT arg_min(y, n * 10 + y) AS y, min(n) AS m, max(n) - min(n) AS need FROM s), r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM labels, k WHERE quality = k.y)
SELECT doc_id, CAST(quality AS INTEGER) AS quality, CAST(0 AS BIGINT) AS copy FROM labels UNION ALL SELECT doc_id, CAST(k.y AS INTEGER), CAST(c AS BIGINT) FROM k, r, generate_series(1, 100) AS g(c) WHERE r.i + (c - 1) * k.m < k.need""")
def class_balance(spark: SparkSession, d: str) -> DataFrame:
    return learn.balance(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality")


@query("""WITH r AS (SELECT doc_id % 97 AS id, quality AS y, count(*) AS n FROM labels GROUP BY ALL) SELECT id, CAST(y AS INTEGER) AS y, n, CAST((row_number() OVER (ORDER BY y, n, id) - 1) % 5 AS INTEGER) AS fold FROM r""")
def balanced_folds(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").select((F.col("doc_id") % 97).alias("id"), F.col("quality").alias("y"))
    return learn.balanced_folds(rows, "id", 5)


def predicted(spark: SparkSession, d: str) -> DataFrame:
    """A rule's predictions of quality, and folds by document."""
    docs = table(spark, d, "documents").select("doc_id", F.when((F.col("n_chars") > 400) & (F.col("lang") == "en"), 1).otherwise(0).alias("predicted"))
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("y"), "predicted", (F.col("doc_id") % 7).cast("int").alias("fold"))


PRED = "p AS (SELECT doc_id, quality AS y, CASE WHEN n_chars > 400 AND lang = 'en' THEN 1 ELSE 0 END AS predicted, CAST(doc_id % 7 AS INTEGER) AS fold FROM labels JOIN documents USING (doc_id))"


@query(f"""WITH {PRED} SELECT {fx('sum(CASE WHEN y = predicted THEN 0 ELSE 1 END) / CAST(count(*) AS DOUBLE)')} AS error FROM p""")
def cv_error(spark: SparkSession, d: str) -> DataFrame:
    folds = predicted(spark, d).groupBy("fold").agg(learn.zero_one_loss(F.col("y"), F.col("predicted")).alias("loss"), F.count("*").alias("n"))
    return learn.cv_error(folds).select(X.fixed(F.col("error")).alias("error"))


@query(f"""WITH {PRED}, r AS (SELECT fold, y, avg(CASE WHEN y = predicted THEN 1.0 ELSE 0.0 END) AS r FROM p GROUP BY ALL) SELECT fold, {fx('avg(r)')} AS balanced_accuracy FROM r GROUP BY fold""")
def balanced_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return learn.balanced_accuracy(predicted(spark, d), "y", "predicted", "fold").select("fold", X.fixed(F.col("balanced_accuracy")).alias("balanced_accuracy"))


@query(f"""WITH {PRED}, r AS (SELECT fold, count(*) AS w, avg(CASE WHEN y = predicted THEN 1.0 ELSE 0.0 END) AS s FROM p GROUP BY fold) SELECT {fx('sum(w * s) / sum(w)')} AS score FROM r""")
def weighted_score(spark: SparkSession, d: str) -> DataFrame:
    per = predicted(spark, d).groupBy("fold").agg(F.count("*").alias("w"), F.avg((F.col("y") == F.col("predicted")).cast("double")).alias("s"))
    return learn.weighted_score(per).select(X.fixed(F.col("score")).alias("score"))


@query(f"""WITH w AS (SELECT doc_id AS mol_id, unnest(string_split(text, ' ')) AS type FROM documents), t AS (SELECT mol_id, type, count(*) AS cnt FROM w WHERE type <> '' GROUP BY ALL), f AS (SELECT type, count(*) AS df FROM t GROUP BY type)
SELECT mol_id, type, {fx('cnt * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0)')} AS weight FROM t JOIN f USING (type)""")
def tfidf(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("mol_id"), "text")
    # Texts are dealt, not their words, and cells are written once for their two readers.
    dealt = docs.repartition("mol_id")
    md = dealt.select("mol_id", F.explode(F.split("text", " ")).alias("type")).where("type <> ''").groupBy("mol_id", "type").agg(F.count("*").alias("cnt"))
    return features.tfidf(graph.written(md), docs.count()).withColumn("weight", X.fixed(F.col("weight")))


CH = f"""{EV}, ch AS (SELECT mol_id, event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM ev WINDOW w AS (PARTITION BY mol_id ORDER BY v))"""


def event_chains(spark: SparkSession, d: str) -> DataFrame:
    return chains.windows_of(events_path(spark, d), ["v"], "event_type", 3)


@query(f"""WITH {CH} SELECT mol_id, a || '-' || b || '-' || c AS code, count(*) AS cnt FROM ch WHERE c IS NOT NULL GROUP BY ALL""")
def chain_counts(spark: SparkSession, d: str) -> DataFrame:
    return chains.counts(event_chains(spark, d), F.array_join("chain", "-"))


@query(f"""WITH {CH}, k AS (SELECT DISTINCT a || '-' || b || '-' || c AS code FROM ch WHERE c IS NOT NULL) SELECT code, CAST(row_number() OVER (ORDER BY code) AS INTEGER) AS n FROM k""")
def chain_vocab(spark: SparkSession, d: str) -> DataFrame:
    return chains.vocabulary(chains.counts(event_chains(spark, d), F.array_join("chain", "-")))


@query(f"""WITH {CH}, k AS (SELECT DISTINCT a, b, c FROM ch WHERE c IS NOT NULL), r AS (SELECT row_number() OVER (ORDER BY a, b, c) AS i, a, b, c FROM k)
SELECT CAST(i AS INTEGER) AS i, a || '-' || b || '-' || c AS code FROM r WHERE NOT EXISTS (SELECT 1 FROM r s WHERE s.i > r.i AND s.a = r.c AND s.b = r.b AND s.c = r.a)""")
def reverse_dedupe(spark: SparkSession, d: str) -> DataFrame:
    distinct = numbered(event_chains(spark, d).select("chain").distinct(), ["chain"], "i", 1).withColumn("i", F.col("i").cast("int"))
    return chains.reverse_dedupe(distinct).select("i", F.array_join("chain", "-").alias("code"))


@query(f"""WITH {PTS}, {QT}, {TYPED}, {PAIRS} SELECT level1 AS level, count(*) AS n, {fx('sum(dist)', 2)} AS total FROM prs WHERE level1 = level2 AND dist < 20 + 5 * level1 GROUP BY level1""")
def high_distance_cut(spark: SparkSession, d: str) -> DataFrame:
    found = pairs.pairs(items(spark, d), ("mol_id", "level"), ())
    limits = spark.createDataFrame([(i, 20.0 + 5 * i) for i in range(5)], "level int, high double")
    return pairs.below_level_limit(found, limits).groupBy("level").agg(F.count("*").alias("n"), X.fixed(F.sum("dist"), 2).alias("total"))


@query(f"""WITH {PTS} SELECT a.mol_id, CAST(a.p AS INTEGER) AS p1, CAST(b.p AS INTEGER) AS p2, {fx(DIST)} AS dist FROM pts a JOIN pts b ON a.mol_id = b.mol_id AND a.p < b.p""")
def all_distances(spark: SparkSession, d: str) -> DataFrame:
    return pairs.all_distances(items(spark, d)).withColumn("dist", X.fixed(F.col("dist")))


@query("""SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""")
def centre_semi_join(spark: SparkSession, d: str) -> DataFrame:
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(returned, "p_partkey", "left_semi").select("p_partkey", "p_brand")


@query("""WITH s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier) SELECT c_custkey AS s_suppkey, coalesce(n, 0) AS n FROM customer LEFT JOIN s ON s_suppkey = c_custkey""")
def first_match(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("s_suppkey"))
    return chains.first_match(wanted, table(spark, d, "supplier"), "s_suppkey")


@query("""WITH e AS (SELECT vec_id AS mol_id, generate_subscripts(embedding, 1) - 1 AS type, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)
SELECT mol_id, CAST(type AS INTEGER) AS type, value FROM e UNION ALL SELECT mol_id, CAST(64 + row_number() OVER (ORDER BY mol_id) - 1 AS INTEGER), 0.25 FROM (SELECT DISTINCT mol_id FROM e)""")
def slack_columns(spark: SparkSession, d: str) -> DataFrame:
    md = cells(spark, d)
    return features.slack_columns(md, md, 0.25)


@query(f"""WITH {PTS}, {QT}, {TYPED}, {PAIRS}, h AS (SELECT DISTINCT mol_id, LEAST(t1, t2) * 12 + GREATEST(t1, t2) AS type FROM prs), o AS (SELECT o_orderkey AS mol_id, o_orderpriority IN ('1-URGENT', '2-HIGH') AS y FROM orders),
c AS (SELECT type, count(*) AS n, sum(CAST(y AS INT)) AS tp FROM h JOIN o USING (mol_id) GROUP BY type), s AS (SELECT type, tp / CAST(n AS DOUBLE) AS p, tp / CAST((SELECT sum(CAST(y AS INT)) FROM o) AS DOUBLE) AS r FROM c)
SELECT CAST(type AS BIGINT) AS type, {fx('2 * r * p / (r + p + 0.000001) + 0.35 * p')} AS f FROM s ORDER BY f DESC, type LIMIT 10""")
def top_descriptor_sets(spark: SparkSession, d: str) -> DataFrame:
    found = pairs.pairs(typed_items(spark, d))
    h = found.select("mol_id", X.mixed_radix([(F.least("type1", "type2"), TYPES), (F.greatest("type1", "type2"), TYPES)]).alias("type")).distinct()
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("mol_id"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("y"))
    c = h.join(o, "mol_id").groupBy("type").agg(F.count("*").alias("n"), F.sum("y").alias("tp")).join(F.broadcast(o.agg(F.sum("y").alias("all"))))
    p, r = F.col("tp") / F.col("n"), F.col("tp") / F.col("all")
    return features.best_columns(c.select("type", X.fixed(X.f_measure(p, r)).alias("f")), 10)


@query("""SELECT CAST(CASE WHEN value < 50 THEN -1 ELSE 1 END AS INTEGER) AS y, count(*) AS n FROM events GROUP BY ALL""")
def activity_threshold(spark: SparkSession, d: str) -> DataFrame:
    from facetspark.sources.text import threshold_classes

    return threshold_classes(table(spark, d, "events").select("value"), 50.0).groupBy("y").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id, event_type, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), t AS (SELECT user_id, i, nxt FROM s WHERE event_type LIKE '%click%')
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS INTEGER) AS n, nxt AS value FROM t""")
def next_line_tag(spark: SparkSession, d: str) -> DataFrame:
    from facetspark.sources.text import tag_values

    rows = events_path(spark, d).select(F.col("mol_id").alias("file"), F.col("v").alias("i"), F.col("event_type").alias("line"), F.col("value").cast("string").alias("text"))
    return tag_values(rows, "click", "text").select(F.col("file").alias("user_id"), "n", "value")


@query("""WITH g AS (SELECT * FROM (SELECT row_number() OVER (ORDER BY a, b) - 1 AS number, (a - 3) * (a - 3) + (b - 2) * (b - 2) // 2 AS error, a, b FROM generate_series(0, 6) AS x(a), generate_series(0, 4) AS y(b))) SELECT CAST(number AS INTEGER) AS number, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(error AS DOUBLE) AS error FROM g ORDER BY error, number LIMIT 1""")
def grid_argmin(spark: SparkSession, d: str) -> DataFrame:
    points = learn.grid({"a": range(7), "b": range(5)})
    df = spark.createDataFrame([(n, float(a), float(b)) for n, a, b in points], "number int, a double, b double")
    error = (F.col("a") - 3) * (F.col("a") - 3) + F.floor((F.col("b") - 2) * (F.col("b") - 2) / 2)
    return learn.grid_argmin(df.withColumn("error", error.cast("double")))


@query("""SELECT user_id AS mol_id, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE -1 END) AS BIGINT) AS activity FROM events GROUP BY 1""")
def running_activity(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "events").select(F.col("user_id").alias("mol_id"), F.when(F.col("value") > 50, 1).otherwise(-1).alias("activity"))
    return learn.running_activity(runs)


