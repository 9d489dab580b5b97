"""All queries outside the text subpackage, by name, with their SQL where SQL can express them.

`embeddings` stands for spectra (64 variables, ten classes), `events` for a control series,
`part`, `lineitem`, `orders` and `customer` for named variables and factors, `labels` for lookup files with gaps.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectraloom.functions import arrays
from spectraloom.operators import charts, models, relational, signal, simca, stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: CTEs that the SQL below starts from.
LONG = "long AS (SELECT vec_id, label, unnest(range(0, 64)) AS var_idx, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
DAY = "day AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS d, event_type, user_id, event_id, value FROM events)"
SERIES = "s AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events), ref AS (SELECT event_type, avg(value) AS mu, stddev_samp(value) AS sd FROM s WHERE n <= 20 GROUP BY 1), z AS (SELECT s.*, mu, sd, (value - mu) / greatest(coalesce(sd, 0), 0.05 * abs(mu), 1e-9) AS z FROM s JOIN ref USING (event_type))"


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = " ".join(sql.format(LONG=LONG, DAY=DAY, SERIES=SERIES).split())
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spectra(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", arrays.doubles(F.col("embedding")).alias("spectrum"))


def long(spark: SparkSession, d: str) -> DataFrame:
    return signal.long_view(table(spark, d, "embeddings"), "embedding", "vec_id", "label")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# ---- row-wise pretreatments ---------------------------------------------------------------


@query("""WITH {LONG}, s AS (SELECT vec_id, avg(x) AS m, stddev_pop(x) AS sd FROM long GROUP BY 1),
 z AS (SELECT label, var_idx, (x - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS z FROM long JOIN s USING (vec_id))
 SELECT label, var_idx, round(avg(z), 6) AS mean_snv, round(stddev_pop(z), 6) AS sd_snv FROM z GROUP BY 1, 2""")
def flagship_snv_class_profile(spark, d):
    rows = signal.long_view(spectra(spark, d).withColumn("spectrum", arrays.snv(F.col("spectrum"))), "spectrum", "label")
    return rounded(rows.groupBy("label", "var_idx").agg(F.avg("x").alias("mean_snv"), F.stddev_pop("x").alias("sd_snv")), "mean_snv", "sd_snv")


@query("""WITH {LONG}, s AS (SELECT vec_id, sum(abs(x)) AS a, sqrt(sum(x * x)) AS u, min(x) AS lo, max(x) AS hi FROM long GROUP BY 1)
 SELECT vec_id, var_idx, round(x / a, 6) AS area, round(x / u, 6) AS unit, round((x - lo) / (hi - lo), 6) AS minmax FROM long JOIN s USING (vec_id)""")
def f1_normalise(spark, d):
    s = F.col("spectrum")
    all3 = spectra(spark, d).select("vec_id", F.posexplode(F.arrays_zip(arrays.area(s).alias("area"), arrays.unit(s).alias("unit"), arrays.minmax(s).alias("minmax"))).alias("var_idx", "v"))
    return rounded(all3.select("vec_id", "var_idx", "v.*"), "area", "unit", "minmax")


@query("WITH {LONG}, f AS (SELECT var_idx, avg(x) AS m, stddev_pop(x) AS s FROM long GROUP BY 1) SELECT vec_id, var_idx, round((x - m) / s, 6) AS z FROM long JOIN f USING (var_idx)")
def f2_autoscale(spark, d):
    return rounded(signal.autoscale(long(spark, d)).select("vec_id", "var_idx", "z"), "z")


@query("WITH {LONG}, f AS (SELECT var_idx, avg(x) AS ref FROM long GROUP BY 1) SELECT vec_id, round(regr_slope(x, ref), 6) AS slope, round(regr_intercept(x, ref), 6) AS intercept FROM long JOIN f USING (var_idx) GROUP BY 1")
def f4_msc(spark, d):
    return rounded(signal.msc(long(spark, d), "vec_id"), "slope", "intercept")


@query("WITH {LONG}, f AS (SELECT var_idx, median(x) AS ref FROM long GROUP BY 1) SELECT vec_id, round(median(CASE WHEN abs(ref) > 1e-12 THEN x / ref END), 6) AS quotient FROM long JOIN f USING (var_idx) GROUP BY 1")
def f6_pqn(spark, d):
    return rounded(signal.pqn(long(spark, d), "vec_id"), "quotient")


@query("WITH {LONG} SELECT vec_id, CAST(var_idx // 5 AS BIGINT) AS bin, round(avg(var_idx), 6) AS centre, round(sum(x), 6) AS x FROM long GROUP BY 1, 2")
def f10_bucketing(spark, d):
    return rounded(signal.bucket(long(spark, d), 5, "vec_id"), "centre", "x")


def _scales(spark, d, kind):
    return rounded(signal.block_scale(long(spark, d), kind).select("vec_id", "var_idx", "z"), "z")


_SCALE_SQL = "WITH {{LONG}}, f AS (SELECT var_idx, avg(x) AS m, stddev_samp(x) AS s, max(x) AS hi, min(x) AS lo, median(x) AS md FROM long GROUP BY 1), g AS (SELECT var_idx, 1.4826 * median(abs(x - md)) AS mad FROM long JOIN f USING (var_idx) GROUP BY 1) SELECT vec_id, var_idx, round({}, 6) AS z FROM long JOIN f USING (var_idx) JOIN g USING (var_idx)"
for _kind, _sql in {"pareto": "(x - m) / sqrt(s)", "range": "(x - m) / (hi - lo)", "level": "(x - m) / abs(m)", "robust": "(x - md) / mad"}.items():

    def _f(spark, d, kind=_kind):
        return _scales(spark, d, kind)

    _f.__name__ = f"f24_scale_{_kind}"
    query(_SCALE_SQL.format(_sql))(_f)


@query("WITH {LONG} SELECT count(DISTINCT vec_id) AS n, round(sqrt(sum(x * x)), 6) AS frobenius, round(sqrt(sum(x * x)) / sqrt(count(DISTINCT vec_id)), 6) AS scale FROM long")
def f18_block_norm(spark, d):
    return rounded(signal.block_norm(long(spark, d), "vec_id"), "frobenius", "scale")


@query("""WITH j AS (SELECT d.doc_id, CASE WHEN n_chars > 0 THEN CAST(n_chars AS DOUBLE) END AS v, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)),
 m AS (SELECT doc_id, CASE WHEN quality IS NOT NULL THEN v END AS x FROM j), f AS (SELECT avg(x) AS a, median(x) AS md, min(CASE WHEN x > 0 THEN x END) / 2 AS h FROM m)
 SELECT doc_id, round(coalesce(x, 0), 6) AS zero, round(coalesce(x, a), 6) AS mean, round(coalesce(x, md), 6) AS median, round(coalesce(x, h), 6) AS half_min FROM m, f""")
def f21_impute(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels").select("doc_id", "quality")
    x = docs.join(labels, "doc_id", "left").select("doc_id", F.when(F.col("quality").isNotNull() & (F.col("n_chars") > 0), F.col("n_chars").cast("double")).alias("x"))
    f = x.agg(F.avg("x").alias("a"), F.median("x").alias("md"), (F.min(F.when(F.col("x") > 0, F.col("x"))) / 2).alias("h"))
    out = x.crossJoin(F.broadcast(f))  # one row
    return rounded(out.select("doc_id", F.coalesce("x", F.lit(0.0)).alias("zero"), F.coalesce("x", "a").alias("mean"), F.coalesce("x", "md").alias("median"), F.coalesce("x", "h").alias("half_min")), "zero", "mean", "median", "half_min")


@query("SELECT p_partkey, round(sqrt(p_retailprice), 6) AS root, round(log10(p_retailprice), 6) AS log10, round(log2(p_retailprice), 6) AS log2, round(ln(p_retailprice), 6) AS ln, round(ln((p_retailprice + sqrt(p_retailprice * p_retailprice + 4.0)) / 2), 6) AS glog FROM part")
def f23_transforms(spark, d):
    x = F.col("p_retailprice")
    out = table(spark, d, "part").select("p_partkey", F.sqrt(x).alias("root"), F.log10(x).alias("log10"), F.log2(x).alias("log2"), F.ln(x).alias("ln"), F.ln((x + F.sqrt(x * x + 4.0)) / 2).alias("glog"))
    return rounded(out, "root", "log10", "log2", "ln", "glog")


@query("WITH {LONG}, c AS (SELECT vec_id // 500 AS cube, vec_id % 500 // 20 AS row, vec_id % 20 AS col, var_idx, x FROM long) SELECT CAST(cube AS BIGINT) AS cube, CAST(row // 3 AS BIGINT) AS row, CAST(col // 3 AS BIGINT) AS col, CAST(var_idx // 7 AS BIGINT) AS var_idx, round(avg(x), 6) AS x FROM c WHERE row < 24 AND col < 18 AND var_idx < 63 GROUP BY 1, 2, 3, 4")
def f26_cube_blocks(spark, d):
    """All spectra as cubes of 25 x 20 pixels (the last one may have fewer)."""
    at = F.col("vec_id")
    rows = long(spark, d).withColumns({"cube": F.floor(at / 500), "row": F.floor(at % 500 / 20), "col": at % 20})
    return rounded(signal.block_mean(rows, 3, 7, 25, 20, 64, "cube"), "x")


@query("WITH {LONG} SELECT vec_id, CAST(((var_idx + 1) * 10 - 1) // 64 AS BIGINT) AS win, round(avg(x), 6) AS x FROM long GROUP BY 1, 2")
def f30_window_means(spark, d):
    rows = long(spark, d).withColumn("win", signal.window_of(F.col("var_idx"), 64, 10))
    return rounded(rows.groupBy("vec_id", "win").agg(F.avg("x").alias("x")), "x")


@query("WITH {LONG}, b AS (SELECT *, var_idx // 8 AS block FROM long) SELECT vec_id, CAST(block AS BIGINT) AS block, min(x) AS lo, CAST(arg_min(var_idx, (x, var_idx)) AS INTEGER) AS lo_at, max(x) AS hi, CAST(arg_max(var_idx, (x, -var_idx)) AS INTEGER) AS hi_at FROM b GROUP BY 1, 2")
def f32_decimate(spark, d):
    return signal.decimate(long(spark, d), 8, "vec_id").withColumn("hi_at", F.col("hi_at").cast("int"))


@query("WITH {LONG}, t AS (SELECT vec_id, var_idx, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM long) SELECT vec_id, var_idx, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS p FROM t")
def f34_softmax(spark, d):
    rows = signal.long_view(spectra(spark, d).withColumn("spectrum", arrays.softmax(F.col("spectrum"))), "spectrum", "vec_id")
    return rounded(rows.withColumnRenamed("x", "p"), "p")


# ---- aggregates -----------------------------------------------------------------------------


@query("WITH {LONG} SELECT var_idx, count(x) AS n, count(*) - count(x) AS missing, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(min(x), 6) AS min, round(median(x), 6) AS median, round(max(x), 6) AS max, round(100 * stddev_samp(x) / nullif(abs(avg(x)), 0), 4) AS cv FROM long GROUP BY 1")
def a1_variable_summary(spark, d):
    out = rounded(stats.summary(long(spark, d), "var_idx"), "mean", "sd", "min", "median", "max")
    return rounded(out, "cv", digits=4)


@query("SELECT label, count(*) AS n, count(*) >= 2 AS enough FROM embeddings GROUP BY 1")
def a2_class_counts(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), (F.count("*") >= 2).alias("enough"))


@query("SELECT c_custkey AS custkey, min(k) AS mode_priority FROM (SELECT o_custkey AS c_custkey, o_orderpriority AS k, count(*) AS n, max(count(*)) OVER (PARTITION BY o_custkey) AS most FROM orders GROUP BY 1, 2) WHERE n = most GROUP BY 1")
def a5_mode_per_id(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.mode("o_orderpriority", True).alias("mode_priority"))


@query("""WITH {DAY}, first AS (SELECT d FROM day GROUP BY 1 ORDER BY 1 LIMIT 5), ref AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM day WHERE d IN (SELECT d FROM first) GROUP BY 1)
 SELECT CAST(d AS VARCHAR) AS day, count(*) AS n, round(avg(abs(value - m) / s), 6) AS drift, round(100.0 * avg(CASE WHEN abs(value - m) > 2 * s THEN 1.0 ELSE 0.0 END), 6) AS outside FROM day JOIN ref USING (event_type) GROUP BY 1""")
def a6_batch_summary(spark, d):
    return rounded(_batches(spark, d), "drift", "outside").withColumn("day", F.col("day").cast("string"))


def _batches(spark, d):
    day = table(spark, d, "events").select(F.to_date("ts").alias("day"), "event_type", "value")
    first = day.select("day").distinct().orderBy("day").limit(5)
    ref = day.join(F.broadcast(first), "day", "left_semi").groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    off = F.abs(F.col("value") - F.col("m"))
    return day.join(ref, "event_type").groupBy("day").agg(F.count("*").alias("n"), F.avg(off / F.col("s")).alias("drift"), (100 * F.avg((off > 2 * F.col("s")).cast("double"))).alias("outside"))


_HEALTH = """WITH {DAY}, first AS (SELECT d FROM day GROUP BY 1 ORDER BY 1 LIMIT 5), ref AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM day WHERE d IN (SELECT d FROM first) GROUP BY 1),
 b AS (SELECT d, avg(abs(value - m) / s) AS drift, 100.0 * avg(CASE WHEN abs(value - m) > 2 * s THEN 1.0 ELSE 0.0 END) AS outside FROM day JOIN ref USING (event_type) GROUP BY 1),
 n AS (SELECT *, row_number() OVER (ORDER BY d) AS i FROM b), m AS (SELECT avg(drift) AS mu, greatest(coalesce(stddev_samp(drift), 0), 0.05 * greatest(abs(avg(drift)), 1e-9), 1e-9) AS sd FROM n WHERE i <= 5),
 s AS (SELECT n.*, sum((drift - mu) / sd - 0.5) OVER (ORDER BY d) AS s FROM n, m), c AS (SELECT *, s - least(0, min(s) OVER (ORDER BY d)) AS c FROM s)
 SELECT CAST(d AS VARCHAR) AS day, round(c, 5) AS cusum, CASE WHEN i <= 5 THEN 'reference' WHEN c > 5 OR coalesce(outside > 25 AND lag(outside) OVER (ORDER BY d) > 25, false) THEN 'retrain' WHEN c > 2.5 OR outside > 10 THEN 'watch' ELSE 'ok' END AS status FROM c"""


@query(_HEALTH)
def w4_health(spark, d):
    return charts.health(_batches(spark, d), "day", ["drift"]).select(F.col("day").cast("string").alias("day"), F.round("cusum", 5).alias("cusum"), "status")


@query("SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(coalesce(stddev_samp(o_totalprice), 0), 4) AS sd, round(min(o_totalprice), 4) AS best FROM orders GROUP BY 1, 2")
def a7_factor_summary(spark, d):
    p = F.col("o_totalprice")
    out = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.avg(p).alias("mean"), F.coalesce(F.stddev_samp(p), F.lit(0.0)).alias("sd"), F.min(p).alias("best"))
    return rounded(out, "mean", "sd", "best", digits=4)


@query("SELECT status, count(*) AS n FROM (SELECT o_orderstatus AS status FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200) GROUP BY 1")
def a8_top_composition(spark, d):
    top = table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(200)
    return top.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS priority, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS f, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS o, round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 4) AS p FROM orders GROUP BY 1")
def a9_factor_pivot(spark, d):
    out = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.avg("o_totalprice"))
    return rounded(out.toDF("priority", "f", "o", "p"), "f", "o", "p", digits=4)


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS quantity_price, round(corr(l_quantity, l_discount), 6) AS quantity_discount, round(corr(l_extendedprice, l_tax), 6) AS price_tax FROM lineitem")
def a10_correlation(spark, d):
    out = table(spark, d, "lineitem").agg(F.corr("l_quantity", "l_extendedprice").alias("quantity_price"), F.corr("l_quantity", "l_discount").alias("quantity_discount"), F.corr("l_extendedprice", "l_tax").alias("price_tax"))
    return rounded(out, *out.columns)


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY 1")
def a11_percentiles(spark, d):
    found = relational.quantiles(table(spark, d, "lineitem"), "l_extendedprice", {"p05": 0.05, "p50": 0.5, "p95": 0.95}, "l_returnflag")
    return rounded(found.drop("n"), "p05", "p50", "p95", digits=4)


@query("WITH {LONG}, m AS (SELECT vec_id, median(x) AS md FROM long GROUP BY 1) SELECT vec_id, round(min(md), 6) AS md, round(median(abs(x - md)), 6) AS mad FROM long JOIN m USING (vec_id) GROUP BY 1")
def a13_mad(spark, d):
    rows = long(spark, d)
    m = rows.groupBy("vec_id").agg(F.median("x").alias("md"))
    return rounded(rows.join(m, "vec_id").groupBy("vec_id").agg(F.min("md").alias("md"), F.median(F.abs(F.col("x") - F.col("md"))).alias("mad")), "md", "mad")


@query("WITH {LONG}, m AS (SELECT vec_id % 4 AS inst, var_idx, avg(x) AS m, var_pop(x) AS v FROM long GROUP BY 1, 2), p AS (SELECT a.inst AS a, b.inst AS b, sqrt(avg((a.m - b.m) * (a.m - b.m))) AS rms FROM m a JOIN m b ON a.var_idx = b.var_idx AND a.inst < b.inst GROUP BY 1, 2) SELECT round(avg(rms), 6) AS between_rms, round((SELECT sqrt(avg(v)) FROM m), 6) AS within_rms FROM p")
def a19_instrument_distance(spark, d):
    m = long(spark, d).groupBy((F.col("vec_id") % 4).alias("inst"), "var_idx").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    b = m.select(F.col("inst").alias("other"), F.col("var_idx").alias("at"), F.col("m").alias("mb"))
    pairs = m.join(b, (F.col("var_idx") == F.col("at")) & (F.col("inst") < F.col("other"))).groupBy("inst", "other").agg(F.sqrt(F.avg((F.col("m") - F.col("mb")) ** 2)).alias("rms"))
    return rounded(pairs.agg(F.avg("rms").alias("between_rms")).crossJoin(m.agg(F.sqrt(F.avg("v")).alias("within_rms"))), "between_rms", "within_rms")  # one row each


@query("WITH {LONG} SELECT count(DISTINCT vec_id) AS samples, count(*) AS cells, round(sum(x), 6) AS total, round(sum(x * x), 6) AS squares FROM long")
def a20_fingerprint(spark, d):
    x = F.col("x")
    return rounded(long(spark, d).agg(F.countDistinct("vec_id").alias("samples"), F.count("*").alias("cells"), F.sum(x).alias("total"), F.sum(x * x).alias("squares")), "total", "squares")


# ---- selections, joins, sets -------------------------------------------------------------------


@query("WITH {LONG} SELECT vec_id, var_idx, x FROM long WHERE NOT (var_idx BETWEEN 10 AND 20 OR var_idx BETWEEN 50 AND 55)")
def p4_crop(spark, d):
    return relational.crop(long(spark, d), "var_idx", [(20, 10), (50, 55)], keep=False).select("vec_id", "var_idx", "x")


@query("SELECT split_part(p_type, ' ', 2) AS finish, substring(p_brand, 7, 1) AS maker, count(*) AS n FROM part GROUP BY 1, 2")
def p11_p12_class_from_id(spark, d):
    return table(spark, d, "part").groupBy(F.split_part("p_type", F.lit(" "), F.lit(2)).alias("finish"), F.substring("p_brand", 7, 1).alias("maker")).agg(F.count("*").alias("n"))


@query("WITH {LONG}, k AS (SELECT vec_id, var_idx FROM long WHERE x > 0), g AS (SELECT *, CASE WHEN var_idx - lag(var_idx) OVER (PARTITION BY vec_id ORDER BY var_idx) > 3 THEN 1 ELSE 0 END AS fresh FROM k), r AS (SELECT *, sum(fresh) OVER (PARTITION BY vec_id ORDER BY var_idx) AS run FROM g) SELECT vec_id, CAST(min(var_idx) AS INTEGER) AS first, CAST(max(var_idx) AS INTEGER) AS last, count(*) AS n FROM r GROUP BY vec_id, run")
def p18_regions(spark, d):
    return relational.islands(long(spark, d).where("x > 0"), "var_idx", 3, "vec_id")


@query("WITH {LONG}, m AS (SELECT vec_id, avg(x) AS m FROM long GROUP BY 1) SELECT vec_id, round(m, 6) AS m FROM m WHERE m >= (SELECT quantile_cont(m, 0.25) FROM m)")
def p26_darkest(spark, d):
    m = long(spark, d).groupBy("vec_id").agg(F.avg("x").alias("m"))
    cut = m.agg(F.percentile("m", F.lit(0.25)).alias("cut"))
    return rounded(m.crossJoin(F.broadcast(cut)).where("m >= cut").select("vec_id", "m"), "m")  # one row


@query("SELECT label FROM embeddings GROUP BY 1 HAVING count(DISTINCT vec_id % 3) = (SELECT count(DISTINCT vec_id % 3) FROM embeddings)")
def p28_shared_classes(spark, d):
    return relational.shared_classes(table(spark, d, "embeddings").withColumn("inst", F.col("vec_id") % 3), "label", "inst")


@query("WITH r AS (SELECT l_orderkey, max((l_linenumber, l_returnflag))[2] AS flag FROM lineitem WHERE l_quantity > 25 GROUP BY 1) SELECT o_orderkey, coalesce(flag, 'no_class') AS flag FROM orders LEFT JOIN r ON o_orderkey = l_orderkey")
def j1_lookup_last_wins(spark, d):
    right = table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("at"), F.col("l_returnflag").alias("flag"))
    return relational.lookup(table(spark, d, "orders").select("o_orderkey"), right, "o_orderkey", "at", {"flag": "no_class"}).select("o_orderkey", "flag")


@query("SELECT d.doc_id, CAST(l.quality AS DOUBLE) AS y FROM documents d LEFT JOIN labels l USING (doc_id)")
def j2_reference_values(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id", "left")


@query("SELECT a.vec_id AS id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6) AS dot FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1")
def j4_blocks(spark, d):
    s = spectra(spark, d)
    b = s.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("id"), F.col("spectrum").alias("b"))
    return rounded(s.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), "spectrum").join(b, "id").select("id", arrays.dot(F.col("spectrum"), F.col("b")).alias("dot")), "dot")


@query("""WITH bands AS (SELECT i AS band, i * 1500.0 AS b_lo, i * 1500.0 + 700.0 + 400.0 * (i % 5) AS b_hi FROM range(0, 200) t(i)), regions AS (SELECT o_orderkey AS region, o_totalprice AS lo, o_totalprice + 500 + 10 * (o_custkey % 200) AS hi FROM orders),
 s AS (SELECT region, CAST(band AS BIGINT) AS band, (least(hi, b_hi) - greatest(lo, b_lo)) / least(hi - lo, b_hi - b_lo) AS score, b_hi - b_lo AS w FROM regions JOIN bands ON b_lo < hi AND lo < b_hi)
 SELECT region, band, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY score DESC, w, band) AS rank FROM s) WHERE rank <= 3""")
def j8_interval_join(spark, d):
    i = F.col("id")
    bands = spark.range(200).select(i.alias("band"), (i * 1500.0).alias("b_lo"), (i * 1500.0 + 700.0 + 400.0 * (i % 5)).alias("b_hi"))
    regions = table(spark, d, "orders").select(F.col("o_orderkey").alias("region"), F.col("o_totalprice").alias("lo"), (F.col("o_totalprice") + 500 + 10 * (F.col("o_custkey") % 200)).alias("hi"))
    return rounded(relational.overlaps(regions, bands).select("region", "band", "score", "rank"), "score")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def j9_semi(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j10_anti(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("WITH {LONG}, m AS (SELECT label AS c, var_idx, avg(x) AS m FROM long GROUP BY 1, 2), q AS (SELECT vec_id, label, c, sum((x - m) * (x - m)) AS d2 FROM long JOIN m USING (var_idx) GROUP BY 1, 2, 3) SELECT vec_id, label, arg_min(c, (d2, c)) AS nearest, round(min(d2), 6) AS d2 FROM q GROUP BY 1, 2")
def j12_nearest_class_mean(spark, d):
    rows = long(spark, d)
    m = rows.groupBy(F.col("label").alias("c"), "var_idx").agg(F.avg("x").alias("m"))
    q = rows.join(F.broadcast(m), "var_idx").groupBy("vec_id", "label", "c").agg(F.sum((F.col("x") - F.col("m")) ** 2).alias("d2"))
    best = q.groupBy("vec_id", "label").agg(F.min(F.struct("d2", "c")).alias("b"))
    return rounded(best.select("vec_id", "label", F.col("b.c").alias("nearest"), F.col("b.d2").alias("d2")), "d2")


@query("WITH {LONG}, t AS (SELECT vec_id, var_idx, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, var_idx) AS r FROM long) SELECT a.vec_id AS vec_id, count(b.var_idx) / (20.0 - count(b.var_idx)) AS jaccard FROM (SELECT * FROM t WHERE r <= 10) a LEFT JOIN (SELECT * FROM t WHERE r <= 10) b ON b.vec_id = a.vec_id + 1 AND a.var_idx = b.var_idx GROUP BY 1")
def u6_jaccard_top_sets(spark, d):
    top = F.slice(F.array_sort(F.transform("spectrum", lambda x, i: F.struct((-F.abs(x)).alias("a"), i.alias("i")))), 1, 10)
    s = spectra(spark, d).select("vec_id", F.transform(top, lambda t: t["i"]).alias("t"))
    b = s.select((F.col("vec_id") - 1).alias("vec_id"), F.col("t").alias("u"))
    both = F.size(F.array_intersect("t", F.coalesce("u", F.array().cast("array<int>"))))
    return s.join(b, "vec_id", "left").select("vec_id", (both / (20.0 - both)).alias("jaccard"))


@query("SELECT max(lo) AS lo, min(hi) AS hi FROM (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)")
def u5_common_range(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))


# ---- windows, charts, rankings ---------------------------------------------------------------------


def _series(spark, d):
    return charts.baseline(table(spark, d, "events").select("event_type", "event_id", "ts", "value"), "value", ["ts", "event_id"], 20, "event_type")


@query("WITH {SERIES} SELECT event_type, event_id, abs(z) > 3 AS r_1_3s, (count(z) OVER (PARTITION BY event_type ORDER BY n ROWS 1 PRECEDING) = 2 AND (min(z) OVER (PARTITION BY event_type ORDER BY n ROWS 1 PRECEDING) > 2 OR max(z) OVER (PARTITION BY event_type ORDER BY n ROWS 1 PRECEDING) < -2)) AS r_2_2s, coalesce(abs(z - lag(z) OVER (PARTITION BY event_type ORDER BY n)) > 4, false) AS r_4s, (count(z) OVER (PARTITION BY event_type ORDER BY n ROWS 3 PRECEDING) = 4 AND (min(z) OVER (PARTITION BY event_type ORDER BY n ROWS 3 PRECEDING) > 1 OR max(z) OVER (PARTITION BY event_type ORDER BY n ROWS 3 PRECEDING) < -1)) AS r_4_1s, (count(z) OVER (PARTITION BY event_type ORDER BY n ROWS 9 PRECEDING) = 10 AND (min(z) OVER (PARTITION BY event_type ORDER BY n ROWS 9 PRECEDING) > 0 OR max(z) OVER (PARTITION BY event_type ORDER BY n ROWS 9 PRECEDING) < 0)) AS r_10x FROM z")
def w2_westgard(spark, d):
    return charts.westgard(_series(spark, d), "event_type").select("event_type", "event_id", "r_1_3s", "r_2_2s", "r_4s", "r_4_1s", "r_10x")


@query("WITH {SERIES}, c AS (SELECT event_type, event_id, n, sum(z - 0.5) OVER (PARTITION BY event_type ORDER BY n) AS s FROM z) SELECT event_type, event_id, round(s - least(0, min(s) OVER (PARTITION BY event_type ORDER BY n)), 5) AS cusum FROM c")
def w3_cusum(spark, d):
    return rounded(charts.cusum(_series(spark, d), "event_type").select("event_type", "event_id", "cusum"), "cusum", digits=5)


@query("""WITH RECURSIVE {SERIES}, e AS (SELECT event_type, event_id, n, 0.2 * value + 0.8 * mu AS e, mu, sd FROM z WHERE n = 1 UNION ALL SELECT z.event_type, z.event_id, z.n, 0.2 * z.value + 0.8 * e.e, z.mu, z.sd FROM e JOIN z ON z.event_type = e.event_type AND z.n = e.n + 1)
 SELECT event_type, event_id, round(e, 6) AS ewma, round(mu + 3 * sd * sqrt(0.2 / 1.8 * (1 - pow(0.8, 2 * n))), 6) AS upper FROM e""")
def w1_ewma(spark, d):
    """Every row of every series."""
    return rounded(charts.ewma(_series(spark, d), "value", "event_type").select("event_type", "event_id", "ewma", "upper"), "ewma", "upper")


@query("WITH {LONG} SELECT vec_id, var_idx, round((coalesce(lag(x) OVER w, x) + x + coalesce(lead(x) OVER w, x)) / 3, 6) AS smooth FROM long WINDOW w AS (PARTITION BY vec_id ORDER BY var_idx)")
def w7_smooth3(spark, d):
    return rounded(signal.smooth3(long(spark, d), "vec_id").select("vec_id", "var_idx", "smooth"), "smooth")


@query("WITH {LONG}, n AS (SELECT vec_id, var_idx, list(x) OVER (PARTITION BY vec_id ORDER BY var_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l FROM long) SELECT vec_id, var_idx, round(list_sort(list_concat(l, list_transform(range(0, 5 - len(l)), lambda i: 0.0)))[3], 6) AS median FROM n")
def w8_running_median(spark, d):
    return rounded(signal.running_median(long(spark, d), 2, "vec_id").select("vec_id", "var_idx", "median"), "median")


@query("WITH r AS (SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT round(corr(a, b), 6) AS spearman FROM r")
def w10_spearman(spark, d):
    """Ranks come from running sums of counts of distinct values (relational.cumulative), so no task sees all rows or values."""
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"))
    for c in ("a", "b"):
        counts = rows.groupBy(c).agg(F.count("*").alias("n"))
        upto = relational.cumulative(counts, c, ["n"])
        rows = rows.join(upto.select(c, (F.col("upto_n") - (F.col("n") - 1) / 2).alias(f"r{c}")), c)
    return rounded(rows.agg(F.corr("ra", "rb").alias("spearman")), "spearman")


@query("SELECT custkey, o_orderkey, CAST(n AS INTEGER) AS n FROM (SELECT o_custkey AS custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n <= 10")
def w14_first_appearances(spark, d):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey", n.alias("n")).where("n <= 10")


@query("SELECT s_suppkey, round(s_acctbal, 2) AS s_acctbal, CAST(row_number() OVER (ORDER BY s_acctbal DESC NULLS LAST, s_nationkey DESC, s_suppkey) AS INTEGER) AS rank FROM supplier QUALIFY rank <= 50")
def t1_leaderboard(spark, d):
    top = table(spark, d, "supplier").orderBy(F.desc_nulls_last("s_acctbal"), F.desc("s_nationkey"), "s_suppkey").limit(50)
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last("s_acctbal"), F.desc("s_nationkey"), "s_suppkey"))  # 50 rows
    return top.select("s_suppkey", F.round("s_acctbal", 2).alias("s_acctbal"), rank.alias("rank"))


@query("WITH {LONG} SELECT var_idx, round(abs(100 * stddev_samp(x) / nullif(avg(x), 0)), 4) AS cv FROM long GROUP BY 1 ORDER BY cv DESC NULLS LAST, var_idx LIMIT 10")
def t12_most_variable(spark, d):
    out = stats.summary(long(spark, d), "var_idx").select("var_idx", F.round("cv", 4).alias("cv"))
    return out.orderBy(F.desc_nulls_last("cv"), "var_idx").limit(10)


# ---- models and reliability ------------------------------------------------------------------------


@query("WITH {LONG}, y AS (SELECT vec_id, avg(x) AS y FROM long WHERE var_idx < 8 GROUP BY 1) SELECT var_idx, round(covar_samp(x, y), 6) AS cov, round(corr(x, y), 6) AS r FROM long JOIN y USING (vec_id) GROUP BY 1")
def m34_s_plot(spark, d):
    rows = long(spark, d)
    y = rows.where("var_idx < 8").groupBy("vec_id").agg(F.avg("x").alias("y"))
    return rounded(rows.join(y, "vec_id").groupBy("var_idx").agg(F.covar_samp("x", "y").alias("cov"), F.corr("x", "y").alias("r")), "cov", "r")


@query("WITH {LONG}, g AS (SELECT var_idx, avg(x) AS g FROM long GROUP BY 1), l AS (SELECT label, var_idx, avg(x) AS m FROM long GROUP BY 1, 2) SELECT round(sum((m - g) * (m - g)), 5) AS ss_effect, round(sum((x - m) * (x - m)), 5) AS ss_residual, round(sum((x - g) * (x - g)), 5) AS ss_total FROM long JOIN l USING (label, var_idx) JOIN g USING (var_idx)")
def m35_asca(spark, d):
    return rounded(stats.asca_one_factor(long(spark, d), "label"), "ss_effect", "ss_residual", "ss_total", digits=5)


@query("WITH r AS (SELECT abs(l_extendedprice - 1500 * l_quantity) AS r FROM lineitem), k AS (SELECT count(*) AS n, CAST(ceil((count(*) + 1) * 0.9 - 1e-9) AS BIGINT) AS k FROM r) SELECT n, round((SELECT r FROM r ORDER BY r LIMIT 1 OFFSET (SELECT k - 1 FROM k)), 4) AS radius FROM k")
def m45_conformal(spark, d):
    r = table(spark, d, "lineitem").select((F.col("l_extendedprice") - 1500 * F.col("l_quantity")).alias("residual"))
    return rounded(models.conformal_radius(r, 0.1), "radius", digits=4)


_NEAREST = "{LONG}, m AS (SELECT label AS c, var_idx, avg(x) AS m FROM long GROUP BY 1, 2), q AS (SELECT vec_id, label, c, sum((x - m) * (x - m)) AS d2 FROM long JOIN m USING (var_idx) GROUP BY 1, 2, 3), p AS (SELECT label AS y, arg_min(c, (d2, c)) AS yhat FROM q GROUP BY vec_id, label)"


@query("WITH " + _NEAREST + ", c AS (SELECT DISTINCT y AS class FROM p UNION SELECT DISTINCT yhat FROM p), s AS (SELECT class, count(*) FILTER (y = class) AS sup, count(*) FILTER (yhat = class) AS pred, count(*) FILTER (y = class AND yhat = class) AS tp, count(*) AS n FROM c, p GROUP BY 1) SELECT class, sup AS support, round(coalesce(tp / nullif(pred, 0), 0), 6) AS precision, round(coalesce(tp / nullif(sup, 0), 0), 6) AS recall, round(coalesce((n - sup - pred + tp) / nullif(n - sup, 0), 0), 6) AS specificity, round(coalesce(2 * tp / nullif(sup + pred, 0), 0), 6) AS f1 FROM s")
def v2_class_metrics(spark, d):
    rows = j12_nearest_class_mean(spark, d).select(F.col("label").alias("y"), F.col("nearest").alias("yhat"))
    return rounded(models.class_metrics(rows), "precision", "recall", "specificity", "f1")


@query("WITH " + _NEAREST + " SELECT y, yhat, count(*) AS n FROM p GROUP BY 1, 2")
def a14_confusion(spark, d):
    return models.confusion(j12_nearest_class_mean(spark, d).select(F.col("label").alias("y"), F.col("nearest").alias("yhat")))


@query("WITH p AS (SELECT l_extendedprice AS y, 1500 * l_quantity AS h FROM lineitem) SELECT count(*) AS n, round(sqrt(avg((y - h) * (y - h))), 4) AS rmse, round(avg(abs(y - h)), 4) AS mae, round(1 - sum((y - h) * (y - h)) / (var_pop(y) * count(y)), 6) AS r2, round(stddev_samp(y) / sqrt(avg((y - h) * (y - h))), 6) AS rpd, round((quantile_cont(y, 0.75) - quantile_cont(y, 0.25)) / sqrt(avg((y - h) * (y - h))), 6) AS rpiq FROM p")
def v3_regression_metrics(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (1500 * F.col("l_quantity")).alias("yhat"))
    return rounded(rounded(models.regression_metrics(p), "rmse", "mae", digits=4), "r2", "rpd", "rpiq")


@query("WITH b AS (SELECT l_quantity AS threshold, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R') AS f FROM lineitem GROUP BY 1) SELECT threshold, round(sum(p) OVER (ORDER BY threshold DESC) / sum(p) OVER (), 6) AS tpr, round(sum(f) OVER (ORDER BY threshold DESC) / sum(f) OVER (), 6) AS fpr FROM b")
def v15_roc(spark, d):
    return rounded(models.roc(table(spark, d, "lineitem"), F.col("l_returnflag") == "R", "l_quantity"), "tpr", "fpr")


@query()
def m1_pca_t2_q(spark, d):
    df = spectra(spark, d)
    m = stats.pca(df, "spectrum", 5)
    return m.scored(df, "spectrum").select("vec_id", F.round("t2", 6).alias("t2"), F.round("q", 6).alias("q"), F.round("leverage", 8).alias("leverage"), ((F.col("t2") > m.t2_limit()) | (F.col("q") > m.q_limit())).alias("outlier"))


@query()
def m12_simca(spark, d):
    df = spectra(spark, d)
    classes = stats.simca(df, "spectrum", "label")
    assigned = stats.simca_assign(df, "spectrum", "vec_id", classes, limits=simca.limits(df, "vec_id", "spectrum", "label", classes))
    return stats.simca_label(assigned, "vec_id").select("vec_id", "label")


@query()
def l1_lda(spark, d):
    df = models.folds(spectra(spark, d), "vec_id", 5)
    names, model = models.lda(df.where("fold <> 0"), "spectrum", "label")
    return models.classify(df.where("fold = 0"), "spectrum", names, model).select("vec_id", "label", "yhat")


@query()
def l11_pls(spark, d):
    df = spectra(spark, d).withColumn("y", F.element_at("spectrum", 1) + 0.5 * F.element_at("spectrum", 9) - F.element_at("spectrum", 33))
    df = models.folds(df, "vec_id", 5)
    model = models.pls(df.where("fold <> 0"), "spectrum", ["y"], 6)
    return model.scores(df.where("fold = 0"), "spectrum").select("vec_id", F.round("y", 6).alias("y"), F.round(F.element_at("yhat", 1), 6).alias("yhat"))


@query("""WITH {LONG}, t AS (SELECT i, least(greatest(i, 3), 60) AS c FROM range(0, 64) u(i))
 SELECT vec_id, CAST(i AS INTEGER) AS var_idx, round(sum((var_idx - c) * x) / 28.0 + 2 * (i - c) * sum(((var_idx - c) * (var_idx - c) - 4) * x) / 84.0, 6) AS x FROM long JOIN t ON var_idx BETWEEN c - 3 AND c + 3 GROUP BY vec_id, i, c""")
def f9_savgol_derivative(spark, d):
    return rounded(signal.long_view(signal.savgol(spectra(spark, d), "spectrum", 64, 7, 2, 1), "spectrum", "vec_id"), "x")


@query()
def f5_emsc(spark, d):
    df = spectra(spark, d)
    _, mean, _ = stats.moments(df, "spectrum")
    return rounded(signal.long_view(signal.emsc(df, "spectrum", mean), "spectrum", "vec_id"), "x")


@query()
def f7_als_baseline(spark, d):
    return rounded(signal.long_view(signal.als_baseline(spectra(spark, d), "spectrum", 100.0), "spectrum", "vec_id"), "x")


@query()
def f8_despike(spark, d):
    return signal.long_view(signal.despike(spectra(spark, d), "spectrum"), "spectrum", "vec_id")


@query()
def f11_align(spark, d):
    df = spectra(spark, d)
    _, mean, _ = stats.moments(df, "spectrum")
    return signal.long_view(signal.align(df, "spectrum", mean, [0, 16, 32, 48, 64], 4), "spectrum", "vec_id")


@query("""WITH {LONG}, t AS (SELECT k, least(greatest(-1 + 65.0 * k / 39, 0), 63) AS pos FROM range(0, 40) u(k)), n AS (SELECT k, pos, least(floor(pos), 62) AS lo FROM t)
 SELECT vec_id, true AS outside, CAST(k AS INTEGER) AS var_idx, round(max(x) FILTER (var_idx = lo) * (1 - (pos - lo)) + max(x) FILTER (var_idx = lo + 1) * (pos - lo), 6) AS x FROM long JOIN n ON var_idx BETWEEN lo AND lo + 1 GROUP BY vec_id, k, pos, lo""")
def f12_interpolate(spark, d):
    return rounded(signal.long_view(signal.interpolate(spectra(spark, d), "spectrum", np.arange(64.0), np.linspace(-1, 64, 40)), "spectrum", "vec_id", "outside"), "x")


# earlier names of two queries that used to be cut short
for _alias, _name in {"w1_ewma_all": "w1_ewma", "f26_cube_blocks_all": "f26_cube_blocks"}.items():
    QUERIES[_alias], ORACLE_SQL[_alias] = QUERIES[_name], ORACLE_SQL[_name]
