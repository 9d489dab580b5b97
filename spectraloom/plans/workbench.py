"""Registered queries on named variables, selections, sets, rankings, charts and judgements; see registry for the tables' roles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spectraloom.functions import arrays
from spectraloom.operators import blocks, charts, domain, fusion, models, relational, reliability, screening, signal, stats, tabular
from spectraloom.plans.modelling import folded
from spectraloom.plans.registry import _HEALTH, _NEAREST, _batches, j12_nearest_class_mean, long, query, rounded, spectra, table
from spectraloom.plans.validation import _SETS

# ---- named variables ------------------------------------------------------------------------

_NUMBERS = "n AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_extendedprice AS b, l_discount + 1 AS c, l_tax + 1 AS d FROM lineitem)"


def _numbers(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_quantity", "l_extendedprice", F.col("l_discount") + 1, F.col("l_tax") + 1).alias("v"))


@query("WITH " + _NUMBERS + """, m AS (SELECT median(a) AS ma, median(b) AS mb, median(c) AS mc, median(d) AS md FROM n),
 f AS (SELECT n.*, a + b + c + d AS s, (SELECT median(x) FROM (SELECT unnest([a, b, c, d]) AS x)) AS md, (SELECT median(x) FROM (SELECT unnest([a / ma, b / mb, c / mc, d / m.md]) AS x)) AS q FROM n, m),
 l AS (SELECT median(s) AS ls, median(md) AS lm, median(q) AS lq FROM f)
 SELECT l_orderkey, l_linenumber, round(ln(b / s * ls), 6) AS by_sum, round(ln(b / md * lm), 6) AS by_median, round(ln(b / q * lq), 6) AS by_pqn FROM f, l""")
def f22_row_norms(spark, d):
    """Logarithms of normalised prices."""
    df = _numbers(spark, d)
    at = {k: F.ln(F.get(tabular.RowNorm.fit(df, "v", k).apply(F.col("v")), 1)).alias(f"by_{k}") for k in ("sum", "median", "pqn")}
    return rounded(df.select("l_orderkey", "l_linenumber", *at.values()), "by_sum", "by_median", "by_pqn")


@query("WITH f AS (SELECT min(c_acctbal) AS low, min(c_acctbal) FILTER (c_acctbal > 0) AS least FROM customer), o AS (SELECT CASE WHEN low > 0 THEN 0 ELSE least / 2 - low END AS o, power(least / 2, 2) AS lam FROM f) SELECT c_custkey, round(sqrt(greatest(c_acctbal + o, 1e-300)), 6) AS root, round(ln(greatest(c_acctbal + o, 1e-300)), 6) AS ln, round(ln((c_acctbal + sqrt(c_acctbal * c_acctbal + lam)) / 2), 4) AS glog FROM customer, o WHERE c_acctbal > 0")
def f23_fitted_transforms(spark, d):
    df = table(spark, d, "customer")
    by = {k: tabular.Transform.fit(df, "c_acctbal", k).apply(F.col("c_acctbal")) for k in ("sqrt", "ln", "glog")}
    out = df.where("c_acctbal > 0").select("c_custkey", by["sqrt"].alias("root"), by["ln"].alias("ln"), F.round(by["glog"], 4).alias("glog"))
    return rounded(out, "root", "ln")


@query("WITH {LONG}, f AS (SELECT var_idx, avg(x) AS m, stddev_samp(x) AS s FROM long WHERE vec_id % 2 = 0 GROUP BY 1) SELECT vec_id, var_idx, round((x - m) / s, 6) AS z FROM long JOIN f USING (var_idx) WHERE vec_id % 2 = 1")
def f25_fit_and_transform(spark, d):
    """Fitted on even rows, applied to odd ones."""
    rows = long(spark, d)
    out = tabular.Scaler.fit(rows.where("vec_id % 2 = 0")).apply(rows.where("vec_id % 2 = 1"))
    return rounded(out.select("vec_id", "var_idx", "z"), "z")


@query("WITH {LONG}, f AS (SELECT var_idx, avg(x) AS ref FROM long GROUP BY 1), c AS (SELECT vec_id, regr_slope(x, ref) AS b, regr_intercept(x, ref) AS a FROM long JOIN f USING (var_idx) GROUP BY 1) SELECT vec_id, var_idx, round((x - a) / CASE WHEN abs(b) < 1e-12 THEN 1e-12 ELSE b END * least(1, abs(b)), 5) AS x FROM long JOIN c USING (vec_id)")
def f4_msc_corrected(spark, d):
    """Corrected spectra; shrunk by slopes below 1, where rounding would show noise."""
    rows = long(spark, d)
    fit = signal.msc(rows, "vec_id")
    out = signal.msc_apply(rows, fit, "vec_id").join(fit, "vec_id").withColumn("x", F.col("x") * F.least(F.lit(1.0), F.abs("slope")))
    return rounded(out.select("vec_id", "var_idx", "x"), "x", digits=5)


@query("WITH {LONG}, p AS (SELECT vec_id, var_idx, abs(x) + 1 AS x FROM long), f AS (SELECT var_idx, median(x) AS ref FROM p GROUP BY 1), q AS (SELECT vec_id, median(x / ref) AS q FROM p JOIN f USING (var_idx) GROUP BY 1) SELECT vec_id, var_idx, round(x / q, 6) AS x FROM p JOIN q USING (vec_id)")
def f6_pqn_normalised(spark, d):
    rows = long(spark, d).withColumn("x", F.abs("x") + 1)
    return rounded(rows.join(signal.pqn(rows, "vec_id"), "vec_id").select("vec_id", "var_idx", (F.col("x") / F.col("quotient")).alias("x")), "x")


@query("SELECT p_partkey, round(1e7 / p_retailprice, 6) AS wavenumber, round(1e7 / (1e7 / p_retailprice), 6) AS nanometres FROM part")
def f31_axis_units(spark, d):
    other = lambda c: F.lit(1e7) / c
    x = F.col("p_retailprice")
    return rounded(table(spark, d, "part").select("p_partkey", other(x).alias("wavenumber"), other(other(x)).alias("nanometres")), "wavenumber", "nanometres")


@query("WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice - 1500 * l_quantity AS r FROM lineitem), s AS (SELECT stddev_samp(r) AS s FROM r) SELECT l_orderkey, l_linenumber, round(r / s, 6) AS z FROM r, s")
def f35_standardised_residual(spark, d):
    r = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") - 1500 * F.col("l_quantity")).alias("r"))
    s = r.agg(F.stddev_samp("r").alias("s"))
    return rounded(r.crossJoin(F.broadcast(s)).select("l_orderkey", "l_linenumber", (F.col("r") / F.col("s")).alias("z")), "z")  # one row


@query("WITH {LONG} SELECT vec_id, CAST(CASE WHEN var_idx < 28 THEN var_idx // 7 ELSE 4 + (var_idx - 28) // 6 END AS BIGINT) AS win, round(avg(x), 6) AS x FROM long GROUP BY 1, 2")
def f29_split_windows(spark, d):
    """Ten windows by the other rule: the first 64 mod 10 are one longer."""
    rows = long(spark, d).withColumn("win", signal.window_of(F.col("var_idx"), 64, 10, "split"))
    return rounded(rows.groupBy("vec_id", "win").agg(F.avg("x").alias("x")), "x")


# ---- selections -------------------------------------------------------------------------------


@query("SELECT d.doc_id, d.n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def p1_p24_active_rows(spark, d):
    """Rows that no exclusion table names; restoring one is taking it off that table."""
    excluded = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return table(spark, d, "documents").select("doc_id", "n_chars").join(excluded, "doc_id", "left_anti")


@query("WITH v AS (SELECT doc_id, CAST(quality AS DOUBLE) AS y FROM labels WHERE quality IS NOT NULL) SELECT doc_id, y FROM v WHERE (SELECT count(*) FROM v) >= 5")
def p10_valid_targets(spark, d):
    v = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("y")).where("y is not null and not isnan(y)")
    n = v.agg(F.count("*").alias("n"))
    return v.crossJoin(F.broadcast(n)).where("n >= 5").drop("n")  # one row


@query("SELECT CASE WHEN r > 1 THEN k || '_' || r ELSE k END AS id, o_orderkey FROM (SELECT CAST(o_custkey AS VARCHAR) AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)")
def p13_unique_ids(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey")
    return relational.unique_ids(rows, "id", "o_orderkey")


@query("WITH {LONG}, s AS (SELECT vec_id, avg(x) AS m, stddev_pop(x) AS sd FROM long GROUP BY 1) SELECT vec_id, var_idx, round((x - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS x FROM long JOIN s USING (vec_id) WHERE var_idx BETWEEN 10 AND 40")
def p14_crop_after_pretreatment(spark, d):
    rows = signal.long_view(spectra(spark, d).withColumn("spectrum", arrays.snv(F.col("spectrum"))), "spectrum", "vec_id")
    return rounded(relational.crop(rows, "var_idx", [(10, 40)]), "x")


@query("WITH {LONG} SELECT vec_id, CAST(list_position([3, 12, 13, 40], var_idx) - 1 AS INTEGER) AS place, round(x, 6) AS x FROM long WHERE var_idx IN (3, 12, 13, 40)")
def p16_selected_variables(spark, d):
    """A selection made on the crop 10-40 and variable 3, as places of the full axis (P15), applied as a projection (P16)."""
    crop, chosen = list(range(10, 41)), [2, 3, 30]
    full = [3, *[crop[i] for i in chosen]]
    picked = spectra(spark, d).withColumn("spectrum", arrays.pick(F.col("spectrum"), full))
    return rounded(signal.long_view(picked, "spectrum", "vec_id").withColumnRenamed("var_idx", "place"), "x")


@query("WITH {LONG}, r AS (SELECT var_idx, corr(x, label) AS r FROM long GROUP BY 1) SELECT var_idx, CAST(rank AS INTEGER) AS place, round(r, 6) AS r FROM (SELECT *, row_number() OVER (ORDER BY var_idx) AS rank FROM r WHERE abs(r) >= (SELECT quantile_cont(abs(r), 0.75) FROM r))")
def p17_selected_table(spark, d):
    r = long(spark, d).groupBy("var_idx").agg(F.corr("x", "label").alias("r"))
    cut = relational.quantiles(r.withColumn("a", F.abs("r")), "a", {"cut": 0.75})
    kept = r.crossJoin(F.broadcast(cut)).where("abs(r) >= cut")  # one row a variable
    return rounded(kept.select("var_idx", F.row_number().over(Window.orderBy("var_idx")).alias("place"), "r"), "r")


@query("WITH {LONG}, k AS (SELECT vec_id, var_idx, var_idx - row_number() OVER (PARTITION BY vec_id ORDER BY var_idx) AS g FROM long WHERE x < 0) SELECT vec_id, CAST(min(var_idx) AS INTEGER) AS first, CAST(max(var_idx) AS INTEGER) AS last, count(*) AS n FROM k GROUP BY vec_id, g")
def p19_blocks(spark, d):
    return relational.islands(long(spark, d).where("x < 0"), "var_idx", 1, "vec_id")


@query("""WITH {LONG}, f AS (SELECT var_idx, avg(x) AS m, stddev_samp(x) AS s FROM long GROUP BY 1), t AS (SELECT vec_id, sum(power((x - m) / s, 2)) FILTER (var_idx < 5) AS t2, sum(power((x - m) / s, 2)) FILTER (var_idx >= 5) AS q FROM long JOIN f USING (var_idx) GROUP BY 1)
 SELECT vec_id, t2 > 11.07 AND q > 77.93 AS t2_and_q, t2 > 11.07 OR q > 77.93 AS t2_or_q, t2 > 11.07 AS t2_only, q > 77.93 AS q_only FROM t""")
def p22_outlier_predicates(spark, d):
    """Two distances of autoscaled rows against fixed limits, by the four ways to join them."""
    z = signal.block_scale(long(spark, d), "auto")
    part = lambda c: F.sum(F.when(c, F.col("z") * F.col("z")))
    t = z.groupBy("vec_id").agg(part(F.col("var_idx") < 5).alias("t2"), part(F.col("var_idx") >= 5).alias("q"))
    a, b = F.col("t2") > 11.07, F.col("q") > 77.93
    return t.select("vec_id", (a & b).alias("t2_and_q"), (a | b).alias("t2_or_q"), a.alias("t2_only"), b.alias("q_only"))


@query("SELECT lang, count(*) AS n, count(l.doc_id) AS flagged, count(l.doc_id) > 0.3 * count(*) AS too_many FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l USING (doc_id) GROUP BY 1")
def p25_flagged_share(spark, d):
    flagged = table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit(1).alias("hit"))
    rows = table(spark, d, "documents").select("doc_id", "lang").join(flagged, "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count("hit").alias("flagged"), (F.count("hit") > 0.3 * F.count("*")).alias("too_many"))


@query("WITH {LONG}, t AS (SELECT vec_id, var_idx, CASE WHEN x > 2 THEN NULL ELSE x END AS x FROM long) SELECT vec_id FROM t GROUP BY 1 HAVING count(x) = count(*)")
def p27_all_finite(spark, d):
    values = F.transform("spectrum", lambda x: F.when(x <= 2, x))
    return spectra(spark, d).where(F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x))).select("vec_id")


@query("SELECT p_partkey, round(p_retailprice, 2) AS x FROM part")
def p29_axis_labels(spark, d):
    """Prices written as labels with a decimal comma, or with a thousands comma and a point, and read back."""
    two = F.format_number(F.round("p_retailprice", 2), 2)  # 1,234.50
    label = F.when(F.col("p_partkey") % 2 == 0, two).otherwise(F.translate(F.format_string("%.2f", F.round("p_retailprice", 2)), ".", ","))
    return table(spark, d, "part").select("p_partkey", F.round(relational.number_of(label), 2).alias("x"))


# ---- joins, levels, sets ------------------------------------------------------------------------


@query("WITH j AS (SELECT o_orderkey, o_totalprice, c_mktsegment AS segment, o_orderpriority AS priority FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'MACHINERY') SELECT segment, priority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM j GROUP BY 1, 2")
def j3_design_join(spark, d):
    """Orders with two factors, those without a level of one left out."""
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("segment"))
    j = relational.design(table(spark, d, "orders"), known, "o_custkey", ["segment"])
    return rounded(j.groupBy("segment", F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean")), "mean", digits=4)


@query("WITH l AS (SELECT o_orderpriority AS level, min(o_orderkey) AS first, count(*) AS n FROM orders GROUP BY 1) SELECT level, first, n FROM l WHERE (SELECT count(*) FROM l) BETWEEN 2 AND 12")
def a15_w12_levels(spark, d):
    return relational.levels(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "level"), "level", "o_orderkey").select("level", "first", "n")


@query("WITH " + _NEAREST.replace("GROUP BY vec_id, label)", "GROUP BY vec_id, label), a AS (SELECT vec_id, arg_min(c, (d2, c)) AS cluster FROM q GROUP BY 1)") + " SELECT cluster, var_idx, count(*) AS n, round(avg(x), 6) AS mean FROM long JOIN a USING (vec_id) GROUP BY 1, 2")
def a17_cluster_profile(spark, d):
    near = j12_nearest_class_mean(spark, d).select("vec_id", F.col("nearest").alias("cluster"))
    return rounded(long(spark, d).join(near, "vec_id").groupBy("cluster", "var_idx").agg(F.count("*").alias("n"), F.avg("x").alias("mean")), "mean")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_type, value FROM events WHERE event_id % 3 <> 0) GROUP BY 1")
def u1_append_batches(spark, d):
    e = table(spark, d, "events")
    both = e.where("event_id % 3 = 0").unionByName(e.where("event_id % 3 <> 0").select(*reversed(e.columns)))
    return rounded(both.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total", digits=4)


@query("WITH s AS (" + _SETS.replace("SELECT vec_id, count(*) FILTER", "SELECT vec_id, label, count(*) FILTER").replace("WHERE vec_id % 2 = 1 GROUP BY 1", "WHERE vec_id % 2 = 1 GROUP BY 1, 2") + ") SELECT label, count(*) AS n, count(*) FILTER (classes = CAST(label AS VARCHAR)) AS exact, round(avg(CASE WHEN classes = CAST(label AS VARCHAR) THEN 1.0 ELSE 0.0 END), 6) AS share FROM s GROUP BY 1")
def u8_m17_exact_sets(spark, d):
    """How often the set of accepting classes is the own class alone."""
    q, limits = _distances(spark, d)
    sets = reliability.conformal_sets(q.where("vec_id % 2 = 1"), "vec_id", "c", "d2", limits)
    own = table(spark, d, "embeddings").select("vec_id", "label")
    exact = F.col("classes") == F.array("label")
    out = sets.join(own, "vec_id").groupBy("label").agg(F.count("*").alias("n"), F.count_if(exact).alias("exact"), F.avg(exact.cast("double")).alias("share"))
    return rounded(out, "share")


def _distances(spark, d):
    rows = long(spark, d)
    m = rows.groupBy(F.col("label").alias("c"), "var_idx").agg(F.avg("x").alias("m"))  # classes x variables, whatever the number of rows
    q = rows.join(F.broadcast(m), "var_idx").groupBy("vec_id", "label", "c").agg(F.round(F.sum((F.col("x") - F.col("m")) ** 2), 6).alias("d2"))
    return q, reliability.class_thresholds(q.where("label = c AND vec_id % 2 = 0"), "c", "d2", 0.1)


_ACCEPT = _SETS[: _SETS.rindex("SELECT vec_id, count(*)")]


@query(_ACCEPT + " SELECT c, round(avg(CASE WHEN d2 <= threshold THEN 1.0 ELSE 0.0 END) FILTER (label = c), 6) AS sensitivity, round(avg(CASE WHEN d2 > threshold THEN 1.0 ELSE 0.0 END) FILTER (label <> c), 6) AS specificity, count(*) FILTER (label <> c AND d2 <= threshold) AS false_alarms, count(*) FILTER (label = c AND d2 > threshold) AS missed, round(sqrt(avg(CASE WHEN d2 <= threshold THEN 1.0 ELSE 0.0 END) FILTER (label = c) * avg(CASE WHEN d2 > threshold THEN 1.0 ELSE 0.0 END) FILTER (label <> c)), 6) AS efficiency FROM q JOIN t USING (c) WHERE vec_id % 2 = 1 GROUP BY 1")
def m16_m17_acceptance(spark, d):
    q, limits = _distances(spark, d)
    judged = q.where("vec_id % 2 = 1").join(limits, "c").select("c", (F.col("label") == F.col("c")).alias("own"), (F.col("d2") <= F.col("threshold")).alias("inside"))
    return rounded(reliability.acceptance(judged, "c"), "sensitivity", "specificity", "efficiency")


# ---- rankings -----------------------------------------------------------------------------------

_WINDOWS = "{LONG}, r AS (SELECT var_idx, abs(corr(x, label)) AS r FROM long GROUP BY 1)"


@query("WITH " + _WINDOWS + ", w AS (SELECT ((var_idx + 1) * 16 - 1) // 64 AS win, avg(r) AS importance FROM r GROUP BY 1) SELECT CAST(win AS BIGINT) AS win, round(importance, 6) AS importance FROM w ORDER BY importance DESC, win LIMIT 4")
def t5_top_windows(spark, d):
    """The best quarter of 16 windows by mean importance."""
    r = long(spark, d).groupBy("var_idx").agg(F.abs(F.corr("x", "label")).alias("r"))
    w = r.groupBy(signal.window_of(F.col("var_idx"), 64, 16).alias("win")).agg(F.avg("r").alias("importance"))
    return rounded(w.orderBy(F.desc("importance"), "win").limit(4), "importance")


@query("""WITH {LONG}, s AS (SELECT vec_id, var_idx, (coalesce(lag(x) OVER w, x) + x + coalesce(lead(x) OVER w, x)) / 3 AS s FROM long WINDOW w AS (PARTITION BY vec_id ORDER BY var_idx)),
 c AS (SELECT vec_id, quantile_cont(s, 0.75) AS cut FROM s GROUP BY 1), h AS (SELECT vec_id, var_idx, s, var_idx - row_number() OVER (PARTITION BY vec_id ORDER BY var_idx) AS run FROM s JOIN c USING (vec_id) WHERE s >= cut),
 r AS (SELECT vec_id, min(var_idx) AS first, max(var_idx) AS last, count(*) AS n, max(s) AS height, min(var_idx) FILTER (s = m) AS peak FROM (SELECT *, max(s) OVER (PARTITION BY vec_id, run) AS m FROM h) GROUP BY vec_id, run)
 SELECT vec_id, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, n, CAST(peak AS INTEGER) AS peak, round(height, 6) AS height, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY height DESC, first) AS place FROM r) WHERE place <= 15""")
def p20_high_regions(spark, d):
    return rounded(signal.high_regions(long(spark, d), "vec_id"), "height")


@query("WITH {LONG}, y AS (SELECT vec_id, avg(x) AS y FROM long WHERE var_idx < 8 GROUP BY 1), m AS (SELECT var_idx, covar_samp(x, y) AS cov, corr(x, y) AS r FROM long JOIN y USING (vec_id) GROUP BY 1) SELECT var_idx, round(abs(cov) * abs(r), 8) AS score FROM m ORDER BY abs(cov) * abs(r) DESC, var_idx LIMIT 12")
def t6_top_markers(spark, d):
    rows = long(spark, d)
    y = rows.where("var_idx < 8").groupBy("vec_id").agg(F.avg("x").alias("y"))
    m = rows.join(y, "vec_id").groupBy("var_idx").agg((F.abs(F.covar_samp("x", "y")) * F.abs(F.corr("x", "y"))).alias("score"))
    return rounded(m.orderBy(F.desc("score"), "var_idx").limit(12), "score", digits=8)


@query("WITH {LONG}, g AS (SELECT var_idx, avg(x) AS g FROM long GROUP BY 1), e AS (SELECT label, var_idx, avg(x) - g AS effect FROM long JOIN g USING (var_idx) GROUP BY label, var_idx, g) SELECT label, var_idx, round(effect, 6) AS effect FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY abs(effect) DESC, var_idx) AS k FROM e) WHERE k <= 5")
def t7_top_effects(spark, d):
    """The largest 5 % of a level's effects, five at least."""
    rows = long(spark, d)
    g = rows.groupBy("var_idx").agg(F.avg("x").alias("g"))
    e = rows.groupBy("label", "var_idx").agg(F.avg("x").alias("m")).join(F.broadcast(g), "var_idx").withColumn("effect", F.col("m") - F.col("g"))
    k = F.row_number().over(Window.partitionBy("label").orderBy(F.abs("effect").desc(), "var_idx"))
    return rounded(e.withColumn("k", k).where(F.col("k") <= max(5, round(0.05 * 64))).select("label", "var_idx", "effect"), "effect")


@query("WITH {LONG} SELECT vec_id, var_idx, round(x, 6) AS x FROM long WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 10) AND var_idx < 40")
def t9_s6_preview(spark, d):
    """The first 10 rows and 40 variables, as a preview shows them."""
    first = spectra(spark, d).orderBy("vec_id").limit(10)
    return rounded(signal.long_view(first.withColumn("spectrum", F.slice("spectrum", 1, 40)), "spectrum", "vec_id"), "x")


@query("WITH q AS (SELECT l_linenumber AS k, avg(l_discount) AS q2 FROM lineitem GROUP BY 1) SELECT min(k) AS k FROM q WHERE q2 >= (SELECT max(q2) FROM q) - 0.0002")
def t11_fewest_components(spark, d):
    q = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.avg("l_discount").alias("q2"))
    return models.fewest(q, "k", "q2", 0.0002)


@query("WITH {LONG}, a AS (SELECT var_idx, abs(corr(x, label)) AS a, var_pop(x) AS b FROM long GROUP BY 1), s AS (SELECT var_idx, (rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0) / 64 AS sa, (rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0) / 64 AS sb FROM a) SELECT var_idx, round((sa + sb) / 2, 6) AS consensus, CASE WHEN sa >= 0.75 AND sb >= 0.75 THEN 'both' WHEN sa >= 0.75 THEN 'first' WHEN sb >= 0.75 THEN 'second' ELSE 'none' END AS category FROM s")
def m26_consensus(spark, d):
    a = long(spark, d).groupBy("var_idx").agg(F.abs(F.corr("x", "label")).alias("a"), F.var_pop("x").alias("b"))
    return rounded(reliability.consensus(a, "var_idx", "a", "b"), "consensus")


# ---- charts and judgements ----------------------------------------------------------------------


@query(f"SELECT count(*) = 3 AND bool_and(status NOT IN ('ok', 'reference')) AS alarm, count(*) AS runs FROM (SELECT * FROM ({_HEALTH}) ORDER BY day DESC LIMIT 3)")
def w5_last_runs(spark, d):
    """Whether the last three batches are all out of order."""
    last = charts.health(_batches(spark, d), "day", ["drift"]).orderBy(F.desc("day")).limit(3)
    bad = F.bool_and(~F.col("status").isin("ok", "reference"))
    return last.agg(((F.count("*") == 3) & bad).alias("alarm"), F.count("*").alias("runs"))


@query("WITH {SERIES}, r AS (SELECT event_type, event_id, CASE WHEN abs(z) > 3 THEN 'ACTION' WHEN abs(z) > 2 THEN 'warning' ELSE 'ok' END AS status FROM z) SELECT event_type, status, count(*) AS n FROM r GROUP BY 1, 2")
def m52_run_status(spark, d):
    from spectraloom.plans.registry import _series

    return charts.status(_series(spark, d), F.abs("z"), 2.0, 3.0).groupBy("event_type", "status").agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT 1500 * l_quantity AS h, abs(l_extendedprice - 1500 * l_quantity) AS r FROM lineitem), c AS (SELECT quantile_cont(h, 1.0 / 3) AS a, quantile_cont(h, 2.0 / 3) AS b FROM p), g AS (SELECT CASE WHEN h <= a THEN 0 WHEN h <= b THEN 1 ELSE 2 END AS tercile, r FROM p, c), n AS (SELECT tercile, r, row_number() OVER (PARTITION BY tercile ORDER BY r) AS k, count(*) OVER (PARTITION BY tercile) AS n FROM g) SELECT CAST(tercile AS INTEGER) AS tercile, n, round(min(r) FILTER (k >= ceil((n + 1) * 0.9 - 1e-9)), 4) AS radius FROM n GROUP BY 1, 2")
def m45_terciles(spark, d):
    """Conformal radii by tercile of the prediction."""
    p = table(spark, d, "lineitem").select((1500 * F.col("l_quantity")).alias("yhat"), (F.col("l_extendedprice") - 1500 * F.col("l_quantity")).alias("residual"))
    return rounded(reliability.tercile_radii(p, "yhat", "residual", 0.1), "radius", digits=4)


@query("WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice - 1500 * l_quantity AS r FROM lineitem), f AS (SELECT count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS sxx, stddev_samp(r) AS s FROM p) SELECT l_orderkey, l_linenumber, round(1.0 / n + (x - m) * (x - m) / sxx, 10) AS leverage, 1.0 / n + (x - m) * (x - m) / sxx > 3 * 2.0 / n AS far, abs(r / s) > 3 AS off FROM p, f")
def m19_williams(spark, d):
    """Leverage of one variable with its limit 3 (k + 1) / n, and residuals beyond three deviations."""
    x, r = F.col("l_quantity"), F.col("l_extendedprice") - 1500 * F.col("l_quantity")
    p = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"), r.alias("r"))
    f = p.agg(F.count("*").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("*")).alias("sxx"), F.stddev_samp("r").alias("s"))
    lever = 1 / F.col("n") + (F.col("x") - F.col("m")) ** 2 / F.col("sxx")
    out = p.crossJoin(F.broadcast(f))  # one row
    return out.select("l_orderkey", "l_linenumber", F.round(lever, 10).alias("leverage"), (lever > 6 / F.col("n")).alias("far"), (F.abs(F.col("r") / F.col("s")) > 3).alias("off"))


@query("""WITH {LONG}, p AS (SELECT vec_id, label, max(x) FILTER (var_idx = 0) AS a, max(x) FILTER (var_idx = 1) AS b FROM long GROUP BY 1, 2), w AS (SELECT sum(n * va) AS waa, sum(n * vb) AS wbb, sum(n * ab) AS wab FROM (SELECT label, count(*) AS n, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS ab FROM p GROUP BY 1)),
 t AS (SELECT count(*) * var_pop(a) AS taa, count(*) * var_pop(b) AS tbb, count(*) * covar_pop(a, b) AS tab FROM p) SELECT round(1 - (waa * wbb - wab * wab) / (taa * tbb - tab * tab), 6) AS separation FROM w, t""")
def m20_wilks(spark, d):
    """1 - Wilks' lambda of the classes in the first two variables."""
    df = spectra(spark, d).withColumn("v", F.slice("spectrum", 1, 2))
    return spark.createDataFrame([(round(stats.wilks_separation(stats.moments_by(df, "v", "label")), 6),)], "separation double")


@query("WITH " + _NEAREST + """, c AS (SELECT class, count(*) FILTER (y = class) AS s, count(*) FILTER (yhat = class) AS p, count(*) FILTER (y = class AND yhat = class) AS tp FROM (SELECT DISTINCT y AS class FROM p UNION SELECT DISTINCT yhat FROM p), p GROUP BY 1),
 o AS (SELECT CAST(sum(s) AS DOUBLE) AS n, CAST(sum(tp) AS DOUBLE) AS r, CAST(sum(s * p) AS DOUBLE) AS sp, CAST(sum(s * s) AS DOUBLE) AS ss, CAST(sum(p * p) AS DOUBLE) AS pp, avg(tp / nullif(s, 0)) AS ba, avg(coalesce(tp / nullif(p, 0), 0)) AS mp, avg(coalesce(tp / nullif(s, 0), 0)) AS mr, avg(coalesce(2 * tp / nullif(s + p, 0), 0)) AS mf FROM c)
 SELECT CAST(n AS BIGINT) AS n, round(r / n, 6) AS accuracy, round(ba, 6) AS balanced_accuracy, round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall, round(mf, 6) AS macro_f1, round(coalesce((r * n - sp) / nullif(n * n - sp, 0), 0), 6) AS kappa, round(coalesce((r * n - sp) / nullif(sqrt(n * n - pp) * sqrt(n * n - ss), 0), 0), 6) AS mcc FROM o""")
def v2_overall_metrics(spark, d):
    rows = j12_nearest_class_mean(spark, d).select(F.col("label").alias("y"), F.col("nearest").alias("yhat"))
    return rounded(models.overall(rows), "accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1", "kappa", "mcc")


@query("WITH " + _NEAREST[: _NEAREST.index(", p AS")].replace("sum((x - m) * (x - m)) AS d2", "round(sum((x - m) * (x - m)), 6) AS d2") + ", r AS (SELECT c, label = c AS pos, rank() OVER (PARTITION BY c ORDER BY -d2) + (count(*) OVER (PARTITION BY c, d2) - 1) / 2.0 AS r FROM q) SELECT c, round((sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 6) AS auc FROM r GROUP BY 1")
def v2_auc_by_class(spark, d):
    """One class against the rest, by the distance from its mean."""
    q, _ = _distances(spark, d)
    return rounded(models.auc(q.withColumn("s", -F.col("d2")), F.col("label") == F.col("c"), "s", "c"), "auc")


@query("WITH k AS (SELECT least(5, min(n)) AS k FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)) SELECT vec_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % k AS INTEGER) AS fold FROM embeddings, k")
def v1_stratified_folds(spark, d):
    return models.stratified(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label", 5)


@query("SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) % 4 = 0 AS test FROM embeddings")
def v4_stratified_split(spark, d):
    """Every fourth row of a class is held out."""
    dealt = relational.cumulative(table(spark, d, "embeddings").select("vec_id", "label").withColumn("one", F.lit(1)), "vec_id", ["one"], "label")
    return dealt.select("vec_id", "label", (F.col("upto_one") % 4 == 0).alias("test"))


@query("""WITH e AS (SELECT l_linenumber AS fold, sqrt(avg(power(l_extendedprice - 1500 * l_quantity, 2))) AS a, sqrt(avg(power(l_extendedprice - 1450 * l_quantity, 2))) AS b, sqrt(avg(power(l_extendedprice - 1400 * l_quantity, 2))) AS c FROM lineitem GROUP BY 1),
 p AS (SELECT 'a' AS one, 'b' AS other, a - b AS d FROM e UNION ALL SELECT 'a', 'c', a - c FROM e UNION ALL SELECT 'b', 'c', b - c FROM e) SELECT one, other, count(*) AS n, round(avg(d), 4) AS difference, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) AS t FROM p GROUP BY 1, 2""")
def v9_v10_pairwise(spark, d):
    """Paired t of the errors by fold, for every two of three models; models.pairwise adds p and a finding in words."""
    e = lambda slope: F.sqrt(F.avg((F.col("l_extendedprice") - slope * F.col("l_quantity")) ** 2))
    by = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("fold")).agg(e(1500).alias("a"), e(1450).alias("b"), e(1400).alias("c"))
    return rounded(models.pairwise(by, ["a", "b", "c"]).select("one", "other", "n", "difference", "t"), "difference", "t", digits=4)


_TEST = "t AS (SELECT vec_id, label, embedding AS e FROM embeddings WHERE vec_id % 5 = 0), r AS (SELECT vec_id AS k, label AS y, embedding AS f FROM embeddings WHERE vec_id % 5 <> 0)"


@query("WITH " + _TEST + ", d AS (SELECT vec_id, k, y, list_sum(list_transform(list_zip(e, f), lambda p: power(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2))) AS d FROM t, r), n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS i FROM d), v AS (SELECT vec_id, y, count(*) AS c FROM n WHERE i <= 5 GROUP BY 1, 2) SELECT vec_id, arg_min(y, (-c, y)) AS yhat FROM v GROUP BY 1")
def l9_knn(spark, d):
    """A fifth of the rows against all others, five neighbours."""
    df = spectra(spark, d)
    return models.knn(df.where("vec_id % 5 = 0"), df.where("vec_id % 5 <> 0"), "vec_id", "label", "spectrum", 5)


# ---- models on second moments -------------------------------------------------------------------


@query()
def l2_pls_da(spark, d):
    """Discriminant PLS with softmax shares: fold 0 by a model of the others."""
    df = folded(spark, d)
    names, model = models.pls_da(df.where("fold <> 0"), "spectrum", "label", 6)
    out = models.classify(df.where("fold = 0"), "spectrum", names, model)
    return out.select("vec_id", "label", "yhat", F.round(F.array_max(arrays.softmax(F.col("scores"))), 6).alias("share"))


@query()
def m47_domain(spark, d):
    df = folded(spark, d)
    return rounded(domain.fit(df.where("fold <> 0"), "spectrum").judged(df.where("fold = 0"), "spectrum").select("vec_id", "h", "q", "distance", "verdict"), "h", "q", "distance")


@query()
def m13_m16_dd_simca(spark, d):
    """Class models with the combined distance, summed up on rows they have not seen."""
    df = folded(spark, d)
    found = domain.accepted(df.where("fold = 0"), "spectrum", "vec_id", domain.class_models(df.where("fold <> 0"), "spectrum", "label"), 0.05, "label")
    judged = found.select("class", (F.col("label") == F.col("class")).alias("own"), "inside")
    return rounded(reliability.acceptance(judged, "class"), "sensitivity", "specificity", "efficiency")


@query()
def m50_control_baseline(spark, d):
    """A baseline of the first 60 rows, as a control series has; all rows judged by it."""
    df = spectra(spark, d)
    b = domain.baseline(df.orderBy("vec_id").limit(60), "spectrum")
    return rounded(b.judged(df, "spectrum").select("vec_id", "t2", "q", "status"), "t2", "q")


@query()
def m53_run_residuals(spark, d):
    df = spectra(spark, d)
    b = domain.baseline(df.orderBy("vec_id").limit(60), "spectrum")
    return rounded(signal.long_view(b.residuals(df, "spectrum"), "residual", "vec_id"), "x")


@query()
def v14_t1_screening(spark, d):
    found = screening.screen(folded(spark, d), "spectrum", "y", "fold", ["none", "snv", "unit"], [2, 4, 6], [1.0, 0.5])
    return rounded(screening.ranked(found).drop("error"), "rmse", "r2")


@query()
def v13_genetic_selection(spark, d):
    by = fusion.sums_by(folded(spark, d), ["spectrum"], "y", F.col("fold"))
    mask = screening.genetic(by, 4, population=16, generations=10)
    return spark.createDataFrame([(i, bool(m)) for i, m in enumerate(mask)], "var_idx int, kept boolean")


@query()
def v6_halving_search(spark, d):
    by = fusion.sums_by(folded(spark, d), ["spectrum"], "y", F.col("fold"))
    best = screening.halving(by, [{"components": k} for k in range(1, 9)])
    return spark.createDataFrame([(i + 1, s["components"]) for i, s in enumerate(best)], "place int, components int")


@query()
def m33_t11_component_curve(spark, d):
    """OPLS by its orthogonal components, and the fewest of them within 0.02 of the best Q2."""
    curve = blocks.opls_curve(fusion.sums_by(folded(spark, d), ["spectrum"], "y", F.col("fold")))
    rows = spark.createDataFrame(curve, "components int, q2 double, r2 double")
    return rounded(rows.crossJoin(F.broadcast(models.fewest(rows, "components", "q2", 0.02).withColumnRenamed("components", "chosen"))), "q2", "r2")


@query()
def m22_pc_combinations(spark, d):
    found = screening.pc_combinations(fusion.sums_by(folded(spark, d), ["spectrum"], "y", F.col("fold")))
    return rounded(spark.createDataFrame([(i + 1, ",".join(str(c + 1) for c in combo), q2) for i, (combo, q2) in enumerate(found[:12])], "place int, components string, q2 double"), "q2")


@query("""WITH {LONG}, c AS (SELECT vec_id % 2 AS a, vec_id // 2 % 5 AS b, var_idx, x FROM long), g AS (SELECT var_idx, avg(x) AS g FROM c GROUP BY 1), ma AS (SELECT a, var_idx, avg(x) AS ma FROM c GROUP BY 1, 2), mb AS (SELECT b, var_idx, avg(x) AS mb FROM c GROUP BY 1, 2), mc AS (SELECT a, b, var_idx, avg(x) AS mc FROM c GROUP BY 1, 2, 3)
 SELECT round(sum(power(ma - g, 2)), 5) AS ss_a, round(sum(power(mb - g, 2)), 5) AS ss_b, round(sum(power(mc - ma - mb + g, 2)), 5) AS ss_ab, round(sum(power(x - mc, 2)), 5) AS ss_residual, round(sum(power(x - g, 2)), 5) AS ss_total FROM c JOIN g USING (var_idx) JOIN ma USING (a, var_idx) JOIN mb USING (b, var_idx) JOIN mc USING (a, b, var_idx)""")
def m35_asca_two_factors(spark, d):
    """Two crossed factors with as many rows in each cell, so that the order of the factors does not matter."""
    df = spectra(spark, d).withColumns({"a": F.col("vec_id") % 2, "b": F.floor(F.col("vec_id") / 2) % 5})
    return spark.createDataFrame([{k: round(v, 5) for k, v in stats.asca(df, "spectrum", "a", "b").items()}], "ss_a double, ss_b double, ss_ab double, ss_residual double, ss_total double")


@query("WITH i AS (SELECT vec_id % 4 AS inst, CAST(e AS DOUBLE) AS x FROM (SELECT vec_id, unnest(embedding) AS e FROM embeddings)) SELECT 'pooled' AS training, count(*) AS cells, round(sum(x), 5) AS total FROM i WHERE inst <> 0 UNION ALL SELECT CAST(inst AS VARCHAR), count(*), round(sum(x), 5) FROM i GROUP BY 1")
def u2_pooled_training(spark, d):
    """Rows of all instruments but the first, pooled, beside those of each."""
    x = signal.long_view(spectra(spark, d).withColumn("inst", F.col("vec_id") % 4), "spectrum", "inst")
    both = x.where("inst <> 0").select(F.lit("pooled").alias("training"), "x").unionByName(x.select(F.col("inst").cast("string").alias("training"), "x"))
    return rounded(both.groupBy("training").agg(F.count("*").alias("cells"), F.sum("x").alias("total")), "total", digits=5)


# ---- peaks, noise, instruments ------------------------------------------------------------------


@query("""WITH {LONG}, s AS (SELECT vec_id, var_idx AS i, (coalesce(lag(x) OVER w, x) + x + coalesce(lead(x) OVER w, x)) / 3 AS s FROM long WINDOW w AS (PARTITION BY vec_id ORDER BY var_idx)),
 p AS (SELECT * FROM (SELECT *, lag(s) OVER w AS a, lead(s) OVER w AS b FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY i)) WHERE s > a AND s > b),
 e AS (SELECT p.vec_id, p.i, p.s, coalesce(max(q.i) FILTER (q.i < p.i AND q.s > p.s), -1) AS l, coalesce(min(q.i) FILTER (q.i > p.i AND q.s > p.s), 64) AS r FROM p JOIN s q USING (vec_id) GROUP BY 1, 2, 3),
 m AS (SELECT e.vec_id, e.i, e.s, e.s - greatest(min(q.s) FILTER (q.i > l AND q.i <= e.i), min(q.s) FILTER (q.i >= e.i AND q.i < r)) AS prominence FROM e JOIN s q USING (vec_id) GROUP BY 1, 2, 3),
 t AS (SELECT vec_id, max(s) AS top, arg_max(i, (s, -i)) AS top_i FROM s GROUP BY 1), h AS (SELECT m.* FROM m JOIN t USING (vec_id) WHERE prominence >= 0.05 * top),
 f AS (SELECT * FROM h UNION ALL SELECT vec_id, top_i, top, NULL FROM t WHERE vec_id NOT IN (SELECT vec_id FROM h))
 SELECT vec_id, CAST(i AS INTEGER) AS position, round(s, 6) AS height, round(prominence, 6) AS prominence, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, i) AS place FROM f) WHERE place <= 10""")
def p21_peaks(spark, d):
    return rounded(signal.peaks(spectra(spark, d), "spectrum", "vec_id"), "height", "prominence")


@query("""WITH {LONG}, c AS (SELECT *, least(greatest(var_idx, 5), 58) AS c FROM long),
 r AS (SELECT a.vec_id, a.var_idx, a.x - sum(b.x * (1 / 11.0::DOUBLE + (a.var_idx - a.c) * (b.var_idx - a.c) / 110.0::DOUBLE + (power(a.var_idx - a.c, 2) - 10) * (power(b.var_idx - a.c, 2) - 10) / 858.0::DOUBLE)) AS e FROM c a JOIN long b ON a.vec_id = b.vec_id AND b.var_idx BETWEEN a.c - 5 AND a.c + 5 GROUP BY a.vec_id, a.var_idx, a.x),
 n AS (SELECT vec_id, stddev_pop(e) AS noise FROM r GROUP BY 1), h AS (SELECT vec_id, max(x) - quantile_cont(x, 0.05) AS height FROM long WHERE var_idx BETWEEN 20 AND 40 GROUP BY 1)
 SELECT vec_id, round(noise, 6) AS noise, round(height / noise, 5) AS snr FROM n JOIN h USING (vec_id)""")
def m51_noise(spark, d):
    out = reliability.noise(spectra(spark, d), "spectrum", 64, "vec_id", low=20, high=40)
    return rounded(out, "noise").withColumn("snr", F.round("snr", 5))


_INSTRUMENT = "{LONG}, i AS (SELECT vec_id, vec_id % {n} AS inst, var_idx, x FROM long), m AS (SELECT inst, var_idx, avg(x) AS m FROM i GROUP BY 1, 2)"


@query("WITH " + _INSTRUMENT.replace("{n}", "4") + " SELECT vec_id, var_idx, round(x - m, 6) AS x FROM i JOIN m USING (inst, var_idx)")
def f20_instrument_centred(spark, d):
    rows = signal.centred_by(long(spark, d).withColumn("inst", F.col("vec_id") % 4), "inst")
    return rounded(rows.select("vec_id", "var_idx", "x"), "x")


@query("WITH " + _INSTRUMENT.replace("{n}", "2") + """, a AS (SELECT var_idx, max(m) FILTER (inst = 1) - max(m) FILTER (inst = 0) AS d FROM m GROUP BY 1), s AS (SELECT vec_id, sum(x * d) / (SELECT sum(d * d) FROM a) AS share FROM i JOIN a USING (var_idx) GROUP BY 1)
 SELECT vec_id, var_idx, round(x - share * d, 6) AS x FROM i JOIN a USING (var_idx) JOIN s USING (vec_id)""")
def f20_instruments_projected_out(spark, d):
    """Two instruments: the difference of their means is one direction."""
    out = signal.without_groups(spectra(spark, d).withColumn("inst", F.col("vec_id") % 2), "spectrum", "inst")
    return rounded(signal.long_view(out, "spectrum", "vec_id").select("vec_id", "var_idx", "x"), "x")


@query()
def m42_enrichment_curve(spark, d):
    """The four instruments of m40_m42_instruments."""
    inst = F.col("vec_id") % 4
    df = folded(spark, d).withColumn("inst", inst).withColumn("spectrum", F.transform("spectrum", lambda x: x * (1 + 0.02 * F.col("inst")) + 0.05 * F.col("inst")))
    return rounded(fusion.enrichment(df, "spectrum", "y", "inst", "vec_id"), "rmse", "sd")


@query()
def m41_pretreatments_by_instrument(spark, d):
    """Three pretreatments on the four instruments of m40_m42_instruments; gains and offsets go with snv."""
    inst = F.col("vec_id") % 4
    df = folded(spark, d).withColumn("inst", inst).withColumn("spectrum", F.transform("spectrum", lambda x: x * (1 + 0.02 * F.col("inst")) + 0.05 * F.col("inst")))
    out = None
    for name, f in {"none": lambda c: c, "snv": arrays.snv, "area": arrays.area}.items():
        part = fusion.instruments(df.withColumn("spectrum", f(F.col("spectrum"))), "spectrum", "y", "inst", "fold").withColumn("pretreatment", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return rounded(out, "rmse", "bias")


@query()
def m37_block_shares(spark, d):
    df = folded(spark, d).withColumns({"a": F.slice("spectrum", 1, 32), "b": F.slice("spectrum", 33, 32)})
    return rounded(fusion.shares(df, "a", "b", "y"), "share_a", "share_b")


@query()
def m39_transfer_errors(spark, d):
    """A second instrument that smears, scales and lifts spectra."""
    smeared = F.transform("spectrum", lambda v, i: 0.1 + 1.05 * (0.8 * v + 0.2 * F.coalesce(F.get("spectrum", i + 1), v)))
    df = models.folds(spectra(spark, d).withColumn("second", smeared), "vec_id", 5)
    return rounded(blocks.transfer_errors(df, "second", "spectrum", "fold"), "before", "after")


@query()
def m28_confirm_regions(spark, d):
    by = fusion.sums_by(folded(spark, d), ["spectrum"], "y", F.col("fold"))
    return rounded(spark.createDataFrame(fusion.confirm(by, [(0, 7), (30, 37)]), "variables string, rmse double"), "rmse")


@query()
def t3_top_loadings(spark, d):
    """The 15 variables with the largest correlation radius on the first two components."""
    radius = stats.correlation_radius(*stats.moments(spectra(spark, d), "spectrum"))
    top = sorted(range(len(radius)), key=lambda i: (-radius[i], i))[:15]
    return rounded(spark.createDataFrame([(i, float(radius[i])) for i in top], "var_idx int, radius double"), "radius")
