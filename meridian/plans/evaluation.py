"""Queries over drift and evaluation operators, on line items as the prediction table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift as D
from ..operators import metrics as M
from ..sources.files import load_reference, save_reference
from .tables import load, scratch

CUT = "1995-06-17"
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "absent"]
LEVELS = ["l_returnflag", "l_linestatus"]
QUERIES, ORACLE_SQL = {}, {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    p = F.floor((0.02 + 3 * F.col("l_discount") + 2 * F.col("l_tax") + F.col("l_quantity") / 125) * 100) / 100
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), F.col("l_linestatus").alias("fold"), F.col("l_returnflag").alias("flag"), (F.col("l_suppkey") % 3).alias("stratum"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), p.alias("p"), "l_shipdate")


PREDS = """
preds AS (
  SELECT l_orderkey * 8 + l_linenumber AS row_id, l_linestatus AS fold, l_suppkey % 3 AS stratum,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_shipdate,
         floor((0.02::DOUBLE + 3 * l_discount + 2 * l_tax + l_quantity / 125) * 100) / 100 AS p FROM lineitem
)"""


def _before_after(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = load(spark, sf_dir, "lineitem")
    return li.where(F.col("l_shipdate") < F.lit(CUT).cast("timestamp")), li.where(F.col("l_shipdate") >= F.lit(CUT).cast("timestamp"))


EDGES = f"""
long AS (
  SELECT feature, value, l_shipdate < TIMESTAMP '{CUT}' AS was FROM (
    SELECT l_shipdate, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature,
           unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem)
), edges AS (
  SELECT feature, list_sort(list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS edges FROM long WHERE was GROUP BY 1
), cells AS (
  SELECT feature, unnest(range(0, len(edges) + 1)) AS bin FROM edges
), placed AS (
  SELECT long.feature, was, len(list_filter(edges, lambda e: e <= value)) AS bin FROM long JOIN edges USING (feature)
), bins AS (
  SELECT c.feature, c.bin, count(*) FILTER (p.was) AS r, count(*) FILTER (NOT p.was) AS c FROM cells c LEFT JOIN placed p ON p.feature = c.feature AND p.bin = c.bin GROUP BY ALL
), levels AS (
  SELECT feature, level AS bin, count(*) FILTER (was) AS r, count(*) FILTER (NOT was) AS c FROM (
    SELECT l_shipdate < TIMESTAMP '{CUT}' AS was, unnest(['l_returnflag', 'l_linestatus']) AS feature, unnest([l_returnflag, l_linestatus]) AS level FROM lineitem) GROUP BY ALL
), shares AS (
  SELECT kind, feature, r, c, CASE WHEN r = 0 THEN 1e-6 ELSE r / sum(r) OVER w END AS rp, CASE WHEN c = 0 THEN 1e-6 ELSE c / sum(c) OVER w END AS cp
  FROM (SELECT 'numeric' AS kind, feature, bin::VARCHAR AS bin, r, c FROM bins UNION ALL SELECT 'categorical', feature, bin, r, c FROM levels) WINDOW w AS (PARTITION BY kind, feature)
), psi AS (
  SELECT kind, feature, sum((cp - rp) * ln(cp / rp)) AS psi, sum(r)::BIGINT AS n_ref, sum(c)::BIGINT AS n_cur FROM shares GROUP BY ALL
)"""
KS_P = "CASE WHEN {d} * sqrt({n} * {m} / ({n} + {m})::DOUBLE) < 0.2 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END) * exp(-2.0::DOUBLE * k * k * {d} * {d} * {n} * {m} / ({n} + {m})))))) END"
#: The reference's bins as weighted middles against the current values.
BINNED_KS = f"""
ext AS (SELECT feature, list_concat(list_concat([edges[1] - span], edges), [edges[len(edges)] + span]) AS e FROM (SELECT feature, edges, greatest(edges[len(edges)] - edges[1], 1) AS span FROM edges WHERE len(edges) > 0)
), kp AS (
  SELECT feature, value, sum(r) AS r, sum(c) AS c FROM (
    SELECT b.feature, (e[b.bin + 1] + e[b.bin + 2]) / 2 AS value, b.r, 0 AS c FROM bins b JOIN ext USING (feature) UNION ALL SELECT feature, value, 0, 1 FROM long WHERE NOT was) WHERE value IS NOT NULL GROUP BY ALL
), kc AS (
  SELECT feature, sum(r) OVER w AS cr, sum(c) OVER w AS cc, sum(r) OVER g AS tr, sum(c) OVER g AS tc FROM kp WINDOW w AS (PARTITION BY feature ORDER BY value), g AS (PARTITION BY feature)
), ksb AS (
  SELECT feature, ks, n_ref, n_cur, {KS_P.format(d='ks', n='n_ref', m='n_cur')} AS ks_p FROM (SELECT feature, max(abs(cr / tr - cc / tc)) AS ks, max(tr)::BIGINT AS n_ref, max(tc)::BIGINT AS n_cur FROM kc GROUP BY 1)
)"""
SEVERITY = "CASE WHEN psi IS NULL OR isnan(psi) OR isinf(psi) THEN 'major' WHEN psi < 0.10 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'major' END"


@_query(f"WITH {EDGES}, {BINNED_KS} SELECT psi.feature, kind, round(psi, 9) AS psi, {SEVERITY} AS severity, psi.n_ref, psi.n_cur, 0::BIGINT AS n_missing, CASE WHEN kind = 'numeric' THEN round(ks, 9) END AS ks, CASE WHEN kind = 'numeric' THEN round(ks_p, 9) END AS ks_p FROM psi LEFT JOIN ksb ON ksb.feature = psi.feature")
def dr15_drift_report(spark, sf_dir):
    """DR-01..10, 13, 15, PRJ-19, JN-03, JN-04."""
    report = D.drift_report(*_before_after(spark, sf_dir), NUMERIC, LEVELS)
    return _r(report, "psi", "ks", "ks_p").select("feature", "kind", "psi", "severity", "n_ref", "n_cur", "n_missing", "ks", "ks_p")


@_query(f"WITH {EDGES}, t AS (SELECT *, row_number() OVER (ORDER BY psi DESC, feature) AS rank FROM psi) SELECT feature, rank::INT AS rank, round(psi, 9) AS psi FROM t WHERE rank <= 3")
def dr16_top_drifted(spark, sf_dir):
    report = D.drift_report(*_before_after(spark, sf_dir), NUMERIC, LEVELS).withColumn("cell", F.lit(1))
    return _r(D.top_drifted(report, ["cell"]), "psi").select("feature", "rank", "psi")


@_query(f"WITH {EDGES} SELECT count(*) FILTER (s = 'stable') AS n_stable, count(*) FILTER (s = 'moderate') AS n_moderate, count(*) FILTER (s = 'major') AS n_major FROM (SELECT {SEVERITY} AS s FROM psi)")
def dr15_severity_counts(spark, sf_dir):
    return D.severity_counts(D.drift_report(*_before_after(spark, sf_dir), NUMERIC, LEVELS).withColumn("cell", F.lit(1)), ["cell"]).drop("cell")


@_query(f"WITH {EDGES} SELECT feature, bin::INT AS bin, r AS cnt FROM bins")
def dr03_numeric_reference(spark, sf_dir):
    """DR-02, DR-03, SRC-12's numeric table as rows."""
    return D.reference_counts(D.numeric_reference(D.melt(_before_after(spark, sf_dir)[0], NUMERIC), []), []).select("feature", "bin", "cnt")


@_query(f"WITH {EDGES} SELECT feature, bin AS level, r AS cnt FROM levels WHERE r > 0")
def dr04_categorical_reference(spark, sf_dir):
    return D.level_counts(D.melt_levels(_before_after(spark, sf_dir)[0], LEVELS), []).select("feature", "level", "cnt")


KS = f"""
WITH long AS (
  SELECT feature, value, l_shipdate < TIMESTAMP '{CUT}' AS was FROM (
    SELECT l_shipdate, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem)
), pts AS (SELECT feature, value, count(*) FILTER (was) AS r, count(*) FILTER (NOT was) AS c FROM long GROUP BY ALL
), cum AS (SELECT feature, value, sum(r) OVER w AS cr, sum(c) OVER w AS cc, sum(r) OVER g AS tr, sum(c) OVER g AS tc, r FROM pts WINDOW w AS (PARTITION BY feature ORDER BY value), g AS (PARTITION BY feature))
"""


@_query(KS + f", m AS (SELECT feature, max(abs(cr / tr - cc / tc)) AS ks, max(tr)::BIGINT AS n_ref, max(tc)::BIGINT AS n_cur FROM cum GROUP BY 1) SELECT feature, round(ks, 9) AS ks, n_ref, n_cur, round({KS_P.format(d='ks', n='n_ref', m='n_cur')}, 9) AS ks_p FROM m")
def dr11_ks_two_sample(spark, sf_dir):
    was, now = (D.melt(t, NUMERIC) for t in _before_after(spark, sf_dir))
    return _r(D.ks_two_sample(was, now, []), "ks", "ks_p").select("feature", "ks", "n_ref", "n_cur", "ks_p")


@_query(f"WITH {EDGES}, {BINNED_KS} SELECT feature, round(ks, 9) AS ks, n_ref, n_cur, round(ks_p, 9) AS ks_p FROM ksb")
def dr12_ks_binned(spark, sf_dir):
    was, now = (D.melt(t, NUMERIC) for t in _before_after(spark, sf_dir))
    return _r(D.ks_weighted(D.midpoints(D.numeric_reference(was, []), []), now.withColumn("weight", F.lit(1)), []), "ks", "ks_p")


@_query(KS + "SELECT feature, value, round((cr + cc) / (tr + tc), 9) AS share FROM cum")
def dr19_ecdf(spark, sf_dir):
    return _r(D.ecdf(D.melt(load(spark, sf_dir, "lineitem"), NUMERIC), []), "share")


PDRIFT = f"""
WITH {PREDS}, e AS (
  SELECT fold, list_sort(list_distinct(quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS edges FROM preds WHERE stratum = 0 GROUP BY 1
), b AS (
  SELECT preds.fold, stratum, p, len(list_filter(edges, lambda x: x <= p)) AS bin FROM preds JOIN e USING (fold)
), cells AS (SELECT fold, edges, unnest(range(0, len(edges) + 1)) AS bin FROM e
), k AS (
  SELECT cells.fold, cells.bin, any_value(cells.edges) AS edges, count(*) FILTER (stratum = 0) AS r, count(*) FILTER (stratum > 0) AS c FROM cells LEFT JOIN b ON b.fold = cells.fold AND b.bin = cells.bin GROUP BY ALL
), s AS (
  SELECT *, CASE WHEN r = 0 THEN 1e-6 ELSE r / sum(r) OVER w END AS rp, CASE WHEN c = 0 THEN 1e-6 ELSE c / sum(c) OVER w END AS cp FROM k WINDOW w AS (PARTITION BY fold)
)"""


@_query(PDRIFT + f", q AS (SELECT fold, sum((cp - rp) * ln(cp / rp)) AS psi FROM s GROUP BY 1), m AS (SELECT fold, avg(p) FILTER (stratum = 0) AS a, avg(p) FILTER (stratum > 0) AS b FROM preds GROUP BY 1) SELECT fold, round(psi, 9) AS psi, {SEVERITY} AS severity, round(a, 9) AS mean_ref, round(b, 9) AS mean_cur FROM q JOIN m USING (fold)")
def dr14_prediction_drift(spark, sf_dir):
    """DR-05, DR-14, DR-18 keyed by fold."""
    p = predictions(spark, sf_dir)
    return _r(D.prediction_drift(p.where("stratum = 0"), p.where("stratum > 0"), ["fold"]), "psi", "mean_ref", "mean_cur").select("fold", "psi", "severity", "mean_ref", "mean_cur")


@_query(PDRIFT + ", c2 AS (SELECT *, r / sum(r) OVER (PARTITION BY fold) AS rs, c / sum(c) OVER (PARTITION BY fold) AS cs FROM k) SELECT fold, bin::INT AS bin, round(CASE WHEN bin = 0 THEN 0.0::DOUBLE ELSE edges[bin] END, 9) AS low, round(coalesce(edges[bin + 1], 1.0::DOUBLE), 9) AS high, round(rs, 9) AS ref_share, round(cs, 9) AS cur_share FROM c2")
def dr20_overlay_histogram(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return _r(D.overlay_histogram(p.where("stratum = 0"), p.where("stratum > 0"), ["fold"]), "low", "high", "ref_share", "cur_share")


@_query(PDRIFT + f", q AS (SELECT fold, sum((cp - rp) * ln(cp / rp)) AS psi FROM s GROUP BY 1), {EDGES.replace('cells AS', 'cells2 AS').replace('FROM cells c', 'FROM cells2 c').replace('psi AS', 'fpsi AS')}, v AS (SELECT {SEVERITY} AS sev FROM fpsi) SELECT 'm1' AS model, count(*) FILTER (sev = 'stable') AS n_stable, count(*) FILTER (sev = 'moderate') AS n_moderate, count(*) FILTER (sev = 'major') AS n_major, (SELECT round(avg(psi), 9) FROM q) AS mean_psi, (SELECT round(max(psi), 9) FROM q) AS max_psi FROM v")
def dr17_drift_tally(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("model", F.lit("m1"))
    was, now = _before_after(spark, sf_dir)
    report = D.drift_report(was.withColumn("model", F.lit("m1")), now.withColumn("model", F.lit("m1")), NUMERIC, LEVELS, ["model"])
    return _r(D.drift_tally(report, D.prediction_drift(p.where("stratum = 0"), p.where("stratum > 0"), ["model", "fold"])), "mean_psi", "max_psi")


@_query(f"""WITH {PREDS}, base AS (SELECT l_linestatus AS fold, l_suppkey % 3 = 0 AS was, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag FROM lineitem),
lng AS (SELECT fold, 'all' AS model, was, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM base
UNION ALL SELECT fold, 'm1', stratum = 0, 'p', p FROM preds UNION ALL SELECT fold, 'm2', stratum = 0, 'p', floor(p * p * 100) / 100 FROM preds),
ed AS (SELECT fold, model, feature, list_sort(list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS edges FROM lng WHERE was GROUP BY ALL),
ce AS (SELECT fold, model, feature, unnest(range(0, len(edges) + 1)) AS bin FROM ed), pl AS (SELECT fold, model, feature, was, len(list_filter(edges, lambda e: e <= value)) AS bin FROM lng JOIN ed USING (fold, model, feature)),
bi AS (SELECT fold, model, feature, bin::VARCHAR AS bin, count(*) FILTER (was) AS r, count(*) FILTER (NOT was) AS c FROM ce LEFT JOIN pl USING (fold, model, feature, bin) GROUP BY ALL
UNION ALL SELECT fold, 'all', 'l_returnflag', l_returnflag, count(*) FILTER (was), count(*) FILTER (NOT was) FROM base GROUP BY ALL),
sh AS (SELECT *, CASE WHEN r = 0 THEN 1e-6 ELSE r / sum(r) OVER w END AS rp, CASE WHEN c = 0 THEN 1e-6 ELSE c / sum(c) OVER w END AS cp FROM bi WINDOW w AS (PARTITION BY fold, model, feature)),
ps AS (SELECT fold, model, feature, sum((cp - rp) * ln(cp / rp)) AS psi FROM sh GROUP BY ALL), me AS (SELECT fold, model, avg(value) FILTER (was) AS a, avg(value) FILTER (NOT was) AS b FROM lng WHERE feature = 'p' GROUP BY ALL)
SELECT ps.fold, ps.model, feature, round(psi, 9) AS psi, {SEVERITY} AS severity, round(a, 9) AS mean_ref, round(b, 9) AS mean_cur FROM ps LEFT JOIN me ON me.fold = ps.fold AND me.model = ps.model""")
def dr18_sweep(spark, sf_dir):
    """DR-06, 18, SRC-12: references of all folds stored and loaded, then features by fold and predictions by fold and model."""
    p = predictions(spark, sf_dir)
    both = p.withColumn("model", F.lit("m1")).unionByName(p.withColumn("p", F.floor(F.col("p") * F.col("p") * 100) / 100).withColumn("model", F.lit("m2")))
    rows = load(spark, sf_dir, "lineitem").withColumns({"fold": F.col("l_linestatus"), "stratum": F.col("l_suppkey") % 3})
    path, numbers, levels = scratch(spark, "bundle"), NUMERIC[:4], ["l_returnflag"]
    save_reference(D.reference_bundle(rows.where("stratum = 0"), both.where("stratum = 0"), numbers, levels), path)
    stored = load_reference(spark, path, {"numeric": ["edges", "counts"], "categorical": ["level", "cnt"], "prediction": ["edges", "mean"]})
    report, drifted = D.fold_sweep(stored, rows.where("stratum > 0"), both.where("stratum > 0"), numbers, levels)
    none = F.lit(None).cast("double")
    found = report.select("fold", F.lit("all").alias("model"), "feature", "psi", "severity", none.alias("mean_ref"), none.alias("mean_cur"))
    return _r(found.unionByName(drifted.select("fold", "model", F.lit("p").alias("feature"), "psi", "severity", "mean_ref", "mean_cur")), "psi", "mean_ref", "mean_cur")


SCORES = f"""
WITH {PREDS}, sc AS (SELECT fold, p, sum(y) AS pos, sum(1 - y) AS neg FROM preds GROUP BY ALL
), cv AS (
  SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER g AS n_pos, sum(neg) OVER g AS n_neg, sum(neg) OVER a - neg AS below FROM sc
  WINDOW d AS (PARTITION BY fold ORDER BY p DESC), g AS (PARTITION BY fold), a AS (PARTITION BY fold ORDER BY p)
)"""


def _newton(key: str, rounds: int = 15) -> str:
    """CTEs that end in fit (key, slope, intercept): logistic regression of y on logit(p) by Newton steps."""
    out = f"zc AS MATERIALIZED (SELECT {key}, ln(c / (1 - c)) AS z, sum(y) AS pos, count(*) AS n FROM (SELECT {key}, y, least(greatest(p, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE) AS c FROM preds) GROUP BY ALL), b0 AS (SELECT {key}, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM zc GROUP BY 1)"
    for k in range(rounds):
        out += f""", s{k} AS (SELECT {key}, any_value(b0) AS b0, any_value(b1) AS b1, sum(g) AS g0, sum(g * z) AS g1, sum(w) AS h00, sum(w * z) AS h01, sum(w * z * z) AS h11 FROM (SELECT {key}, z, b0, b1, pos - n * q AS g, n * q * (1 - q) AS w FROM (SELECT zc.*, b0, b1, 1 / (1 + exp(-(b0 + b1 * z))) AS q FROM zc JOIN b{k} USING ({key}))) GROUP BY 1),
b{k + 1} AS MATERIALIZED (SELECT {key}, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 ** 2) AS b0, b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 ** 2) AS b1 FROM s{k})"""
    return out + f", fit AS (SELECT {key}, b1 AS slope, b0 AS intercept FROM b{rounds})"


@_query(SCORES + f", {_newton('fold')}" + """, m AS (SELECT fold, sum(pos * (below + neg / 2.0)) / nullif(max(n_pos) * max(n_neg), 0) AS auroc,
  CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0 THEN sum(pos / n_pos * tp / (tp + fp)) END AS auprc,
  CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0 THEN coalesce(max(tp / n_pos) FILTER (1 - fp / n_neg >= 0.9), 0) END AS sens_at_90,
  CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0 THEN coalesce(max(tp / n_pos) FILTER (1 - fp / n_neg >= 0.95), 0) END AS sens_at_95 FROM cv GROUP BY 1)
SELECT fold, n, round(prevalence, 9) AS prevalence, round(auroc, 9) AS auroc, round(auprc, 9) AS auprc, round(brier, 9) AS brier, round(sens_at_90, 9) AS sens_at_90, round(sens_at_95, 9) AS sens_at_95, round(slope, 6) AS slope, round(intercept, 6) AS intercept
FROM m JOIN fit USING (fold) JOIN (SELECT fold, count(*) AS n, avg(y) AS prevalence, avg((p - y) ** 2) AS brier FROM preds GROUP BY 1) USING (fold)""")
def met07_headline(spark, sf_dir):
    """MET-01..04, 06, 07."""
    made = _r(M.headline(M.checked(predictions(spark, sf_dir)), ["fold"]), "prevalence", "auroc", "auprc", "brier", "sens_at_90", "sens_at_95")
    return made.withColumns({n: F.round(n, 6) for n in ("slope", "intercept")})


@_query(f"WITH {PREDS}, {_newton('stratum')} SELECT stratum, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM fit")
def met05_calibration(spark, sf_dir):
    return M.calibration(predictions(spark, sf_dir), ["stratum"]).withColumns({n: F.round(n, 6) for n in ("slope", "intercept")})


@_query("""WITH x AS (SELECT toxic AS fold, quality AS v, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY toxic) AS n FROM labels),
d AS (SELECT fold, i, n, unnest(range(0, 100)) AS b FROM x),
e AS (SELECT fold, b, ('0x' || substr(md5(7 || '|' || b || '|' || i), 1, 8))::UBIGINT % n AS i FROM d),
z AS (SELECT e.fold, b, avg(v) AS value FROM e JOIN x ON x.fold = e.fold AND x.i = e.i GROUP BY ALL),
q AS (SELECT fold, quantile_cont(value, [0.025, 0.975]) AS e, count(*) AS n_valid FROM z GROUP BY 1)
SELECT fold, round(point, 9) AS point, round(e[1], 9) AS lower, round(e[2], 9) AS upper, n_valid, e[2] >= e[1] AS ordered FROM q JOIN (SELECT fold, avg(v) AS point FROM x GROUP BY 1) USING (fold)""")
def met09_bootstrap_mean(spark, sf_dir):
    """MET-08, 09, 10, UDF-01: the mean is the plugged-in metric."""
    rows = load(spark, sf_dir, "labels").select(F.col("toxic").alias("fold"), F.col("doc_id").alias("row_id"), F.col("quality").alias("v"))
    found = _r(M.ci_columns(M.bootstrap_ci(rows, ["fold"], M.mean_metric, 100, seed=7)), "point", "lower", "upper")
    return found.select("fold", "point", "lower", "upper", "n_valid", (F.col("width") >= 0).alias("ordered"))


@_query(f"""WITH {PREDS}, b AS (SELECT fold, len(list_filter([0.1::DOUBLE, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9], lambda e: e <= p)) AS bin, p, y FROM preds),
c AS (SELECT fold, unnest(range(0, 10)) AS bin FROM (SELECT DISTINCT fold FROM preds))
SELECT c.fold, c.bin::INT AS bin, count(b.p) AS n, round(avg(p), 9) AS mean_p, round(avg(y), 9) AS rate FROM c LEFT JOIN b ON b.fold = c.fold AND b.bin = c.bin GROUP BY ALL""")
def met11_reliability(spark, sf_dir):
    return _r(M.reliability_bins(predictions(spark, sf_dir), ["fold"]), "mean_p", "rate")


@_query(f"""WITH {PREDS}, e AS (SELECT fold, list_sort(list_distinct(quantile_cont(p, [0.2, 0.4, 0.6, 0.8]))) AS edges FROM preds GROUP BY 1),
b AS (SELECT preds.fold, len(list_filter(edges, lambda e: e <= p)) AS bin, p, y FROM preds JOIN e USING (fold)), c AS (SELECT fold, unnest(range(0, len(edges) + 1)) AS bin FROM e)
SELECT c.fold, c.bin::INT AS bin, count(b.p) AS n, round(avg(p), 9) AS mean_p, round(avg(y), 9) AS rate FROM c LEFT JOIN b ON b.fold = c.fold AND b.bin = c.bin GROUP BY ALL""")
def met11_reliability_quantile(spark, sf_dir):
    return _r(M.reliability_bins(predictions(spark, sf_dir), ["fold"], 5, "quantile"), "mean_p", "rate")


@_query(f"WITH {PREDS}, s AS (SELECT fold, stratum, avg((p - y) ** 2) AS v FROM preds GROUP BY ALL HAVING count(*) >= 10) SELECT fold, round(CASE WHEN count(v) >= 2 THEN max(v) - min(v) END, 9) AS gap FROM s GROUP BY 1")
def met13_fairness_gap(spark, sf_dir):
    return _r(M.fairness_gap(M.stratified(predictions(spark, sf_dir), ["fold"], "stratum", M.brier), ["fold"]), "gap")


DCA = f"""WITH {PREDS}, t AS (SELECT unnest(range(1, 100)) / 100.0::DOUBLE AS threshold), f AS (SELECT fold, count(*) AS n, sum(y) / count(*) AS pi FROM preds GROUP BY 1),
h AS (SELECT fold, threshold, sum(y) FILTER (p >= threshold) AS tp, count(*) FILTER (p >= threshold) AS a FROM (SELECT fold, p, y FROM preds), t GROUP BY ALL),
d AS (SELECT fold, threshold, coalesce(tp, 0) / n - (a - coalesce(tp, 0)) / n * (threshold / (1 - threshold)) AS model, pi - (1 - pi) * (threshold / (1 - threshold)) AS treat_all FROM h JOIN f USING (fold))"""


@_query(DCA + " SELECT fold, threshold, round(model, 9) AS model, round(treat_all, 9) AS treat_all, 0.0::DOUBLE AS treat_none FROM d")
def met16_decision_curve(spark, sf_dir):
    """MET-14, 15, 16, JN-12."""
    return _r(M.decision_curve(predictions(spark, sf_dir), ["fold"]), "model", "treat_all")


@_query(DCA + " SELECT fold, threshold, round(model, 9) AS model, model > greatest(treat_all, 0) AS useful FROM d WHERE threshold IN (0.05, 0.1)")
def met17_curve_at(spark, sf_dir):
    points = M.decision_curve(predictions(spark, sf_dir), ["fold"])
    return _r(M.curve_at(points, ["fold"], 0.05).unionByName(M.curve_at(points, ["fold"], 0.1)), "model").select("fold", "threshold", "model", "useful")


@_query(f"WITH {PREDS}, v AS (SELECT fold, avg((p - y) ** 2) AS brier, avg(y) AS prevalence FROM preds GROUP BY 1) SELECT metric, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std, count(value) AS n FROM (SELECT unnest(['brier', 'prevalence']) AS metric, unnest([brier, prevalence]) AS value FROM v) GROUP BY 1")
def met19_across_folds(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("model", F.lit("m1"))
    wide = M.brier(p, ["model", "fold"]).withColumnRenamed("value", "brier").join(p.groupBy("model", "fold").agg(F.avg("y").alias("prevalence")), ["model", "fold"])
    return _r(M.across_folds(wide, ["model"], ["brier", "prevalence"]), "mean", "std").drop("model")


@_query(f"WITH {PREDS} SELECT fold, stratum, count(*) AS n, round(avg(y), 9) AS prevalence, round(avg((p - y) ** 2), 9) AS brier FROM preds GROUP BY GROUPING SETS ((fold), (fold, stratum))")
def met18_overall_and_strata(spark, sf_dir):
    """MET-18's overall and per-stratum block in one pass over the rows."""
    p = predictions(spark, sf_dir)
    fold, stratum = F.col("fold"), F.col("stratum")
    return _r(p.groupingSets([[fold], [fold, stratum]], "fold", "stratum").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("prevalence"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier")), "prevalence", "brier")


@_query(DCA + f""", sc AS (SELECT fold, stratum, p, sum(y) AS pos, sum(1 - y) AS neg FROM preds GROUP BY ALL), u AS (SELECT *, sum(neg) OVER (PARTITION BY fold, stratum ORDER BY p) - neg AS below FROM sc),
s AS (SELECT fold, stratum, sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0) AS v FROM u GROUP BY ALL), g AS (SELECT fold, string_agg(stratum || '=' || round(v, 6), ',' ORDER BY stratum) AS auroc_by_stratum, round(max(v) - min(v), 9) AS gap FROM s GROUP BY 1)
SELECT fold, auroc_by_stratum, gap, round(a.model, 9) AS model_5, a.model > greatest(a.treat_all, 0) AS useful_5, round(b.model, 9) AS model_10, b.model > greatest(b.treat_all, 0) AS useful_10
FROM g JOIN (SELECT * FROM d WHERE threshold = 0.05) a USING (fold) JOIN (SELECT * FROM d WHERE threshold = 0.1) b USING (fold)""")
def met18_block(spark, sf_dir):
    """MET-18: headline, AUROC by stratum with its gap, and the decision curve at two thresholds."""
    made = M.evaluation_block(predictions(spark, sf_dir), ["fold"], ["stratum"])
    listed = F.array_join(F.transform("auroc_by_stratum", lambda s: F.concat_ws("=", s["stratum"].cast("string"), F.round(s["value"], 6).cast("string"))), ",")
    return made.select("fold", listed.alias("auroc_by_stratum"), F.round("gap_stratum", 9).alias("gap"), F.round("at_5.model", 9).alias("model_5"), F.col("at_5.useful").alias("useful_5"), F.round("at_10.model", 9).alias("model_10"), F.col("at_10.useful").alias("useful_10"))


@_query()
def met18_intervals(spark, sf_dir):
    """MET-18's intervals of five metrics, from 2,000 resamples; a test holds them against resampling rows."""
    return M.headline_intervals(predictions(spark, sf_dir), ["fold"])
