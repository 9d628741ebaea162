"""Statistical tests over analytic tables.

The original loads each mart table whole into one process and calls
scipy/statsmodels.  Here the data stays in Spark: the sufficient statistics
(counts, sums, sums of squares, rank sums) are Spark aggregates, tail
probabilities are pandas UDFs over the one-row results, and model fits use
``pyspark.ml``.  Only fitted coefficients (a few numbers) are read back on
the driver, to lay them out as a table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.ntile import join_counted, settled
from ..functions.ranks import average_ranks, prefix_sums
from .distributions import chi2_sf_udf, f_sf_udf, norm_sf2_udf, t_sf2, t_sf2_udf

Z975 = 1.959963984540054  # 97.5% normal quantile (95% two-sided intervals)


def _exp(x: float) -> float:
    """exp that saturates to +inf (separated data gives huge coefficients)."""
    try:
        return math.exp(x)
    except OverflowError:
        return float("inf")


def _require(df: DataFrame, cols: Sequence[str]) -> None:
    missing = set(cols) - set(df.columns)
    if missing:
        raise ValueError(f"missing required columns: {sorted(missing)}")


# ---------------------------------------------------------------------------
# T1 chi-square test of success rates
# ---------------------------------------------------------------------------
def contingency(df: DataFrame, group_col: str, total_col: str, success_col: str) -> DataFrame:
    """Rows (group, success, failure): numeric coercion (bad -> NULL), NULL rows
    dropped, success <= total kept, counts truncated to integers."""
    _require(df, [group_col, total_col, success_col])
    t = F.col(total_col).try_cast("double")
    s = F.col(success_col).try_cast("double")
    sub = df.select(F.col(group_col).alias("group"), t.alias("t"), s.alias("s")).dropna()
    sub = sub.where(F.col("s") <= F.col("t"))
    return sub.select("group", F.col("s").cast("long").alias("success"),
                      (F.col("t") - F.col("s")).cast("long").alias("failure"))


def chi2_residuals(df: DataFrame, group_col: str, total_col: str, success_col: str) -> DataFrame:
    """Contingency table with expected counts and Pearson residuals (O - E) / sqrt(E).
    The table has one row per group, so its totals are window sums over few rows."""
    ct = contingency(df, group_col, total_col, success_col)
    w = Window.partitionBy()
    x = ct.select("group", "success", "failure",
                  (F.col("success") + F.col("failure")).alias("_row"),
                  F.sum("success").over(w).alias("_c1"), F.sum("failure").over(w).alias("_c2"))
    x = x.select("*", (F.col("_c1") + F.col("_c2")).alias("_n"))
    # degenerate tables (an empty row or column) give NULL, not a divide error
    e1 = F.try_divide(F.col("_row") * F.col("_c1"), F.col("_n").cast("double"))
    e2 = F.try_divide(F.col("_row") * F.col("_c2"), F.col("_n").cast("double"))
    return x.select("group", "success", "failure", e1.alias("expected_success"),
                    e2.alias("expected_failure"),
                    F.try_divide(F.col("success") - e1, F.sqrt(e1)).alias("resid_success"),
                    F.try_divide(F.col("failure") - e2, F.sqrt(e2)).alias("resid_failure"))


def chi2_rate_test(df: DataFrame, group_col: str, total_col: str, success_col: str) -> DataFrame:
    """T1. Pearson chi-square (no continuity correction) on the groups x
    (success, failure) table: chi2, p_value, dof, cramers_v, n."""
    r = chi2_residuals(df, group_col, total_col, success_col)
    cells = (F.pow(F.col("resid_success"), 2) + F.pow(F.col("resid_failure"), 2))
    agg = r.agg(F.sum(cells).alias("chi2"), F.count(F.lit(1)).alias("rows"),
                F.sum(F.col("success") + F.col("failure")).alias("n"))
    dof = (F.col("rows") - 1).cast("long")
    mindim = F.least(F.col("rows") - 1, F.lit(1))
    return agg.select(
        F.lit("chi_square").alias("test"), "chi2",
        # a one-row table has no degrees of freedom: chi2 = 0 and p = 1
        F.when(dof == 0, F.lit(1.0)).otherwise(chi2_sf_udf(F.col("chi2"), dof.cast("double"))).alias("p_value"),
        dof.alias("dof"),
        F.when(mindim > 0, F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * mindim))).alias("cramers_v"),
        F.col("n").cast("long").alias("n"))


# ---------------------------------------------------------------------------
# T2 one-way ANOVA and T3 pairwise comparisons
# ---------------------------------------------------------------------------
def retention_rates(df: DataFrame, segment_col: str = "rfm_segment", month_col: str = "curr_period",
                    active_col: str = "action_number", non_active_col: str = "non_action_number") -> DataFrame:
    """(group, value) = (segment, active / (active + non-active)), NULL where that is undefined."""
    _require(df, [segment_col, month_col, active_col, non_active_col])
    total = F.col(active_col) + F.col(non_active_col)
    rate = F.try_divide(F.col(active_col).cast("double"), total.cast("double"))
    return df.select(F.col(segment_col).alias("group"), rate.alias("value")).where(F.col(segment_col).isNotNull())


def _group_stats(gv: DataFrame) -> DataFrame:
    """One row per group: all rows, defined values, their mean and sum of squares
    around it (Spark's one-pass, mergeable variance)."""
    spread = F.coalesce(F.var_pop("value") * F.count("value"), F.lit(0.0))
    return gv.groupBy("group").agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n"),
                                   F.avg("value").alias("mean"), spread.alias("ss"))


def _anova_parts(gs: DataFrame) -> DataFrame:
    """One row from the group statistics: n_obs (all rows), n_used (defined values),
    n_groups (with a defined value), ss_between and ss_within."""
    some = gs.agg(F.sum("n_rows").alias("n_obs"), F.sum("n").alias("n_used"),
                  F.count(F.when(F.col("n") > 0, 1)).alias("n_groups"),
                  F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("_s2"),
                  F.sum(F.col("n") * F.col("mean")).alias("_s1"), F.sum("ss").alias("_ss"))
    used = F.col("n_used") > 0
    ssb = F.when(used, F.greatest(F.col("_s2") - F.col("_s1") * F.col("_s1") / F.col("n_used"), F.lit(0.0)))
    return some.select(F.coalesce("n_obs", F.lit(0)).alias("n_obs"), F.coalesce("n_used", F.lit(0)).alias("n_used"),
                       "n_groups", ssb.alias("ss_between"), F.when(used, F.col("_ss")).alias("ss_within"))


def anova_oneway(gv: DataFrame, alpha: float = 0.05, name: str = "Initial Retention ANOVA") -> DataFrame:
    """T2. One-way ANOVA of ``value`` by ``group``: F, p_value, eta_squared,
    significant, n_obs, n_groups (plus the sums of squares)."""
    p = _anova_parts(_group_stats(gv))
    has_groups = F.col("n_groups") > 0  # empty input: every statistic is NULL
    dfb = F.when(has_groups, (F.col("n_groups") - 1).cast("double"))
    dfw = F.when(has_groups, (F.col("n_used") - F.col("n_groups")).cast("double"))
    # one group (df_between 0) or one row per group (df_within 0): F is NULL
    f = F.try_divide(F.try_divide(F.col("ss_between"), dfb), F.try_divide(F.col("ss_within"), dfw))
    out = p.select("*", dfb.alias("df_between"), dfw.alias("df_within"), f.alias("F"))
    out = out.select("*", f_sf_udf(F.col("F"), F.col("df_between"), F.col("df_within")).alias("p_value"))
    ss_total = F.col("ss_between") + F.col("ss_within")
    return out.select(
        F.lit(name).alias("test_name"), "F", "p_value",
        F.when(ss_total > 0, F.col("ss_between") / ss_total).alias("eta_squared"),
        (F.col("p_value") < alpha).alias("significant"),
        F.col("n_obs").cast("long").alias("n_obs"), F.col("n_groups").cast("long").alias("n_groups"),
        "ss_between", "ss_within", "df_between", "df_within")


def pairwise_mean_diff(gv: DataFrame, alpha: float = 0.05) -> DataFrame:
    """T3. All group pairs (group1 < group2): mean difference, Tukey-Kramer
    standard error and q statistic, and a simultaneous p-value by Scheffe's
    method (F distribution).  The pair table is built from the per-group
    statistics (one row per group), never from the raw rows.  The output has a row
    for each pair of groups, so the group column should be a label."""
    gs = settled(_group_stats(gv))   # one row per group, read three times below
    p = _anova_parts(gs)
    dfw = (F.col("n_used") - F.col("n_groups")).cast("double")
    whole = p.select(F.struct(F.try_divide(F.col("ss_within"), dfw).alias("mse"),
                              (F.col("n_groups") - 1).cast("double").alias("k1"), dfw.alias("dfw")).alias("a"))
    side = gs.where("n > 0")
    a = side.select(F.col("group").alias("group1"), F.col("n").alias("n1"), F.col("mean").alias("m1"))
    b = side.select(F.col("group").alias("group2"), F.col("n").alias("n2"), F.col("mean").alias("m2"))
    # pairs of groups are the test's output; they come from the per-group statistics
    pairs = a.join(b, F.col("group1") < F.col("group2"))
    pairs = pairs.withColumn("a", whole.scalar()).select("*", "a.*").drop("a")
    inv = 1.0 / F.col("n1") + 1.0 / F.col("n2")
    diff = F.col("m2") - F.col("m1")
    se = F.sqrt(F.col("mse") / 2.0 * inv)
    fs = F.try_divide(F.pow(diff, 2), F.col("mse") * inv * F.col("k1"))
    out = pairs.select("group1", "group2", diff.alias("meandiff"), se.alias("se"),
                       F.try_divide(F.abs(diff), se).alias("q_stat"),
                       f_sf_udf(fs, F.col("k1"), F.col("dfw")).alias("p_adj"))
    return out.select("*", (F.col("p_adj") < alpha).alias("reject"))


# ---------------------------------------------------------------------------
# T4 logistic regression (pyspark.ml)
# ---------------------------------------------------------------------------
LOGIT_SCHEMA = ("term string, coef double, std_err double, odds_ratio double, p_value double, "
                "ci_low_or double, ci_high_or double, n long, pseudo_r2 double, llf double, aic double")


def logit_odds(df: DataFrame, target_col: str, numeric_cols: Sequence[str],
               categorical_cols: Sequence[str] = (), alpha: float | None = None) -> DataFrame:
    """T4. Binary logit of ``target_col``: per term coef, std_err, odds ratio,
    Wald p-value and 95% CI of the odds ratio, plus n, McFadden pseudo-R2,
    log-likelihood and AIC; sorted by p-value, and only the terms with a p-value
    under ``alpha`` where that is given.  Fitted by IRLS over the distributed rows
    (``GeneralizedLinearRegression``); no rows give no terms."""
    from pyspark.ml.feature import RFormula, VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    spark = df.sparkSession
    cols = [target_col, *numeric_cols, *categorical_cols]
    _require(df, cols)
    sub = df.select(*cols).dropna()
    sub = sub.withColumn(target_col, F.col(target_col).try_cast("int")).dropna()
    # IRLS makes one pass per iteration and the summary some more: keep the rows until then
    sub = sub.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if sub.isEmpty():
            return spark.createDataFrame([], LOGIT_SCHEMA)
        if categorical_cols or not numeric_cols:
            terms = [*numeric_cols, *categorical_cols] or ["1"]
            rf = RFormula(formula=f"{target_col} ~ " + " + ".join(terms), featuresCol="features", labelCol="label")
            data = rf.fit(sub).transform(sub).select("features", F.col("label").cast("double").alias("label"))
        else:  # numeric terms only: no formula fitting pass needed
            va = VectorAssembler(inputCols=list(numeric_cols), outputCol="features")
            data = va.transform(sub.select(*[F.col(c).cast("double").alias(c) for c in numeric_cols],
                                           F.col(target_col).cast("double").alias("label"))).select("features", "label")
        model = GeneralizedLinearRegression(family="binomial", link="logit", maxIter=100, tol=1e-12).fit(data)
        s = model.summary
        names = ["Intercept", *numeric_cols]
        meta = data.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
        if categorical_cols and meta:
            names = ["Intercept"] + [a["name"] for kind in ("numeric", "binary") for a in meta.get(kind, [])]
        coefs = [model.intercept, *model.coefficients.toArray().tolist()]
        ses, pvals = list(s.coefficientStandardErrors), list(s.pValues)
        deviance, null_deviance, n, aic = s.deviance, s.nullDeviance, int(s.numInstances), float(s.aic)
    finally:
        sub.unpersist()
    ses = [ses[-1], *ses[:-1]]
    pvals = [pvals[-1], *pvals[:-1]]
    llf, llnull = -deviance / 2.0, -null_deviance / 2.0
    rows = [(names[i] if i < len(names) else f"x{i}", float(coefs[i]), float(ses[i]),
             _exp(coefs[i]), float(pvals[i]),
             _exp(coefs[i] - Z975 * ses[i]), _exp(coefs[i] + Z975 * ses[i]),
             n, 1.0 - llf / llnull if llnull else None, llf, aic)
            for i in range(len(coefs)) if alpha is None or pvals[i] < alpha]
    return spark.createDataFrame(rows, LOGIT_SCHEMA).orderBy("p_value")


def logit_scores(df: DataFrame, fitted: DataFrame, target_col: str, numeric_cols: Sequence[str]) -> DataFrame:
    """(term, score): the derivative of the log-likelihood in each coefficient at the
    fitted ones; zero at the maximum."""
    coef = {r["term"]: r["coef"] for r in fitted.select("term", "coef").collect()}
    terms = ["Intercept", *numeric_cols]
    sub = df.select(F.col(target_col).try_cast("int").alias("_y"),
                    *[F.col(c).cast("double").alias(c) for c in numeric_cols]).dropna()
    eta = sum((F.col(c) * coef[c] for c in numeric_cols), F.lit(coef["Intercept"]))
    resid = F.col("_y") - 1 / (1 + F.exp(-eta))
    sums = sub.agg(F.sum(resid).alias("Intercept"), *[F.sum(resid * F.col(c)).alias(c) for c in numeric_cols])
    return sums.selectExpr(f"stack({len(terms)}, " + ", ".join(f"'{t}', `{t}`" for t in terms) + ") AS (term, score)")


# ---------------------------------------------------------------------------
# T5 Spearman correlation of cohort age with behaviour
# ---------------------------------------------------------------------------
def spearman(df: DataFrame, x: str, ys: Sequence[str]) -> DataFrame:
    """Spearman rho of ``x`` with each of ``ys`` (average ranks for ties) and the
    t-approximation p-value.  Ranks come from distributed prefix sums over
    distinct values; Pearson correlation of the ranks is a Spark aggregate."""
    sub = df.select(x, *ys).dropna()
    # all metrics as long rows: one order for the ranks of every column, and the correlation from
    # counts of (x, y), so neither depends on the number of metrics
    names = list(dict.fromkeys([x, *ys]))

    def melted(columns: Sequence[str], *keep: str) -> DataFrame:
        pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
        return sub.selectExpr(*keep, f"stack({len(columns)}, {pairs}) AS (metric, value)")
    ranks = settled(average_ranks(melted(names), "value", ("metric",)).select("metric", "value", "avg_rank"))
    joint = melted(ys, f"CAST(`{x}` AS DOUBLE) AS _x").groupBy("metric", "_x", "value").agg(F.count(F.lit(1)).alias("k"))
    of_x = ranks.where(F.col("metric") == x).select(F.col("value").alias("_x"), F.col("avg_rank").alias("rx"))
    joint = join_counted(join_counted(joint, of_x, ["_x"]), ranks, ["metric", "value"])
    k, rx, ry = F.col("k"), F.col("rx"), F.col("avg_rank")
    sums = joint.groupBy("metric").agg(F.sum(k).alias("n"), *[F.sum(k * v).alias(a) for a, v in (
        ("sx", rx), ("sy", ry), ("sxx", rx * rx), ("syy", ry * ry), ("sxy", rx * ry))])
    n = F.col("n")
    spread = F.sqrt((n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("syy") - F.col("sy") * F.col("sy")))
    rho = F.when(spread > 0, (n * F.col("sxy") - F.col("sx") * F.col("sy")) / spread)
    # a metric without rows has its own row, as an aggregate without groups does
    every = df.sparkSession.createDataFrame([(y,) for y in ys], "metric string")
    res = every.join(F.broadcast(sums.withColumn("spearman_rho", rho).select("metric", "spearman_rho", "n")), "metric", "left") \
        .withColumn("n", F.coalesce("n", F.lit(0)))
    dof = (F.col("n") - 2).cast("double")
    t = F.col("spearman_rho") * F.sqrt(F.try_divide(dof, 1.0 - F.pow(F.col("spearman_rho"), 2)))
    res = res.select("metric", "spearman_rho", F.when(F.abs(F.col("spearman_rho")) >= 1.0, F.lit(0.0))
                     .otherwise(t_sf2_udf(t, dof)).alias("p_value"), F.col("n").cast("long").alias("n"))
    return res.select("*", (F.col("p_value") < 0.05).alias("significant"))


def spearman_cohort_age(df: DataFrame, age_col: str = "cohort_age", freq_col: str = "avg_freq",
                        arpu_col: str = "arpu", min_age: int = 1, max_age: int = 4,
                        min_active_users: int = 100) -> DataFrame:
    """T5. Spearman of cohort age with orders/active and revenue/active, over
    ages ``min_age..max_age`` and cells with at least ``min_active_users``."""
    _require(df, [age_col, freq_col, arpu_col, "active_users"])
    sub = df.where(F.col(age_col).between(min_age, max_age) & (F.col("active_users") >= min_active_users))
    return spearman(sub, age_col, [freq_col, arpu_col])


# ---------------------------------------------------------------------------
# T6-T8 paired before/after tests
# ---------------------------------------------------------------------------
def paired_periods(df: DataFrame, id_col: str = "user_id", period_col: str = "point_of_view",
                   value_col: str = "value", before_label: str = C.PAST, after_label: str = C.CURRENT,
                   group: Sequence[str] = ()) -> DataFrame:
    """T6. Long -> wide per id: mean value before and after (duplicates averaged);
    only ids present in both periods.  One aggregation keyed by id."""
    w = (df.groupBy(*group, id_col).pivot(period_col, [before_label, after_label])
         .agg(F.avg(value_col)))
    return w.select(*group, id_col, F.col(before_label).alias("before_value"),
                    F.col(after_label).alias("after_value")).dropna(subset=["before_value", "after_value"])


def wilcoxon_signed_rank(wide: DataFrame, before_col: str = "before_value", after_col: str = "after_value",
                         group: Sequence[str] = ()) -> DataFrame:
    """T7. Two-sided Wilcoxon signed-rank test per group (zero differences
    dropped, average ranks for ties).  The p-value is the normal approximation with
    tie correction for every n.

    stat = min(W+, W-); n counts all pairs (zeros included) as in the original;
    rank_biserial = 1 - 2 stat / (n (n + 1)) as in the original,
    rank_biserial_std = (W+ - W-) / (m (m + 1) / 2) over the m non-zero pairs.
    """
    _require(wide, [before_col, after_col, *group])
    keys = list(group) or ["_all"]
    d = wide.select(*group, *([] if group else [F.lit(0).alias("_all")]),
                    (F.col(after_col).try_cast("double") - F.col(before_col).try_cast("double")).alias("d")).dropna(subset=["d"])
    # one ordered histogram: the differences by size, with how many are above and below zero.
    # Signed ranks need the rows of smaller size; the median's place follows from the same sums, as the
    # negative differences lie in the opposite order below the zeros and the positive ones above.
    counts = d.groupBy(*keys, F.abs("d").alias("ad")).agg(
        F.count_if(F.col("d") > 0).alias("npos"), F.count_if(F.col("d") < 0).alias("nneg"),
        F.count_if(F.col("d") == 0).alias("nzero"), F.sum("d").alias("total"))
    hist = prefix_sums(counts, [F.col("ad").asc()], {"pos_before": "npos", "neg_before": "nneg"}, keys)
    sizes = hist.groupBy(*keys).agg(F.sum("nneg").alias("below"), F.sum("nzero").alias("zeros"),
                                    (F.sum("npos") + F.sum("nneg") + F.sum("nzero")).alias("n_all"))
    h = join_counted(hist, sizes, keys)
    cnt = F.col("npos") + F.col("nneg")
    avg_rank = F.col("pos_before") + F.col("neg_before") + (cnt + 1) / 2.0

    def at(k):
        """The difference at place ``k`` of the signed order, in the row that holds it."""
        negative = F.col("below") - F.col("neg_before")
        positive = F.col("below") + F.col("zeros") + F.col("pos_before")
        return F.max(F.when((k > negative - F.col("nneg")) & (k <= negative), -F.col("ad"))
                     .when((k > F.col("below")) & (k <= F.col("below") + F.col("nzero")), F.lit(0.0))
                     .when((k > positive) & (k <= positive + F.col("npos")), F.col("ad")))
    j = h.groupBy(*keys).agg(
        F.max("n_all").alias("n_all"), F.sum("total").alias("total"),
        ((at(F.floor((F.col("n_all") + 1) / 2)) + at(F.floor(F.col("n_all") / 2) + 1)) / 2.0).alias("median"),
        F.sum(F.when(cnt > 0, avg_rank * F.col("npos"))).alias("w_plus"),
        F.sum(F.when(cnt > 0, avg_rank * F.col("nneg"))).alias("w_minus"),
        F.sum(cnt).alias("m"), F.sum(F.pow(cnt, 3) - cnt).alias("ties"))
    j = j.withColumn("mean_diff", F.col("total") / F.col("n_all"))
    m = F.coalesce(F.col("m"), F.lit(0)).cast("double")
    stat = F.least("w_plus", "w_minus")
    mean = m * (m + 1) / 4.0
    var = m * (m + 1) * (2 * m + 1) / 24.0 - F.coalesce(F.col("ties"), F.lit(0)) / 48.0
    z = F.try_divide(stat - mean, F.sqrt(var))
    n_all = F.col("n_all").cast("double")
    p = norm_sf2_udf(z)
    return j.select(
        *group, F.lit("wilcoxon_signed_rank").alias("test"), stat.alias("stat"),
        p.alias("p_value"), F.col("n_all").cast("long").alias("n"),
        F.col("median").alias("median_diff"), "mean_diff",
        (1.0 - 2.0 * stat / (n_all * (n_all + 1))).alias("rank_biserial"),
        F.try_divide(F.col("w_plus") - F.col("w_minus"), m * (m + 1) / 2.0).alias("rank_biserial_std"))


def test_battery(tables: dict[str, tuple[DataFrame, Sequence[str]]], id_col: str = "user_id",
                 period_col: str = "point_of_view") -> DataFrame:
    """T8. Wilcoxon before/after tests for several (table, metric) pairs in one
    job: metrics are melted to long rows with ``stack``, paired per
    (table, metric, id), and tested grouped by (table, metric); sorted by p."""
    longs = []
    for name, (df, metrics) in tables.items():
        stack = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in metrics)
        longs.append(df.selectExpr(f"'{name}' AS `table`", f"`{id_col}`", f"`{period_col}`",
                                   f"stack({len(metrics)}, {stack}) AS (metric, value)"))
    long = longs[0]
    for x in longs[1:]:
        long = long.unionByName(x)
    wide = paired_periods(long, id_col, period_col, "value", group=("table", "metric"))
    return wilcoxon_signed_rank(wide, group=("table", "metric")).orderBy("p_value")


# ---------------------------------------------------------------------------
# T9 segment x age regression with cohort fixed effects
# ---------------------------------------------------------------------------
def _levels(d: DataFrame, cat: str, max_levels: int) -> list[str]:
    levels = sorted(r[0] for r in d.select(cat).distinct().limit(max_levels + 1).collect())
    if len(levels) > max_levels:
        raise ValueError(f"{cat} has more than {max_levels} levels")
    return levels


def _demeaned(df: DataFrame, y: str, x: str, cat: str, cluster: str, levels: list[str]) -> tuple[list[str], DataFrame]:
    """Names of the terms, and label, cluster and one column _v0, _v1, ... per term,
    each less its mean within the cluster."""
    d = df.select(y, x, cat, cluster).dropna()
    cols = {x: F.col(x).cast("double")}
    for lv in levels[1:]:
        dummy = (F.col(cat) == F.lit(lv)).cast("double")
        cols[f"{cat}[T.{lv}]"] = dummy
        cols[f"{x}:{cat}[T.{lv}]"] = dummy * F.col(x).cast("double")
    w = Window.partitionBy(cluster)
    flat = d.select(F.col(y).cast("double").alias("_y"), cluster, *[c.alias(f"_v{i}") for i, c in enumerate(cols.values())])
    return list(cols), flat.select((F.col("_y") - F.avg("_y").over(w)).alias("label"), cluster, *[
        (F.col(f"_v{i}") - F.avg(f"_v{i}").over(w)).alias(f"_v{i}") for i in range(len(cols))])


def regression_scores(df: DataFrame, fitted: DataFrame, y: str = "cnt_retention", x: str = "cohort_age",
                      cat: str = "rfm_segment", cluster: str = "cohort_date", max_levels: int = 100) -> DataFrame:
    """(term, score): the inner product of each demeaned column with the residuals at the
    fitted coefficients; zero where the normal equations hold."""
    coef = {r["term"]: r["coef"] for r in fitted.select("term", "coef").collect()}
    names, dm = _demeaned(df, y, x, cat, cluster, _levels(df.select(y, x, cat, cluster).dropna(), cat, max_levels))
    resid = F.col("label") - sum((F.col(f"_v{i}") * coef[t] for i, t in enumerate(names)), F.lit(0.0))
    sums = dm.agg(*[F.sum(resid * F.col(f"_v{i}")).alias(f"_s{i}") for i in range(len(names))])
    pairs = ", ".join(f"'{t}', _s{i}" for i, t in enumerate(names))
    return sums.selectExpr(f"stack({len(names)}, {pairs}) AS (term, score)")


def segment_age_regression(df: DataFrame, y: str = "cnt_retention", x: str = "cohort_age",
                           cat: str = "rfm_segment", cluster: str = "cohort_date",
                           max_levels: int = 100) -> DataFrame:
    """T9. ``y ~ x * C(cat)`` with cohort fixed effects (the original fits a
    random cohort intercept with an iterative single-machine solver).

    Every variable is demeaned within its cohort by a window over the cohort's
    rows, then an OLS without intercept is fitted by ``LinearRegression``
    (normal equations, distributed).  The first segment (sorted) is the
    reference level; interaction columns are built explicitly.  The absorbed cohort
    means cost a degree of freedom each, so standard errors, t and p are those of the
    regression with one dummy variable per cohort.  More than ``max_levels`` levels of
    ``cat`` are an error: the model is for labels.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    levels = _levels(df.select(y, x, cat, cluster).dropna(), cat, max_levels)
    schema = "term string, coef double, std_err double, t_value double, p_value double, n_obs long, reference string"
    if not levels:  # nothing to fit
        return df.sparkSession.createDataFrame([], schema)
    ref = levels[0]
    names, dm = _demeaned(df, y, x, cat, cluster, levels)
    dm = dm.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        data = VectorAssembler(inputCols=[f"_v{i}" for i in range(len(names))], outputCol="features").transform(dm)
        model = LinearRegression(fitIntercept=False, solver="normal", regParam=0.0).fit(data)
        s = model.summary
        ses, n = list(s.coefficientStandardErrors), int(s.numInstances)
        clusters = dm.agg(F.count_distinct(cluster)).first()[0]
    finally:
        dm.unpersist()
    coefs = model.coefficients.toArray().tolist()
    free, k = n - len(names) - clusters, len(names)
    rows = []
    for name, coef, se in zip(names, coefs, ses):
        se = float(se) * math.sqrt((n - k) / free) if free > 0 else float("nan")
        t = coef / se if se else float("nan")
        rows.append((name, float(coef), se, t, t_sf2(t, free), n, ref))
    return df.sparkSession.createDataFrame(rows, schema)


# ---------------------------------------------------------------------------
# Summary of all tests
# ---------------------------------------------------------------------------
SUMMARY = "test string, name string, n long, statistic double, p_value double, effect_size double, significant boolean"


def test_summary(chi2: DataFrame, anova: DataFrame, logit: DataFrame, rank_corr: DataFrame, battery: DataFrame,
                 alpha: float = 0.05) -> DataFrame:
    """One row per test or model term: what was tested, n, the statistic, its p-value,
    the effect size and whether p is under ``alpha``; sorted by p.

    Effect sizes: Cramer's V, eta squared, odds ratio, Spearman's rho, rank-biserial."""
    def rows(df: DataFrame, test: str, name, n, statistic, effect) -> DataFrame:
        return df.select(F.lit(test).alias("test"), name.alias("name"), F.col(n).cast("long").alias("n"),
                         F.col(statistic).cast("double").alias("statistic"), F.col("p_value").cast("double"),
                         F.col(effect).cast("double").alias("effect_size"))
    out = rows(chi2, "chi_square", F.lit("retention by period"), "n", "chi2", "cramers_v") \
        .unionByName(rows(anova, "anova", F.col("test_name"), "n_obs", "F", "eta_squared")) \
        .unionByName(rows(logit, "logit", F.col("term"), "n", "coef", "odds_ratio")) \
        .unionByName(rows(rank_corr, "spearman", F.col("metric"), "n", "spearman_rho", "spearman_rho")) \
        .unionByName(rows(battery, "wilcoxon", F.concat_ws(".", "table", "metric"), "n", "stat", "rank_biserial"))
    return out.select("*", (F.col("p_value") < alpha).alias("significant")).orderBy("p_value", "test", "name")
