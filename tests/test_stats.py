"""Statistics against textbook values and brute-force single-machine versions."""
import math
import random

import numpy as np
import pytest

from churnlens.stats import distributions as D
from churnlens.stats import tests as st


def test_tail_probabilities():
    assert D.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert D.chi2_sf(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-9)
    assert D.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert D.f_sf(4.102821015130399, 2, 10) == pytest.approx(0.05, abs=1e-9)
    assert D.f_sf(2.866081402, 4, 20) == pytest.approx(0.05, abs=1e-8)
    assert D.t_sf2(2.228138851986274, 10) == pytest.approx(0.05, abs=1e-9)
    assert D.t_sf2(1.959963984540054, 1e9) == pytest.approx(0.05, abs=1e-6)
    assert 2 * D.norm_sf(1.959963984540054) == pytest.approx(0.05, abs=1e-12)


def test_chi2_rate_test(spark):
    df = spark.createDataFrame([("past", 100.7, 30.2), ("current", 100.0, 45.0), ("bad", 5.0, 9.0)],
                               "g string, total double, success double")
    r = st.chi2_rate_test(df, "g", "total", "success").first()
    # success truncated to int, failure = int(total - success); the row with success > total is dropped
    obs = np.array([[30, 70], [45, 55]], dtype=float)
    exp = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    chi2 = ((obs - exp) ** 2 / exp).sum()
    assert r.chi2 == pytest.approx(chi2) and r.dof == 1 and r.n == 200
    assert r.p_value == pytest.approx(math.erfc(math.sqrt(chi2 / 2)))
    assert r.cramers_v == pytest.approx(math.sqrt(chi2 / 200))


def test_anova_and_pairs(spark):
    rnd = random.Random(3)
    data = [(g, rnd.gauss(mu, 1.0)) for g, mu in [("a", 0.0), ("b", 0.5), ("c", 1.0)] for _ in range(12)]
    gv = spark.createDataFrame(data, "group string, value double")
    r = st.anova_oneway(gv).first()
    groups = {g: np.array([v for gg, v in data if gg == g]) for g in "abc"}
    allv = np.concatenate(list(groups.values()))
    ssb = sum(len(x) * (x.mean() - allv.mean()) ** 2 for x in groups.values())
    ssw = sum(((x - x.mean()) ** 2).sum() for x in groups.values())
    f = (ssb / 2) / (ssw / 33)
    assert r.F == pytest.approx(f) and r.n_obs == 36 and r.n_groups == 3
    assert r.p_value == pytest.approx(D.f_sf(f, 2, 33))
    assert r.eta_squared == pytest.approx(ssb / (ssb + ssw))
    pairs = {(p.group1, p.group2): p for p in st.pairwise_mean_diff(gv).collect()}
    mse = ssw / 33
    ab = pairs[("a", "b")]
    assert ab.meandiff == pytest.approx(groups["b"].mean() - groups["a"].mean())
    assert ab.se == pytest.approx(math.sqrt(mse / 2 * (1 / 12 + 1 / 12)))
    assert len(pairs) == 3


def _wilcoxon_reference(before, after):
    d = [a - b for a, b in zip(after, before)]
    nz = [x for x in d if x != 0]
    absd = sorted(abs(x) for x in nz)
    rank = {}
    for v in set(absd):
        pos = [i + 1 for i, x in enumerate(absd) if x == v]
        rank[v] = sum(pos) / len(pos)
    wp = sum(rank[abs(x)] for x in nz if x > 0)
    wm = sum(rank[abs(x)] for x in nz if x < 0)
    n = len(nz)
    ties = sum(absd.count(v) ** 3 - absd.count(v) for v in set(absd))
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    t = min(wp, wm)
    z = (t - n * (n + 1) / 4) / math.sqrt(var)
    return t, 2 * D.norm_sf(abs(z)), len(d), wp, wm, n


def test_wilcoxon_against_brute_force(spark):
    rnd = random.Random(7)
    before = [float(rnd.randrange(10)) for _ in range(60)]
    after = [b + rnd.choice([-2.0, -1.0, 0.0, 0.0, 1.0, 2.0, 3.0]) for b in before]
    wide = spark.createDataFrame(list(zip(before, after)), "before_value double, after_value double")
    r = st.wilcoxon_signed_rank(wide).first()
    t, p, n_all, wp, wm, m = _wilcoxon_reference(before, after)
    assert r.stat == pytest.approx(t) and r.p_value == pytest.approx(p) and r.n == n_all
    d = [a - b for a, b in zip(after, before)]
    assert r.median_diff == pytest.approx(float(np.median(d)))
    assert r.mean_diff == pytest.approx(float(np.mean(d)))
    assert r.rank_biserial == pytest.approx(1 - 2 * t / (n_all * (n_all + 1)))
    assert r.rank_biserial_std == pytest.approx((wp - wm) / (m * (m + 1) / 2))


def test_battery_groups_and_pairs(spark):
    rows = [(u, pov, float(u % 5 + (pov == "current") * (u % 3))) for u in range(40) for pov in ("past", "current")]
    rows += [(1000, "past", 1.0)]  # only one period -> dropped from the pairing
    df = spark.createDataFrame(rows, "user_id long, point_of_view string, m1 double")
    df = df.withColumn("m2", df.m1 * 2)
    res = st.test_battery({"t": (df, ["m1", "m2"])}).collect()
    assert {r.metric for r in res} == {"m1", "m2"} and all(r.n == 40 for r in res)


def test_spearman(spark):
    rnd = random.Random(5)
    xs = [rnd.randrange(1, 5) for _ in range(50)]
    ys = [x * 0.5 + rnd.random() for x in xs]
    df = spark.createDataFrame(list(zip(xs, ys, ys)), "age int, f double, a double")
    r = {x.metric: x for x in st.spearman(df, "age", ["f", "a"]).collect()}

    def avg_rank(v):
        s = sorted(v)
        return [np.mean([i + 1 for i, w in enumerate(s) if w == x]) for x in v]
    rho = np.corrcoef(avg_rank(xs), avg_rank(ys))[0, 1]
    assert r["f"].spearman_rho == pytest.approx(rho) and r["f"].n == 50
    t = rho * math.sqrt(48 / (1 - rho ** 2))
    assert r["f"].p_value == pytest.approx(D.t_sf2(t, 48))


def test_logit_matches_irls(spark):
    rnd = random.Random(11)
    rows = []
    for _ in range(300):
        x1, x2 = rnd.gauss(0, 1), rnd.gauss(0, 1)
        p = 1 / (1 + math.exp(-(0.3 + 1.2 * x1 - 0.7 * x2)))
        rows.append((int(rnd.random() < p), x1, x2))
    df = spark.createDataFrame(rows, "y int, x1 double, x2 double")
    got = {r.term: r for r in st.logit_odds(df, "y", ["x1", "x2"]).collect()}
    X = np.array([[1.0, r[1], r[2]] for r in rows])
    y = np.array([r[0] for r in rows], dtype=float)
    b = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-X @ b))
        W = p * (1 - p)
        b = b + np.linalg.solve(X.T @ (X * W[:, None]), X.T @ (y - p))
    cov = np.linalg.inv(X.T @ (X * (p * (1 - p))[:, None]))
    for i, name in enumerate(["Intercept", "x1", "x2"]):
        assert got[name].coef == pytest.approx(b[i], abs=1e-6)
        assert got[name].std_err == pytest.approx(math.sqrt(cov[i, i]), rel=1e-4)
        assert got[name].odds_ratio == pytest.approx(math.exp(b[i]), rel=1e-6)
    llf = float(np.sum(y * np.log(p) + (1 - y) * np.log(1 - p)))
    assert got["x1"].llf == pytest.approx(llf, rel=1e-6)


def test_fixed_effects_regression(spark):
    rnd = random.Random(2)
    rows = []
    for c in range(6):
        shift = rnd.gauss(0, 1)
        for seg in ("A", "B"):
            for age in range(4):
                y = shift + 0.1 * age + (0.3 if seg == "B" else 0) - (0.05 * age if seg == "B" else 0) \
                    + rnd.gauss(0, 0.01)
                rows.append((f"c{c}", seg, age, y))
    df = spark.createDataFrame(rows, "cohort_date string, rfm_segment string, cohort_age int, cnt_retention double")
    got = {r.term: r.coef for r in st.segment_age_regression(df).collect()}
    assert got["cohort_age"] == pytest.approx(0.1, abs=0.01)
    assert got["rfm_segment[T.B]"] == pytest.approx(0.3, abs=0.02)
    assert got["cohort_age:rfm_segment[T.B]"] == pytest.approx(-0.05, abs=0.01)


def test_wilcoxon_small_sample_uses_the_normal_form(spark):
    d = [1.5, -2.5, 3.5, 4.5, 5.5, -6.5, 7.5, 8.5, 9.5]
    wide = spark.createDataFrame([(0.0, x) for x in d], "before_value double, after_value double")
    r = st.wilcoxon_signed_rank(wide).first()
    t, p, *_ = _wilcoxon_reference([0.0] * len(d), d)
    assert r.stat == t == 8.0 and r.p_value == pytest.approx(p)


def test_large_arguments_converge():
    assert D.chi2_sf(1e6, 1e6) == pytest.approx(0.49981, abs=2e-4)
    assert D.chi2_sf(1e8, 1e8) == pytest.approx(0.49998, abs=2e-4)
    with pytest.raises(ArithmeticError):
        D.gammaincc(float("nan"), 1.0)


def test_anova_counts_all_rows_and_uses_defined_rates(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 2, 2), ("b", 3, 1), ("b", 0, 0), ("c", None, 5), ("b", 1, 1)],
                               "rfm_segment string, action_number int, non_action_number int") \
        .selectExpr("*", "1 AS curr_period")
    r = st.anova_oneway(st.retention_rates(df)).first()
    a, b = np.array([0.25, 0.5]), np.array([0.75, 0.5])
    allv = np.concatenate([a, b])
    ssb = sum(len(x) * (x.mean() - allv.mean()) ** 2 for x in (a, b))
    ssw = sum(((x - x.mean()) ** 2).sum() for x in (a, b))
    assert r.n_obs == 6 and r.n_groups == 2 and r.df_within == 2
    assert r.F == pytest.approx(ssb / (ssw / 2))


def test_significant_terms_of_the_logit(spark):
    rnd = random.Random(4)
    rows = [(int(rnd.random() < 1 / (1 + math.exp(-2 * x))), x, rnd.gauss(0, 1)) for x in
            (rnd.gauss(0, 1) for _ in range(200))]
    df = spark.createDataFrame(rows, "y int, x1 double, noise double")
    every = {r.term: r.p_value for r in st.logit_odds(df, "y", ["x1", "noise"]).collect()}
    some = {r.term for r in st.logit_odds(df, "y", ["x1", "noise"], alpha=0.05).collect()}
    assert some == {t for t, p in every.items() if p < 0.05} and "x1" in some


def test_fixed_effects_errors_equal_dummy_variables(spark):
    rnd = random.Random(8)
    rows = [(f"c{c}", seg, age, 0.4 + 0.05 * c - 0.02 * age * (seg == "B") + rnd.gauss(0, 0.1))
            for c in range(5) for seg in "AB" for age in range(6)]
    df = spark.createDataFrame(rows, "cohort_date string, rfm_segment string, cohort_age int, cnt_retention double")
    got = {r.term: r for r in st.segment_age_regression(df).collect()}
    X = np.array([[age, seg == "B", age * (seg == "B"), *[c == f"c{k}" for k in range(5)]] for c, seg, age, _ in rows], float)
    y = np.array([r[3] for r in rows])
    b, rss = np.linalg.lstsq(X, y, rcond=None)[:2]
    free = len(y) - X.shape[1]
    se = np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * rss[0] / free)
    for k, term in enumerate(["cohort_age", "rfm_segment[T.B]", "cohort_age:rfm_segment[T.B]"]):
        assert got[term].coef == pytest.approx(b[k]) and got[term].std_err == pytest.approx(se[k])
        assert got[term].p_value == pytest.approx(D.t_sf2(b[k] / se[k], free))


def test_spearman_agrees_with_spark_ml(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation
    rnd = random.Random(9)
    rows = [(rnd.randrange(1, 5), float(rnd.randrange(20)), rnd.random()) for _ in range(80)]
    df = spark.createDataFrame(rows, "age int, f double, a double")
    ours = {r.metric: r.spearman_rho for r in st.spearman(df, "age", ["f", "a"]).collect()}
    vec = VectorAssembler(inputCols=["age", "f", "a"], outputCol="v").transform(df.withColumn("age", df.age.cast("double")))
    m = Correlation.corr(vec, "v", "spearman").head()[0].toArray()
    assert ours["f"] == pytest.approx(m[0, 1]) and ours["a"] == pytest.approx(m[0, 2])


def test_chi2_agrees_with_spark_ml_on_raw_rows(spark):
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.stat import ChiSquareTest
    table = [("past", 100, 30), ("current", 100, 45), ("other", 80, 20)]
    agg = spark.createDataFrame(table, "g string, total long, success long")
    ours = st.chi2_rate_test(agg, "g", "total", "success").first()
    raw = [(Vectors.dense([float(i)]), float(y)) for i, (_, tot, suc) in enumerate(table)
           for y in [1] * suc + [0] * (tot - suc)]
    r = ChiSquareTest.test(spark.createDataFrame(raw, ["features", "label"]), "features", "label").head()
    assert ours.chi2 == pytest.approx(r.statistics[0]) and ours.dof == r.degreesOfFreedom[0]
    assert ours.p_value == pytest.approx(r.pValues[0], abs=1e-9)


def test_degenerate_inputs_give_nulls_not_errors(spark):
    one_group = spark.createDataFrame([("a", 0.1), ("a", 0.3)], "group string, value double")
    r = st.anova_oneway(one_group).first()
    assert r.F is None and r.p_value is None and r.n_groups == 1
    assert st.pairwise_mean_diff(one_group).count() == 0
    per_row = spark.createDataFrame([("a", 0.1), ("b", 0.3)], "group string, value double")
    assert st.anova_oneway(per_row).first().F is None
    assert st.pairwise_mean_diff(per_row).first().p_adj is None
    no_success = spark.createDataFrame([("x", 10.0, 0.0), ("y", 5.0, 0.0)], "g string, total double, success double")
    c = st.chi2_rate_test(no_success, "g", "total", "success").first()
    assert c.chi2 is None and c.n == 15


def test_model_fits_on_empty_input(spark):
    empty = spark.createDataFrame([], "y int, x1 double, cohort_date string, rfm_segment string, "
                                      "cohort_age int, cnt_retention double")
    assert st.logit_odds(empty, "y", ["x1"]).count() == 0
    assert st.segment_age_regression(empty).count() == 0
