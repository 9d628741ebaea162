"""Mart sinks/sources (S2-S9) and the incremental log loader."""
import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from churnlens.sources import logs, mart


def _tmp():
    return tempfile.mkdtemp(prefix="churnlens-test-", dir="/tmp")


def test_mart_modes(spark):
    root = _tmp()
    df = spark.createDataFrame([(dt.date(2020, 1, 31), 1), (dt.date(2020, 2, 29), 2)], "snapshot_date date, v int")
    mart.write_mart(df, root, "t", partition_by=("snapshot_date",))
    mart.write_mart(df, root, "t", mode="append", partition_by=("snapshot_date",))
    assert mart.read_mart(spark, root, "t").count() == 4
    # dynamic overwrite replaces only the January partition
    jan = spark.createDataFrame([(dt.date(2020, 1, 31), 9)], "snapshot_date date, v int")
    mart.write_mart(jan, root, "t", partition_by=("snapshot_date",))
    got = sorted((r.snapshot_date, r.v) for r in mart.read_mart(spark, root, "t").collect())
    assert got == [(dt.date(2020, 1, 31), 9), (dt.date(2020, 2, 29), 2), (dt.date(2020, 2, 29), 2)]
    # 'ignore' leaves an existing table untouched
    mart.write_mart(jan, root, "t", mode="ignore", partition_by=("snapshot_date",))
    assert mart.read_mart(spark, root, "t").count() == 3
    # create-if-absent skips existing tables
    assert mart.create_if_absent({"t": df, "u": df}, root) == {"t": "skipped", "u": "written"}
    assert not mart.mart_exists(spark, root, "nope")


def test_read_mart_pushes_down(spark):
    root = _tmp()
    df = spark.range(100).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"), F.lit("x").alias("c"))
    mart.write_mart(df, root, "p")
    r = mart.read_mart(spark, root, "p", columns=["a", "b"], where="a > 90")
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(a), GreaterThan(a,90)]" in plan
    assert "ReadSchema: struct<a:bigint,b:bigint>" in plan
    assert r.count() == 9


def _raw_csv(spark, folder):
    rows = [("2019-10-01 00:00:01 UTC", "view", 1, 10, "a.b", "x", "1.50", 7, "s1"),
            ("2019-10-02 10:00:00 UTC", "purchase", 1, 10, "a.b", "x", "1.50", 7, "s1"),
            ("2019-11-03 10:00:00 UTC", "cart", 2, 11, None, "y", "2.00", 8, "s2")]
    hdr = "event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session\n"
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "part1.csv"), "w") as f:
        f.write(hdr + "".join(",".join("" if v is None else str(v) for v in r) + "\n" for r in rows))


def test_load_events_partitioned(spark):
    base = _tmp()
    _raw_csv(spark, f"{base}/raw")
    raw = logs.read_raw_log(spark, f"{base}/raw")
    logs.load_events(raw, f"{base}/events")
    ev = logs.read_events(spark, f"{base}/events")
    assert ev.count() == 3
    assert sorted(r.event_month for r in ev.select("event_month").distinct().collect()) == ["2019-10", "2019-11"]
    assert {"event_month=2019-10", "event_month=2019-11"} <= set(os.listdir(f"{base}/events"))


def test_stream_ingest_exactly_once(spark):
    from churnlens.streaming.ingest import ingest_log_stream
    base = _tmp()
    _raw_csv(spark, f"{base}/raw")
    for _ in range(2):  # second run finds no new files
        q = ingest_log_stream(spark, f"{base}/raw", f"{base}/events", f"{base}/ckpt")
        q.awaitTermination(120)
    assert spark.read.parquet(f"{base}/events").count() == 3


def test_build_marts_end_to_end(spark):
    from churnlens.plans.marts import build_marts
    from churnlens.sources import tables
    root = _tmp()
    sf = "/root/testdata/sf0.001"
    out = build_marts(tables.order_events(spark, sf), root,
                      category_events=tables.category_purchase_events(spark, sf),
                      behaviour_events=tables.click_events(spark, sf))
    assert len(out) == 32
    assert mart.read_mart(spark, root, "churn_user_ltv_stat").count() == 1
    # the written marts hold the same rows as the registered queries
    import __spark_entry__ as E
    for name, query in (("monthly_rfm", "monthly_rfm"), ("monthly_churn", "churn_status"),
                        ("cohort_stat", "cohort_retention")):
        q = E.queries()[query](spark, sf)
        m = mart.read_mart(spark, root, name).select(*q.columns)
        m = m.select(*[F.round(c, 6).alias(c) if t in ("double",) or t.startswith("decimal") else F.col(c)
                       for c, t in m.dtypes])
        q = q.select(*[F.col(c).cast(t) for c, t in m.dtypes])
        assert m.exceptAll(q).count() == 0 and q.exceptAll(m).count() == 0, name


def test_bucketed_marts_join_without_shuffle(spark):
    root = _tmp()
    a = spark.range(2000).select((F.col("id") % 300).alias("user_id"), F.col("id").alias("a"))
    b = spark.range(900).select((F.col("id") % 300).alias("user_id"), F.col("id").alias("b"))
    mart.write_bucketed(a, "bk_a", "user_id", 8, path=f"{root}/bk_a")
    mart.write_bucketed(b, "bk_b", "user_id", 8, path=f"{root}/bk_b")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table("bk_a").join(spark.table("bk_b"), "user_id")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert j.count() == 2000 * 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS bk_a")
        spark.sql("DROP TABLE IF EXISTS bk_b")
