"""DuckDB SQL twins of the registered queries (correctness oracle).

Each states what an operator means over the raw events: as-of values come from ASOF
joins and correlated subqueries against the calendar, where the Spark plans expand one
(user, period) aggregate.  The calendar is derived in SQL from the table's own time span.

Each oracle casts to the engine's output types: counts BIGINT, scores INT,
dates DATE, money and ratios DOUBLE rounded to 6 places (money is summed as
DECIMAL(18,2) first, so sums are exact in both engines).
"""

from __future__ import annotations

from ..config import DEFAULT, WEEKLY_EVENTS, Params
from .calendars import ORDERS_CALENDAR, RETENTION_TESTS, SPEARMAN_MIN_USERS

# ---------------------------------------------------------------------------
# event sources
# ---------------------------------------------------------------------------
EV_ORDERS = """ev AS (
  SELECT o_custkey AS user_id, o_orderdate AS event_time, 'purchase' AS event_type,
         CAST(o_totalprice AS DECIMAL(18,2)) AS price,
         CAST(NULL AS VARCHAR) AS category_id, CAST(NULL AS VARCHAR) AS category_code
  FROM orders)"""

EV_LINES = """cev AS (
  SELECT o.o_custkey AS user_id, o.o_orderdate AS event_time, 'purchase' AS event_type,
         CAST(ROUND(CAST(l.l_extendedprice AS DECIMAL(18,2))
               * (1 - CAST(l.l_discount AS DECIMAL(18,2))), 2) AS DECIMAL(18,2)) AS price,
         p.p_brand AS category_id, p.p_type AS category_code
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                  JOIN part p ON l.l_partkey = p.p_partkey)"""

EV_CLICKS = """ev AS (
  SELECT CAST(user_id AS BIGINT) AS user_id, ts AS event_time, event_type,
         CAST(value AS DECIMAL(18,2)) AS price,
         json_extract_string(props, '$.k') AS category_id, CAST(NULL AS VARCHAR) AS category_code
  FROM events)"""


def _r(x: str) -> str:
    # "+ 0.0" turns a rounded -0.0 into 0.0 (Spark's round never yields -0.0)
    return f"(ROUND(CAST({x} AS DOUBLE), 6) + 0.0)"


def _ratio(num: str, den: str) -> str:
    return f"(ROUND(CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0), 6) + 0.0)"


def _pstart(x: str, grain: str) -> str:
    return f"CAST(date_trunc('{grain}', {x}) AS DATE)"


def _pend(start: str, grain: str) -> str:
    if grain == "month":
        return f"CAST(last_day({start}) AS DATE)"
    return f"CAST({start} + INTERVAL 6 DAY AS DATE)"


def _step(grain: str) -> str:
    return "INTERVAL 1 MONTH" if grain == "month" else "INTERVAL 7 DAY"


def cal(grain: str, src: str = "ev") -> str:
    """Calendar of every period between the first and last event of ``src``."""
    return f"""cal AS (
  SELECT CAST(ps AS DATE) AS period_start, {_pend('CAST(ps AS DATE)', grain)} AS snapshot_date
  FROM (SELECT unnest(generate_series(
          CAST(date_trunc('{grain}', min(event_time)) AS TIMESTAMP),
          CAST(date_trunc('{grain}', max(event_time)) AS TIMESTAMP), {_step(grain)})) AS ps
        FROM {src}))"""


def segment_case(r="recency_score", f="frequency_score", m="monetary_score") -> str:
    return f"""CASE
      WHEN {r} = 5 AND {f} = 5 AND {m} = 5 THEN 'VIP'
      WHEN {r} >= 4 AND {f} >= 4 AND {m} >= 4 THEN 'LOYAL'
      WHEN {r} >= 3 AND {f} >= 3 AND {m} >= 3 THEN 'GROWTH'
      WHEN {r} = 5 AND {f} = 1 THEN 'NEW'
      WHEN {r} = 1 AND {f} <= 2 THEN 'HIGH_CHURN_RISK'
      WHEN {r} = 2 AND {f} <= 2 THEN 'CHURN_EXPECTED'
      ELSE 'REGULAR' END"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ---------------------------------------------------------------------------
# A1-A4 whole-history RFM
# ---------------------------------------------------------------------------
def rfm_base_cte(p: Params = DEFAULT) -> str:
    """One row per buyer; the day after everyone's last purchase is read off the grouped rows."""
    return f"""rfm_base AS (
  SELECT user_id, latest AS last_order_ts, CAST(latest AS DATE) AS last_order_date,
         CAST(max(latest) OVER () AS DATE) + 1 AS standard_date,
         CAST(CAST(max(latest) OVER () AS DATE) + 1 - CAST(latest AS DATE) AS INTEGER) AS recency, frequency, monetary
  FROM (SELECT user_id, max(event_time) AS latest, count(*) AS frequency, sum(price) AS monetary
        FROM ev WHERE event_type = '{p.purchase_type}' GROUP BY user_id))"""


def rfm_score_cte(p: Params = DEFAULT) -> str:
    n = p.tiles
    return f"""rfm_sc AS (
  SELECT user_id, recency, frequency, monetary,
    CAST(ntile({n}) OVER (ORDER BY recency DESC, user_id) AS INTEGER) AS recency_score,
    CAST(ntile({n}) OVER (ORDER BY frequency ASC, user_id) AS INTEGER) AS frequency_score,
    CAST(ntile({n}) OVER (ORDER BY monetary ASC, user_id) AS INTEGER) AS monetary_score
  FROM rfm_base),
rfm_score AS (
  SELECT user_id, {segment_case()} AS rfm_segment, recency, recency_score,
         frequency, frequency_score, monetary, monetary_score
  FROM rfm_sc)"""


def q_rfm_base() -> str:
    return with_(EV_ORDERS, rfm_base_cte()) + f"""
SELECT user_id, last_order_ts, last_order_date, standard_date, recency, frequency,
       {_r('monetary')} AS monetary FROM rfm_base"""


def q_rfm_score() -> str:
    return with_(EV_ORDERS, rfm_base_cte(), rfm_score_cte()) + f"""
SELECT user_id, rfm_segment, recency, recency_score, frequency, frequency_score,
       {_r('monetary')} AS monetary, monetary_score FROM rfm_score"""


def q_rfm_segment_share() -> str:
    return with_(EV_ORDERS, rfm_base_cte(), rfm_score_cte()) + f"""
SELECT rfm_segment, count(*) AS cnt,
       {_ratio('count(*)', 'sum(count(*)) OVER ()')} AS user_ratio
FROM rfm_score GROUP BY rfm_segment"""


def q_rfm_segment_sales() -> str:
    return with_(EV_ORDERS, rfm_base_cte(), rfm_score_cte()) + f"""
SELECT rfm_segment, count(DISTINCT user_id) AS user_cnt,
       {_r('sum(monetary)')} AS monetary,
       {_ratio('sum(monetary)', 'sum(sum(monetary)) OVER ()')} AS monetary_ratio,
       {_ratio('sum(monetary)', 'count(monetary)')} AS arpu,
       {_r('avg(frequency)')} AS frequency_avg,
       {_r('avg(recency)')} AS recency_avg
FROM rfm_score GROUP BY rfm_segment"""


# ---------------------------------------------------------------------------
# A5, A6, A9-A11 snapshot RFM (naive: as-of history per snapshot)
# ---------------------------------------------------------------------------
def monthly_base_cte(p: Params = DEFAULT) -> str:
    """What a buyer bought in a snapshot's period, and by ASOF joins the buyer's and
    everyone's latest purchase day up to the snapshot."""
    return f"""bought AS (
  SELECT user_id, price, CAST(event_time AS DATE) AS day, {_pstart('event_time', p.grain)} AS period_start
  FROM ev WHERE event_type = '{p.purchase_type}'),
mbase AS (
  SELECT b.user_id, c.snapshot_date, anyone.day + 1 AS standard_date,
         CAST(anyone.day + 1 - own.day AS INTEGER) AS recency, b.month_freq, b.month_monetary
  FROM cal c
  JOIN (SELECT user_id, period_start, count(*) AS month_freq, sum(price) AS month_monetary
        FROM bought GROUP BY ALL) b USING (period_start)
  ASOF JOIN (SELECT DISTINCT user_id, day FROM bought) own ON own.user_id = b.user_id AND c.snapshot_date >= own.day
  ASOF JOIN (SELECT DISTINCT day FROM bought) anyone ON c.snapshot_date >= anyone.day)"""


def monthly_rfm_cte(p: Params = DEFAULT) -> str:
    n = p.tiles
    return f"""msc AS (
  SELECT user_id, snapshot_date, recency, month_freq, month_monetary,
    CAST(ntile({n}) OVER (PARTITION BY snapshot_date ORDER BY recency DESC, user_id) AS INTEGER) AS recency_score,
    CAST(ntile({n}) OVER (PARTITION BY snapshot_date ORDER BY month_freq ASC, user_id) AS INTEGER) AS frequency_score,
    CAST(ntile({n}) OVER (PARTITION BY snapshot_date ORDER BY month_monetary ASC, user_id) AS INTEGER) AS monetary_score
  FROM mbase),
mrfm AS (
  SELECT user_id, snapshot_date, {segment_case()} AS rfm_segment, recency, recency_score,
         month_freq, frequency_score, month_monetary, monetary_score
  FROM msc)"""


def monthly_ctes(src: str = EV_ORDERS, p: Params = DEFAULT) -> list[str]:
    return [src, cal(p.grain), monthly_base_cte(p), monthly_rfm_cte(p)]


def q_monthly_rfm_base() -> str:
    return with_(*monthly_ctes()[:3]) + f"""
SELECT user_id, snapshot_date, standard_date, recency, month_freq,
       {_r('month_monetary')} AS month_monetary FROM mbase"""


def q_monthly_rfm() -> str:
    return with_(*monthly_ctes()) + f"""
SELECT user_id, snapshot_date, rfm_segment, recency, recency_score, month_freq,
       frequency_score, {_r('month_monetary')} AS month_monetary, monetary_score FROM mrfm"""


def q_monthly_segment_stat() -> str:
    return with_(*monthly_ctes()) + f"""
SELECT snapshot_date, rfm_segment, {_r('avg(recency)')} AS avg_recency,
       {_r('avg(month_freq)')} AS avg_frequency,
       {_ratio('sum(month_monetary)', 'count(month_monetary)')} AS arpu,
       {_r('sum(month_monetary)')} AS total_monetary,
       {_ratio('sum(month_monetary)', 'sum(sum(month_monetary)) OVER (PARTITION BY snapshot_date)')} AS monetary_ratio
FROM mrfm GROUP BY snapshot_date, rfm_segment"""


def q_segment_transition_uplift() -> str:
    before, now = "old.month_monetary", "new.month_monetary"
    return with_(*monthly_ctes()) + f"""
SELECT new.snapshot_date AS snapshot_month, old.rfm_segment AS prev_segment, new.rfm_segment AS curr_segment,
       count(*) AS transition_cnt,
       {_r(f'sum({before})')} AS total_prev_amount, {_r(f'sum({now})')} AS total_curr_amount,
       {_r(f'sum({now} - {before})')} AS total_diff_amount,
       {_ratio(f'sum({now} - {before})', f'count({now} - {before})')} AS avg_diff_amount,
       {_r(f'avg(CAST({now} - {before} AS DOUBLE) / CAST({before} AS DOUBLE)) FILTER (WHERE {before} > 0)')}
         AS avg_uplift_pct
FROM mrfm new ASOF JOIN mrfm old ON new.user_id = old.user_id AND new.snapshot_date > old.snapshot_date
GROUP BY ALL"""


def q_segment_path() -> str:
    """One column per month of the stated calendar."""
    months = ",\n       ".join(
        f"any_value(rfm_segment) FILTER (WHERE strftime(snapshot_date, '%Y-%m') = '{m}') AS \"{m}\""
        for m in map(ORDERS_CALENDAR.label, ORDERS_CALENDAR.starts()))
    return with_(*monthly_ctes()) + f"""
SELECT user_id, {months}
FROM mrfm GROUP BY user_id"""


# ---------------------------------------------------------------------------
# A12, A13, A26 cohorts
# ---------------------------------------------------------------------------
def _age(later: str, earlier: str, grain: str) -> str:
    if grain == "month":
        return f"CAST(datediff('month', {earlier}, {later}) AS INTEGER)"
    return f"CAST(datediff('day', {earlier}, {later}) // 7 AS INTEGER)"


def activity_cte(p: Params = DEFAULT) -> str:
    """Every purchase with its period and its buyer's first period."""
    period = _pstart("event_time", p.grain)
    return f"""activity AS (
  SELECT user_id, price, {period} AS period, min({period}) OVER (PARTITION BY user_id) AS joined
  FROM ev WHERE event_type = '{p.purchase_type}')"""


def cohort_ctes(p: Params = DEFAULT) -> str:
    size = "(SELECT count(DISTINCT user_id) FROM activity m WHERE m.joined = a.joined)"
    return activity_cte(p) + f""",
cohort AS (
  SELECT a.joined AS cohort_date, {_age('a.period', 'a.joined', p.grain)} AS cohort_age, {size} AS first_user,
         count(DISTINCT a.user_id) AS active_users, sum(a.price) AS period_revenue, count(*) AS orders
  FROM activity a GROUP BY a.joined, a.period)"""


def q_cohort_retention() -> str:
    earlier = "FROM cohort e WHERE e.cohort_date = c.cohort_date AND e.cohort_age <= c.cohort_age"
    return with_(EV_ORDERS, cohort_ctes()) + f"""
SELECT cohort_date, cohort_age, first_user, active_users, {_ratio('active_users', 'first_user')} AS retention_rate,
       {_r('period_revenue')} AS period_revenue, {_ratio('period_revenue', 'first_user')} AS revenue_per_user,
       {_r(f'(SELECT sum(e.period_revenue) {earlier})')} AS cumulative_revenue,
       {_r(f'(SELECT sum(CAST(e.period_revenue AS DOUBLE) / e.first_user) {earlier})')} AS cumulative_revenue_per_user
FROM cohort c"""


def q_cohort_age_metrics() -> str:
    return with_(EV_ORDERS, cohort_ctes()) + f"""
SELECT cohort_date, cohort_age, {_ratio('orders', 'active_users')} AS avg_freq,
       {_ratio('period_revenue', 'active_users')} AS arpu, active_users
FROM cohort"""


def cohort_segment_cte(p: Params = DEFAULT) -> str:
    """Cohort activity by the segment that the buyer has at the period's snapshot."""
    return f"""csr AS (
  SELECT m.rfm_segment, a.joined AS cohort_date, a.period AS order_date,
         {_age('a.period', 'a.joined', p.grain)} AS cohort_age,
         count(DISTINCT a.user_id) AS active_number, sum(a.price) AS spent
  FROM activity a LEFT JOIN mrfm m
    ON m.user_id = a.user_id AND m.snapshot_date = {_pend('a.period', p.grain)}
  GROUP BY ALL)"""


def q_cohort_segment_retention() -> str:
    group = "OVER (PARTITION BY rfm_segment, cohort_date)"
    return with_(*monthly_ctes(), cohort_ctes(), cohort_segment_cte()) + f"""
SELECT rfm_segment, cohort_date, order_date, cohort_age, active_number,
       {_ratio('active_number', f'arg_min(active_number, cohort_age) {group}')} AS cnt_retention,
       {_ratio('spent', f'arg_min(spent, cohort_age) {group}')} AS revenue_retention
FROM csr"""


# ---------------------------------------------------------------------------
# A14-A17 churn (naive: as-of history per snapshot)
# ---------------------------------------------------------------------------
def churn_ctes(p: Params = DEFAULT) -> str:
    gap = "datediff('day', d.day, c.today)"
    return f"""days AS (
  SELECT user_id, CAST(event_time AS DATE) AS day, sum(price) AS spent
  FROM ev WHERE event_type = '{p.purchase_type}' GROUP BY ALL),
people AS (SELECT user_id, min(day) AS since FROM days GROUP BY user_id),
clock AS (
  SELECT period_start, snapshot_date,
         (SELECT max(CAST(event_time AS DATE)) + 1 FROM ev WHERE CAST(event_time AS DATE) <= snapshot_date) AS today
  FROM cal),
churn AS (
  SELECT p.user_id, c.snapshot_date,
         CASE WHEN p.since >= c.period_start THEN 'NEW' WHEN {gap} > {p.risk_days} THEN 'CHURNED'
              WHEN {gap} > {p.active_days} THEN 'AT_RISK' ELSE 'ACTIVE' END AS segment,
         coalesce((SELECT sum(s.spent) FROM days s WHERE s.user_id = p.user_id
                   AND s.day BETWEEN c.period_start AND c.snapshot_date), 0) AS ltv
  FROM clock c JOIN people p ON p.since <= c.snapshot_date
  ASOF JOIN days d ON d.user_id = p.user_id AND c.snapshot_date >= d.day)"""


MOVES = """trans AS (
  SELECT new.snapshot_date, old.segment AS prev_segment, new.segment AS curr_segment, count(*) AS move_users,
         sum(new.ltv) AS curr_total_ltv, sum(old.ltv) AS prev_total_ltv,
         CAST(sum(count(*)) OVER (PARTITION BY new.snapshot_date, old.segment) AS BIGINT) AS prev_total_users
  FROM churn new ASOF JOIN churn old ON new.user_id = old.user_id AND new.snapshot_date > old.snapshot_date
  GROUP BY new.snapshot_date, old.segment, new.segment)"""


def churn_all(src: str = EV_ORDERS, p: Params = DEFAULT) -> list[str]:
    return [src, cal(p.grain), churn_ctes(p)]


def q_churn_status() -> str:
    return with_(*churn_all()) + f"""
SELECT user_id, snapshot_date, segment, {_r('ltv')} AS ltv FROM churn"""


def q_churn_stats() -> str:
    return with_(*churn_all()) + f"""
SELECT snapshot_date, segment, count(DISTINCT user_id) AS cnt, {_r('sum(ltv)')} AS total_ltv
FROM churn GROUP BY snapshot_date, segment"""


def q_churn_transition() -> str:
    # percent to two places, half up, in integers
    return with_(*churn_all(), MOVES) + f"""
SELECT snapshot_date, prev_segment, curr_segment, move_users, prev_total_users,
       CAST((move_users * 20000 + prev_total_users) // (2 * prev_total_users) AS DOUBLE) / 100 AS transition_rate_pct,
       {_r('curr_total_ltv')} AS curr_total_ltv, {_r('prev_total_ltv')} AS prev_total_ltv
FROM trans"""


def q_churn_loss_estimate(dedup: bool = False) -> str:
    """``dedup``: the users of a snapshot divide once, not once for each status that fed the churn."""
    at = "(SELECT snapshot_date FROM cal ORDER BY snapshot_date DESC LIMIT 1 OFFSET {})".format
    gone = f"(SELECT user_id FROM churn WHERE snapshot_date = {at(0)} AND segment = 'CHURNED')"

    def share(k: int) -> str:
        users = f"(SELECT count(*) FROM churn WHERE snapshot_date = {at(k)})"
        times = "1" if dedup else "count(*)"
        return (f"(SELECT CAST(sum(move_users) AS DOUBLE) / ({times} * {users}) FROM trans "
                f"WHERE snapshot_date = {at(k)} AND curr_segment = 'CHURNED' AND prev_segment <> 'CHURNED')")
    return with_(*churn_all(), MOVES).rstrip() + f""",
figures AS (
  SELECT (SELECT count(*) FROM {gone}) AS churn_total_cnt,
         (SELECT sum(ltv) FROM churn WHERE user_id IN {gone}) AS churn_ago_total_ltv,
         (SELECT count(*) FROM churn WHERE snapshot_date = {at(0)} AND segment = 'ACTIVE') AS last_active_cnt,
         (SELECT CAST(sum(ltv) AS DOUBLE) / count(*) FROM churn WHERE snapshot_date = {at(0)}) AS last_arpu,
         {share(2)} AS ratio_prev2, {share(1)} AS ratio_prev1, {share(0)} AS ratio_last)
SELECT churn_total_cnt, {_r('churn_ago_total_ltv')} AS churn_ago_total_ltv, last_active_cnt,
       {_r('ratio_prev2')} AS ratio_prev2, {_r('ratio_prev1')} AS ratio_prev1, {_r('ratio_last')} AS ratio_last,
       {_r('last_arpu')} AS last_arpu,
       {_r('last_active_cnt * (((0.0 + ratio_prev2) + ratio_prev1) + ratio_last) / 3 * last_arpu')} AS lose_ltv
FROM figures"""


# ---------------------------------------------------------------------------
# A7, A8, A19 categories (line items as categorised purchases)
# ---------------------------------------------------------------------------
CAT_DIM = """dim AS (
  SELECT c.snapshot_date, e.category_id, last(e.category_code ORDER BY e.event_time, e.category_code) AS category_code
  FROM cal c JOIN cev e ON CAST(e.event_time AS DATE) <= c.snapshot_date
  WHERE e.event_type = 'purchase' AND e.category_code IS NOT NULL
  GROUP BY c.snapshot_date, e.category_id)"""

MONEY_SHARE = "sum(money) OVER (PARTITION BY snapshot_date)"


def q_category_dim_asof() -> str:
    return with_(EV_ORDERS, cal("month"), EV_LINES, CAT_DIM) + """
SELECT snapshot_date, category_id, category_code FROM dim"""


def _category_kpis(rows: str, frequency: str, money: str) -> str:
    return f"""kpi AS (
  SELECT snapshot_date, category_id, rfm_segment, avg(recency) AS avg_recency,
         CAST(sum({frequency}) AS BIGINT) AS sum_frequency, sum({money}) AS money
  FROM ({rows}) GROUP BY ALL)"""


def _category_result() -> str:
    return f"""
SELECT snapshot_date, category_id, category_code, rfm_segment, {_r('avg_recency')} AS avg_recency, sum_frequency,
       {_r('money')} AS sum_monetary, {_ratio('money', MONEY_SHARE)} AS monetary_ratio
FROM kpi LEFT JOIN dim USING (snapshot_date, category_id)"""


def q_monthly_rfm_category() -> str:
    """A snapshot's figures of a user count for every category bought by then."""
    rows = """
    SELECT c.snapshot_date, b.category_id, m.rfm_segment, m.recency, m.month_freq, m.month_monetary
    FROM cal c
    JOIN (SELECT user_id, category_id, min(CAST(event_time AS DATE)) AS since
          FROM cev WHERE event_type = 'purchase' GROUP BY ALL) b ON b.since <= c.snapshot_date
    LEFT JOIN mrfm m ON m.user_id = b.user_id AND m.snapshot_date = c.snapshot_date"""
    return with_(*monthly_ctes(), EV_LINES, CAT_DIM,
                 _category_kpis(rows, "month_freq", "month_monetary")) + _category_result()


def q_monthly_rfm_category_attributed() -> str:
    """Only the period's own purchases count, for their own category."""
    rows = """
    SELECT m.snapshot_date, b.category_id, m.rfm_segment, m.recency, b.n, b.paid
    FROM mrfm m
    JOIN (SELECT user_id, CAST(last_day(event_time) AS DATE) AS month_end, category_id, count(*) AS n,
                 sum(price) AS paid
          FROM cev WHERE event_type = 'purchase' GROUP BY ALL) b
      ON b.user_id = m.user_id AND b.month_end = m.snapshot_date"""
    return with_(*monthly_ctes(), EV_LINES, CAT_DIM, _category_kpis(rows, "n", "paid")) + _category_result()


def q_last_purchase_category(purchases_only: bool = False) -> str:
    only = "AND event_type = 'purchase'" if purchases_only else ""
    return with_(*churn_all(), EV_LINES) + f"""
SELECT status.segment, e.category_id, e.category_code, count(*) AS last_purchase_cnt
FROM (SELECT * FROM cev
      QUALIFY event_time = max(event_time) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id)
        {only}) e
JOIN (SELECT user_id, arg_max(segment, snapshot_date) AS segment FROM churn GROUP BY user_id) status USING (user_id)
GROUP BY ALL"""


# ---------------------------------------------------------------------------
# A18, A20, A23, A25 behaviour on the click log (weekly snapshots)
# ---------------------------------------------------------------------------
W = WEEKLY_EVENTS


def _activity_ctes() -> list[str]:
    """Events of a user's days, for each snapshot and length of the window that ends before it."""
    lengths = ", ".join(f"({n})" for n in W.trailing_days)
    return [*churn_all(EV_CLICKS, W),
            "daily AS (SELECT user_id, CAST(event_time AS DATE) AS day, event_type, count(*) AS k FROM ev GROUP BY ALL)",
            f"""act AS (
  SELECT status.snapshot_date, status.segment, daily.event_type, w.n || ' day' AS "interval", CAST(sum(daily.k) AS BIGINT) AS event_cnt
  FROM (VALUES {lengths}) w(n), churn status JOIN daily USING (user_id)
  WHERE status.snapshot_date - daily.day BETWEEN 1 AND w.n
  GROUP BY ALL)"""]


def q_pre_snapshot_activity() -> str:
    return with_(*_activity_ctes()) + """
SELECT snapshot_date, segment, event_type, "interval", event_cnt FROM act"""


def q_pre_snapshot_activity_by_type() -> str:
    return with_(*_activity_ctes()) + """
SELECT event_type, "interval", CAST(sum(event_cnt) AS BIGINT) AS cnt
FROM act GROUP BY event_type, "interval"
"""


def q_churn_event_funnel() -> str:
    return with_(*churn_all(EV_CLICKS, W)) + f"""
SELECT c.snapshot_date, c.segment, e.event_type, count(*) AS total_count
FROM churn c JOIN ev e ON c.user_id = e.user_id
 AND {_pstart('c.snapshot_date', W.grain)} = {_pstart('e.event_time', W.grain)}
GROUP BY c.snapshot_date, c.segment, e.event_type"""


def q_next_period_behaviour() -> str:
    bought = f"event_type = '{W.purchase_type}'"
    first = f"min(event_time) FILTER (WHERE {bought}) OVER (PARTITION BY user_id)"
    return with_(EV_CLICKS) + f"""
SELECT user_id, joined AS first_date, count(DISTINCT category_id) AS category_cnt,
       count(*) FILTER (WHERE event_type = '{W.view_type}') AS view_cnt,
       count(*) FILTER (WHERE event_type = '{W.cart_type}') AS cart_cnt, CAST(bool_or({bought}) AS INTEGER) AS tf_purchase
FROM (SELECT *, {_pstart(first, W.grain)} AS joined FROM ev)
WHERE {_pstart('event_time', W.grain)} = CAST(joined + {_step(W.grain)} AS DATE)
GROUP BY ALL"""


LASTCAL = """lastcal AS (SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date DESC) AS k FROM cal)"""


def q_high_segment_behaviour() -> str:
    """A count of each kind of event in the snapshot's period, as a subquery of its own."""
    def events(kind: str) -> str:
        return f"""(SELECT count(*) FROM ev WHERE ev.user_id = high.user_id AND ev.event_type = '{kind}'
          AND {_pstart('ev.event_time', W.grain)} = {_pstart('high.snapshot_date', W.grain)})"""
    later = "(SELECT count(*) FROM cal WHERE cal.snapshot_date > high.snapshot_date)"
    return with_(*monthly_ctes(EV_CLICKS, W)) + f"""
SELECT if({later} < {W.current_n}, 'current', 'past') AS point_of_view, high.user_id, high.snapshot_date,
       {events(W.view_type)} AS view_cnt, {events(W.cart_type)} AS cart_cnt, {events(W.purchase_type)} AS purchase_cnt
FROM mrfm high WHERE high.rfm_segment IN ('VIP', 'GROWTH', 'LOYAL')"""


# ---------------------------------------------------------------------------
# A21, A22, A24 comparisons (orders, monthly)
# ---------------------------------------------------------------------------
def high_segment_rm_plain() -> str:
    """The comparison table before rounding."""
    return with_(*monthly_ctes()) + f"""
SELECT CASE WHEN snapshot_date IN (SELECT snapshot_date FROM cal ORDER BY snapshot_date DESC LIMIT {DEFAULT.current_n})
            THEN 'current' ELSE 'past' END AS point_of_view, user_id, avg(recency) AS avg_recency,
       CAST(sum(month_monetary) AS DOUBLE) / count(month_monetary) AS avg_monetary
FROM mrfm WHERE rfm_segment IN ('VIP', 'GROWTH', 'LOYAL') GROUP BY ALL"""


def q_high_segment_rm() -> str:
    return with_(*monthly_ctes(), LASTCAL) + f"""
SELECT CASE WHEN l.k <= {DEFAULT.current_n} THEN 'current' ELSE 'past' END AS point_of_view, m.user_id,
       {_r('avg(m.recency)')} AS avg_recency,
       {_ratio('sum(m.month_monetary)', 'count(m.month_monetary)')} AS avg_monetary
FROM mrfm m JOIN lastcal l ON m.snapshot_date = l.snapshot_date
WHERE m.rfm_segment IN ('VIP', 'GROWTH', 'LOYAL')
GROUP BY 1, 2"""


def cohort_compare_ctes() -> list[str]:
    """Mean size and mean age-1 actives of the cohorts before and inside the current window."""
    inside = f"months_back BETWEEN {DEFAULT.skip_latest_cohorts} AND {DEFAULT.skip_latest_cohorts + DEFAULT.current_n - 1}"
    older = f"months_back >= {DEFAULT.skip_latest_cohorts + DEFAULT.current_n}"
    return [EV_ORDERS, cohort_ctes(), f"""placed AS (
  SELECT first_user, active_users,
         datediff('month', cohort_date, (SELECT max(cohort_date) FROM cohort)) AS months_back
  FROM cohort WHERE cohort_age = 1),
cmp AS (
  SELECT label AS point_of_view, avg(first_user) AS first_user, avg(active_users) AS active_user
  FROM (VALUES ('past'), ('current')) v(label)
  LEFT JOIN placed ON CASE label WHEN 'past' THEN {older} ELSE {inside} END
  GROUP BY label)"""]


def q_cohort_period_compare() -> str:
    return with_(*cohort_compare_ctes()) + f"""
SELECT point_of_view, {_r('first_user')} AS first_user, {_r('active_user')} AS active_user FROM cmp"""


def q_chi2_rate_residuals() -> str:
    return with_(*cohort_compare_ctes(), """ct AS (
  SELECT point_of_view AS "group", CAST(trunc(active_user) AS BIGINT) AS success,
         CAST(trunc(first_user - active_user) AS BIGINT) AS failure
  FROM cmp WHERE first_user IS NOT NULL AND active_user IS NOT NULL AND active_user <= first_user)""",
                 """ex AS (
  SELECT "group", success, failure,
         CAST(success + failure AS DOUBLE) * sum(success) OVER () / (sum(success) OVER () + sum(failure) OVER ()) AS e1,
         CAST(success + failure AS DOUBLE) * sum(failure) OVER () / (sum(success) OVER () + sum(failure) OVER ()) AS e2
  FROM ct)""") + f"""
SELECT "group", success, failure, {_r('e1')} AS expected_success, {_r('e2')} AS expected_failure,
       {_r('(success - e1) / sqrt(e1)')} AS resid_success, {_r('(failure - e2) / sqrt(e2)')} AS resid_failure
FROM ex"""


def q_chi2_rate_test() -> str:
    """Upper chi-square tail as 1 - P(dof/2, chi2/2), P by its power series
    (an independent method from the engine's continued fraction)."""
    return with_(*cohort_compare_ctes(), """ct AS (
  SELECT point_of_view AS "group", CAST(trunc(active_user) AS BIGINT) AS success,
         CAST(trunc(first_user - active_user) AS BIGINT) AS failure
  FROM cmp WHERE first_user IS NOT NULL AND active_user IS NOT NULL AND active_user <= first_user)""",
                 """ex AS (
  SELECT success, failure,
         CAST(success + failure AS DOUBLE) * sum(success) OVER () / (sum(success) OVER () + sum(failure) OVER ()) AS e1,
         CAST(success + failure AS DOUBLE) * sum(failure) OVER () / (sum(success) OVER () + sum(failure) OVER ()) AS e2
  FROM ct)""", """agg AS (
  SELECT sum(power(success - e1, 2) / e1 + power(failure - e2, 2) / e2) AS chi2,
         count(*) AS nrows, sum(success + failure) AS n FROM ex)""", """pv AS (
  SELECT g.chi2, g.n, g.nrows - 1 AS dof,
         CASE WHEN g.chi2 <= 0 THEN 1.0 ELSE
           1 - exp(((g.nrows - 1) / 2.0) * ln(g.chi2 / 2) - g.chi2 / 2 - lgamma((g.nrows - 1) / 2.0 + 1))
             * (SELECT sum(exp(k * ln(g.chi2 / 2) - (lgamma((g.nrows - 1) / 2.0 + k + 1)
                                                     - lgamma((g.nrows - 1) / 2.0 + 1))))
                FROM range(0, 3000) t(k))
         END AS p_value
  FROM agg g)""") + f"""
SELECT 'chi_square' AS test, {_r('chi2')} AS chi2, {_r('p_value')} AS p_value, CAST(dof AS BIGINT) AS dof,
       CASE WHEN least(dof, 1) > 0 THEN {_r('sqrt(chi2 / n / least(dof, 1))')} END AS cramers_v,
       CAST(n AS BIGINT) AS n
FROM pv"""


def q_paired_periods() -> str:
    return with_(*monthly_ctes(), LASTCAL, f"""rm AS (
  SELECT CASE WHEN l.k <= {DEFAULT.current_n} THEN 'current' ELSE 'past' END AS point_of_view, m.user_id,
         avg(m.recency) AS avg_recency
  FROM mrfm m JOIN lastcal l ON m.snapshot_date = l.snapshot_date
  WHERE m.rfm_segment IN ('VIP', 'GROWTH', 'LOYAL') GROUP BY 1, 2)""") + f"""
SELECT user_id, {_r("avg(CASE WHEN point_of_view = 'past' THEN avg_recency END)")} AS before_value,
       {_r("avg(CASE WHEN point_of_view = 'current' THEN avg_recency END)")} AS after_value
FROM rm GROUP BY user_id
HAVING avg(CASE WHEN point_of_view = 'past' THEN avg_recency END) IS NOT NULL
   AND avg(CASE WHEN point_of_view = 'current' THEN avg_recency END) IS NOT NULL"""


def segment_retention_cte(p: Params = DEFAULT) -> str:
    low, high = p.skip_latest_cohorts, p.skip_latest_cohorts + p.current_n - 1
    return f"""segret AS (
  SELECT rfm_segment, cohort_date AS curr_period,
         CAST(sum(active_number) FILTER (WHERE cohort_age = 1) AS BIGINT) AS action_number,
         CAST(sum(active_number) FILTER (WHERE cohort_age = 0) AS BIGINT) - action_number AS non_action_number
  FROM csr
  WHERE rfm_segment IS NOT NULL
    AND datediff('month', cohort_date, (SELECT max(cohort_date) FROM csr)) BETWEEN {low} AND {high}
  GROUP BY rfm_segment, cohort_date)"""


def _retention_ctes(p: Params) -> list[str]:
    return [*monthly_ctes(), cohort_ctes(), cohort_segment_cte(), segment_retention_cte(p)]


def q_segment_initial_retention() -> str:
    return with_(*_retention_ctes(DEFAULT)) + """
SELECT rfm_segment, curr_period, action_number, non_action_number FROM segret"""


# ---------------------------------------------------------------------------
# T2-T5, T7-T9 statistics
# ---------------------------------------------------------------------------
def _beta_sql(a: str, b: str, x: str) -> str:
    """Regularized incomplete beta by its power series, on the side where it converges fast."""
    def series(a, b, x):
        return (f"exp({a} * ln({x}) + {b} * ln(1 - ({x})) + lgamma({a} + {b}) - lgamma({a} + 1) - lgamma({b})) * "
                f"(SELECT sum(exp(lgamma({a} + {b} + k) - lgamma({a} + {b}) - lgamma({a} + 1 + k) + lgamma({a} + 1)"
                f" + k * ln({x}))) FROM range(0, 4000) series(k))")
    return (f"CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} >= 1 THEN 1.0 WHEN {x} <= 0.5 THEN {series(a, b, x)} "
            f"ELSE 1 - {series(b, a, f'(1 - ({x}))')} END")


def _f_tail(f: str, d1: str, d2: str) -> str:
    return _beta_sql(f"({d2} / 2.0)", f"({d1} / 2.0)", f"({d2} / ({d2} + {d1} * {f}))")


def _t_tail(t: str, free: str) -> str:
    return _beta_sql(f"({free} / 2.0)", "0.5", f"({free} / ({free} + {t} * {t}))")


def _normal_tail(z: str) -> str:
    """Both tails of the normal: 1 - P(1/2, z^2 / 2) by the power series of P."""
    x = f"({z} * {z} / 2)"
    return (f"CASE WHEN {z} = 0 THEN 1.0 ELSE 1 - exp(0.5 * ln({x}) - {x} - lgamma(1.5)) * "
            f"(SELECT sum(exp(k * ln({x}) - lgamma(1.5 + k) + lgamma(1.5))) FROM range(0, 2000) series(k)) END")


def _rates_ctes() -> list[str]:
    return [*_retention_ctes(RETENTION_TESTS), """rates AS (
  SELECT rfm_segment AS seg, CASE WHEN action_number + non_action_number <> 0
           THEN CAST(action_number AS DOUBLE) / (action_number + non_action_number) END AS rate FROM segret)""", """groups AS (
  SELECT seg, count(*) AS n_rows, count(rate) AS n, avg(rate) AS mean FROM rates GROUP BY seg)""", """whole AS (
  SELECT (SELECT count(*) FROM rates) AS n_obs, (SELECT count(rate) FROM rates) AS used,
         (SELECT count(*) FROM groups WHERE n > 0) AS k,
         (SELECT sum(n * power(mean - (SELECT avg(rate) FROM rates), 2)) FROM groups) AS ssb,
         (SELECT sum(power(rate - mean, 2)) FROM rates JOIN groups USING (seg)) AS ssw)"""]


def q_anova_initial_retention() -> str:
    return with_(*_rates_ctes(), """a AS (
  SELECT *, CAST(k - 1 AS DOUBLE) AS d1, CAST(used - k AS DOUBLE) AS d2, (ssb / d1) / (ssw / d2) AS f FROM whole)""",
                 f"b AS (SELECT *, {_f_tail('f', 'd1', 'd2')} AS p FROM a)") + f"""
SELECT 'Initial Retention ANOVA' AS test_name, {_r('f')} AS F, {_r('p')} AS p_value,
       {_r('ssb / (ssb + ssw)')} AS eta_squared, p < 0.05 AS significant, n_obs, k AS n_groups,
       {_r('ssb')} AS ss_between, {_r('ssw')} AS ss_within, d1 AS df_between, d2 AS df_within FROM b"""


def q_pairwise_mean_diff() -> str:
    return with_(*_rates_ctes(), """pairs AS (
  SELECT a.seg AS group1, b.seg AS group2, b.mean - a.mean AS diff, ssw / (used - k) AS mse,
         1.0 / a.n + 1.0 / b.n AS inv, CAST(k - 1 AS DOUBLE) AS d1, CAST(used - k AS DOUBLE) AS d2
  FROM groups a JOIN groups b ON a.seg < b.seg, whole WHERE a.n > 0 AND b.n > 0)""",
                 "q AS (SELECT *, sqrt(mse / 2 * inv) AS se, diff * diff / (mse * inv * d1) AS f FROM pairs)",
                 f"p AS (SELECT *, {_f_tail('f', 'd1', 'd2')} AS pv FROM q)") + f"""
SELECT group1, group2, {_r('diff')} AS meandiff, {_r('se')} AS se,
       {_r('abs(diff) / se')} AS q_stat, {_r('pv')} AS p_adj, pv < 0.05 AS reject FROM p"""


def q_spearman_cohort_age() -> str:
    m = SPEARMAN_MIN_USERS
    return with_(EV_ORDERS, cohort_ctes(), f"""cells AS (
  SELECT cohort_age, CAST(orders AS DOUBLE) / active_users AS avg_freq,
         CAST(period_revenue AS DOUBLE) / active_users AS arpu
  FROM cohort WHERE cohort_age BETWEEN 1 AND 4 AND active_users >= {m})""", """places AS (
  SELECT metric, rank() OVER (PARTITION BY metric ORDER BY cohort_age)
           + (count(*) OVER (PARTITION BY metric, cohort_age) - 1) / 2.0 AS rx,
         rank() OVER (PARTITION BY metric ORDER BY v) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2.0 AS ry
  FROM (SELECT cohort_age, 'avg_freq' AS metric, avg_freq AS v FROM cells
        UNION ALL SELECT cohort_age, 'arpu', arpu FROM cells))""", """rho AS (
  SELECT metric, corr(rx, ry) AS rho, count(rx) AS n, CAST(count(rx) - 2 AS DOUBLE) AS free,
         rho * sqrt(free / (1 - rho * rho)) AS t
  FROM (VALUES ('avg_freq'), ('arpu')) v(metric) LEFT JOIN places USING (metric) GROUP BY metric)""",
                 f"p AS (SELECT *, {_t_tail('t', 'free')} AS pv FROM rho)") + f"""
SELECT metric, {_r('rho')} AS spearman_rho, {_r('pv')} AS p_value, n, pv < 0.05 AS significant FROM p"""


def q_wilcoxon_battery() -> str:
    behaviour = q_high_segment_behaviour()
    return f"""
WITH changes AS (
  SELECT "table", metric, user_id, avg(v) FILTER (WHERE point_of_view = 'current')
           - avg(v) FILTER (WHERE point_of_view = 'past') AS d
  FROM (SELECT 'high_segment_rm' AS "table", unnest(['avg_recency', 'avg_monetary']) AS metric, user_id, point_of_view,
               unnest([avg_recency, avg_monetary]) AS v FROM ({high_segment_rm_plain()})
        UNION ALL
        SELECT 'high_segment_behaviour', unnest(['view_cnt', 'cart_cnt', 'purchase_cnt']), user_id, point_of_view,
               unnest([view_cnt, cart_cnt, purchase_cnt]) FROM ({behaviour}))
  GROUP BY ALL HAVING d IS NOT NULL),
ranked AS (
  SELECT *, rank() OVER (PARTITION BY "table", metric ORDER BY abs(d))
         + (count(*) OVER (PARTITION BY "table", metric, abs(d)) - 1) / 2.0 AS r,
         count(*) OVER (PARTITION BY "table", metric, abs(d)) AS tied
  FROM changes WHERE d <> 0),
sums AS (
  SELECT "table", metric, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS wp, coalesce(sum(r) FILTER (WHERE d < 0), 0) AS wm,
         count(*) AS m, sum(tied * tied - 1) AS ties FROM ranked GROUP BY ALL),
alls AS (SELECT "table", metric, count(*) AS n, median(d) AS med, avg(d) AS mean FROM changes GROUP BY ALL),
z AS (
  SELECT *, least(wp, wm) AS stat,
         (least(wp, wm) - m * (m + 1) / 4.0) / sqrt(m * (m + 1) * (2 * m + 1) / 24.0 - ties / 48.0) AS z
  FROM alls LEFT JOIN sums USING ("table", metric))
SELECT "table", metric, 'wilcoxon_signed_rank' AS test, {_r('stat')} AS stat, {_r(_normal_tail('z'))} AS p_value, n,
       {_r('med')} AS median_diff, {_r('mean')} AS mean_diff, {_r('1 - 2 * stat / (n * (n + 1))')} AS rank_biserial,
       {_r('(wp - wm) / (m * (m + 1) / 2.0)')} AS rank_biserial_std
FROM z"""


LOGIT_TERMS = ["category_cnt", "view_cnt", "cart_cnt"]


def _eliminate(name: str, n: int, keep: str) -> list[str]:
    """Gauss-Jordan elimination of the n x 2n matrix m of table {name}0, one table a step."""
    out = []
    for k in range(1, n + 1):
        cells = ", ".join("[" + ", ".join(
            f"m[{k}][{j}] / m[{k}][{k}]" if i == k else f"m[{i}][{j}] - m[{i}][{k}] * m[{k}][{j}] / m[{k}][{k}]"
            for j in range(1, 2 * n + 1)) + "]" for i in range(1, n + 1))
        out.append(f"{name}{k} AS MATERIALIZED (SELECT {keep}, [{cells}] AS m FROM {name}{k - 1})")
    return out


def _logit_ctes(steps: int = 12) -> list[str]:
    """Newton's method from zero: ``steps`` solves of the information matrix, each a
    Gauss-Jordan elimination of [matrix | identity] held as a list of rows."""
    n = len(LOGIT_TERMS) + 1
    size = range(1, n + 1)
    out = [f"""data AS MATERIALIZED (
  SELECT CAST([1, {', '.join(LOGIT_TERMS)}] AS DOUBLE[]) AS x, CAST(tf_purchase AS DOUBLE) AS y
  FROM ({q_next_period_behaviour()}))""", f"b0 AS (SELECT CAST([{', '.join('0' for _ in size)}] AS DOUBLE[]) AS b)"]
    for s in range(1, steps + 1):
        rows = ", ".join("[" + ", ".join([f"sum(w * x[{i}] * x[{j}])" for j in size]
                                         + [f"{float(i == j)}" for j in size]) + "]" for i in size)
        out.append(f"""m{s}_0 AS MATERIALIZED (
  SELECT any_value(b) AS b, [{', '.join(f'sum((y - p) * x[{i}])' for i in size)}] AS g, [{rows}] AS m
  FROM (SELECT *, p * (1 - p) AS w
        FROM (SELECT b, x, y, 1 / (1 + exp(-list_dot_product(x, b))) AS p FROM data, b{s - 1})))""")
        out += _eliminate(f"m{s}_", n, "b, g")
        step = ", ".join(f"b[{i}] + " + " + ".join(f"m[{i}][{n + j}] * g[{j}]" for j in size) for i in size)
        out.append(f"b{s} AS MATERIALIZED (SELECT [{step}] AS b, m FROM m{s}_{n})")
    terms = ", ".join(f"('{t}', {i})" for i, t in enumerate(["Intercept", *LOGIT_TERMS], 1))
    out.append(f"""fit AS (
  SELECT term, b[i] AS coef, sqrt(m[i][{n} + i]) AS se FROM b{steps}, (VALUES {terms}) v(term, i)),
whole AS (
  SELECT count(*) AS n, sum(y * ln(p) + (1 - y) * ln(1 - p)) AS llf,
         sum(y) * ln(avg(y)) + (count(*) - sum(y)) * ln(1 - avg(y)) AS llnull
  FROM (SELECT y, 1 / (1 + exp(-list_dot_product(x, b))) AS p FROM data, b{steps})),
logit AS (
  SELECT term, coef, se, {_normal_tail('(coef / se)')} AS p_value, n, 1 - llf / llnull AS pseudo_r2, llf,
         -2 * llf + {2 * n} AS aic FROM fit, whole)""")
    return out


def q_logit_next_period(alpha: float | None = None) -> str:
    only = "" if alpha is None else f" WHERE p_value < {alpha}"
    return with_(*_logit_ctes()) + f"""
SELECT term, {_r('coef')} AS coef, {_r('se')} AS std_err, {_r('exp(coef)')} AS odds_ratio, {_r('p_value')} AS p_value,
       {_r('exp(coef - 1.959963984540054 * se)')} AS ci_low_or, {_r('exp(coef + 1.959963984540054 * se)')} AS ci_high_or,
       n, {_r('pseudo_r2')} AS pseudo_r2, {_r('llf')} AS llf, {_r('aic')} AS aic
FROM logit{only}"""


def q_test_summary() -> str:
    def part(test: str, name: str, n: str, statistic: str, effect: str, sql: str) -> str:
        return (f"SELECT '{test}' AS test, {name} AS name, CAST({n} AS BIGINT) AS n, CAST({statistic} AS DOUBLE) AS statistic, "
                f"p_value, CAST({effect} AS DOUBLE) AS effect_size FROM ({sql})")
    parts = "\nUNION ALL ".join([
        part("chi_square", "'retention by period'", "n", "chi2", "cramers_v", q_chi2_rate_test()),
        part("anova", "test_name", "n_obs", "F", "eta_squared", q_anova_initial_retention()),
        part("logit", "term", "n", "coef", "odds_ratio", q_logit_next_period()),
        part("spearman", "metric", "n", "spearman_rho", "spearman_rho", q_spearman_cohort_age()),
        part("wilcoxon", "\"table\" || '.' || metric", "n", "stat", "rank_biserial", q_wilcoxon_battery())])
    return f"SELECT *, p_value < 0.05 AS significant FROM ({parts})"


def _zero_scores(terms: list[str]) -> str:
    return "\nUNION ALL ".join(f"SELECT '{t}' AS term, 0.0 AS score" for t in terms)


def q_logit_score_equations() -> str:
    """At the maximum of the likelihood every term's score is zero."""
    return _zero_scores(["Intercept", "category_cnt", "view_cnt", "cart_cnt"])


def q_segment_age_regression() -> str:
    """Least squares on the columns less their cohort means; a cohort costs a degree of freedom."""
    labels = ["CHURN_EXPECTED", "GROWTH", "HIGH_CHURN_RISK", "LOYAL", "NEW", "REGULAR", "VIP"]   # sorted, all present
    columns = {"cohort_age": "cohort_age"}
    for label in labels[1:]:
        columns[f"rfm_segment[T.{label}]"] = f"CAST(rfm_segment = '{label}' AS INT)"
        columns[f"cohort_age:rfm_segment[T.{label}]"] = f"cohort_age * CAST(rfm_segment = '{label}' AS INT)"
    n, size = len(columns), range(1, len(columns) + 1)
    rows = ", ".join("[" + ", ".join([f"sum(x[{i}] * x[{j}])" for j in size] + [f"{float(i == j)}" for j in size]) + "]"
                     for i in size)
    terms = ", ".join(f"('{t}', {i})" for i, t in enumerate(columns, 1))
    return with_(*monthly_ctes(), cohort_ctes(), cohort_segment_cte(), """kept AS (
  SELECT rfm_segment, cohort_date, cohort_age, CAST(active_number AS DOUBLE)
           / arg_min(active_number, cohort_age) OVER (PARTITION BY rfm_segment, cohort_date) AS y FROM csr)""",
                 f"""xy AS MATERIALIZED (
  SELECT cohort_date, [{', '.join(f'{c} - avg({c}) OVER same' for c in columns.values())}] AS x, y - avg(y) OVER same AS y
  FROM kept WHERE rfm_segment IS NOT NULL WINDOW same AS (PARTITION BY cohort_date))""",
                 f"m0 AS MATERIALIZED (SELECT [{', '.join(f'sum(x[{i}] * y)' for i in size)}] AS g, [{rows}] AS m FROM xy)",
                 *_eliminate("m", n, "g"), f"""solved AS MATERIALIZED (
  SELECT m, [{', '.join(' + '.join(f'm[{i}][{n + j}] * g[{j}]' for j in size) for i in size)}] AS b FROM m{n}),
error AS (
  SELECT sum(power(y - list_dot_product(x, b), 2)) AS rss, count(*) AS n,
         CAST(count(*) - {n} - count(DISTINCT cohort_date) AS DOUBLE) AS free FROM xy, solved),
rows AS (
  SELECT term, b[i] AS coef, sqrt(m[i][{n} + i] * rss / free) AS se, coef / se AS t, free, n
  FROM solved, error, (VALUES {terms}) v(term, i))""") + f"""
SELECT term, {_r('coef')} AS coef, {_r('se')} AS std_err, {_r('t')} AS t_value, {_r(_t_tail('t', 'free'))} AS p_value,
       n AS n_obs, '{labels[0]}' AS reference FROM rows"""


def q_segment_age_normal_equations() -> str:
    """The residuals are orthogonal to every column of the regression; the terms follow
    from the segments present."""
    return with_(*monthly_ctes(), cohort_ctes(), cohort_segment_cte(), """labels AS (
  SELECT DISTINCT rfm_segment AS s FROM csr WHERE rfm_segment IS NOT NULL)""") + """
SELECT 'cohort_age' AS term, 0.0 AS score
UNION ALL SELECT unnest(['rfm_segment[T.' || s || ']', 'cohort_age:rfm_segment[T.' || s || ']']), 0.0
FROM labels WHERE s <> (SELECT min(s) FROM labels)"""


def q_log_round_trip() -> str:
    return with_(EV_CLICKS) + """
SELECT strftime(event_time, '%Y-%m') AS event_month, event_type, count(*) AS n, count(DISTINCT user_id) AS users,
       CAST(sum(CAST(category_id AS BIGINT)) AS BIGINT) AS category_sum, CAST(sum(price) AS DOUBLE) AS price_sum
FROM ev GROUP BY ALL"""


def q_mart_round_trip() -> str:
    return with_(*monthly_ctes()) + """
SELECT user_id, snapshot_date, rfm_segment, CAST(month_monetary AS DOUBLE) AS month_monetary
FROM mrfm WHERE rfm_segment <> 'REGULAR'"""


def _grain_ctes() -> list[str]:
    """Each purchase as raw rows, once per grain (months in a period: 1, 3, 12)."""
    return [EV_ORDERS, """buys AS (
  SELECT g.grain, g.months, user_id, CAST(date_trunc(g.grain, event_time) AS DATE) AS period_start
  FROM ev, (VALUES ('month', 1), ('quarter', 3), ('year', 12)) g(grain, months) WHERE event_type = 'purchase')"""]


def q_active_users_by_grain() -> str:
    return with_(*_grain_ctes()) + """
SELECT grain, period_start, count(DISTINCT user_id) AS active_users FROM buys GROUP BY ALL"""


def q_cohort_retention_by_grain() -> str:
    return with_(*_grain_ctes()) + f"""
SELECT grain, cohort_date, cohort_age, first_user, active_users, {_ratio('active_users', 'first_user')} AS retention_rate
FROM (SELECT grain, cohort_date, CAST(date_diff('month', cohort_date, period_start) // months AS INTEGER) AS cohort_age,
             max(size) AS first_user, count(DISTINCT user_id) AS active_users
      FROM (SELECT grain, months, user_id, min(period_start) AS cohort_date FROM buys GROUP BY ALL)
      JOIN (SELECT grain, cohort_date, count(*) AS size
            FROM (SELECT grain, user_id, min(period_start) AS cohort_date FROM buys GROUP BY ALL) GROUP BY ALL)
        USING (grain, cohort_date)
      JOIN (SELECT grain, user_id, period_start FROM buys) USING (grain, user_id)
      GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    out = {
        "rfm_base": q_rfm_base(),
        "rfm_score": q_rfm_score(),
        "rfm_segment_share": q_rfm_segment_share(),
        "rfm_segment_sales": q_rfm_segment_sales(),
        "monthly_rfm_base": q_monthly_rfm_base(),
        "monthly_rfm": q_monthly_rfm(),
        "monthly_segment_stat": q_monthly_segment_stat(),
        "segment_transition_uplift": q_segment_transition_uplift(),
        "segment_path": q_segment_path(),
        "cohort_retention": q_cohort_retention(),
        "cohort_age_metrics": q_cohort_age_metrics(),
        "cohort_segment_retention": q_cohort_segment_retention(),
        "churn_status": q_churn_status(),
        "churn_stats": q_churn_stats(),
        "churn_transition": q_churn_transition(),
        "churn_loss_estimate": q_churn_loss_estimate(),
        "category_dim_asof": q_category_dim_asof(),
        "monthly_rfm_category": q_monthly_rfm_category(),
        "last_purchase_category": q_last_purchase_category(),
        "last_purchase_category_purchases_only": q_last_purchase_category(purchases_only=True),
        "monthly_rfm_category_attributed": q_monthly_rfm_category_attributed(),
        "churn_loss_estimate_dedup": q_churn_loss_estimate(dedup=True),
        "pre_snapshot_activity": q_pre_snapshot_activity(),
        "pre_snapshot_activity_by_type": q_pre_snapshot_activity_by_type(),
        "churn_event_funnel": q_churn_event_funnel(),
        "next_period_behaviour": q_next_period_behaviour(),
        "high_segment_behaviour": q_high_segment_behaviour(),
        "high_segment_rm": q_high_segment_rm(),
        "cohort_period_compare": q_cohort_period_compare(),
        "segment_initial_retention": q_segment_initial_retention(),
        "chi2_rate_test": q_chi2_rate_test(),
        "chi2_rate_residuals": q_chi2_rate_residuals(),
        "paired_periods": q_paired_periods(),
        "anova_initial_retention": q_anova_initial_retention(),
        "pairwise_mean_diff": q_pairwise_mean_diff(),
        "spearman_cohort_age": q_spearman_cohort_age(),
        "wilcoxon_battery": q_wilcoxon_battery(),
        "logit_next_period": q_logit_next_period(),
        "logit_significant": q_logit_next_period(alpha=0.05),
        "logit_score_equations": q_logit_score_equations(),
        "test_summary": q_test_summary(),
        "segment_age_regression": q_segment_age_regression(),
        "segment_age_normal_equations": q_segment_age_normal_equations(),
        "log_round_trip": q_log_round_trip(),
        "mart_round_trip": q_mart_round_trip(),
        "appended_churn_status": q_churn_status(),
        "appended_monthly_rfm": q_monthly_rfm(),
        "appended_rfm_base": q_rfm_base(),
        "appended_cohort_retention": q_cohort_retention(),
        "active_users_by_grain": q_active_users_by_grain(),
        "cohort_retention_by_grain": q_cohort_retention_by_grain(),
    }
    return out
