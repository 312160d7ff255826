"""DuckDB SQL stating each registered query independently of the Spark code.

Built from the same parameters as the Spark plans, so a change of a parameter changes both.
Tables are the driver's views: orders, lineitem, customer, …
"""

from __future__ import annotations

from .intake import P
from .testbed import T
from ..functions.holidays import HOLIDAY_CODES
from ..operators.features import FIXED_HOLIDAYS
from ..models.trend_weekday import Z80


def _ranges_pred(col: str, ranges) -> str:
    return " OR ".join(f"{col} BETWEEN DATE '{lo}' AND DATE '{hi}'" for lo, hi in ranges)


def _rules_values(rules) -> str:
    rows = ", ".join(
        f"({i}, DATE '{t0}', DATE '{t1}', DATE '{s0}', DATE '{s1}')" for i, (t0, t1, s0, s1) in enumerate(rules, 1)
    )
    return f"(VALUES {rows}) AS r(rule, t0, t1, s0, s1)"


# Case tables in the reference's roles.
CASES = f"""
a_all AS (
  SELECT coalesce(c.c_mktsegment, 'unknown') AS series_id, o.o_orderkey AS case_id, o.o_orderpriority AS queue,
         coalesce(c.c_mktsegment, 'unknown') AS team_type, o.o_orderstatus AS department, CAST(o.o_custkey AS VARCHAR) AS handler,
         CAST(o.o_orderdate AS DATE) AS receipt_date
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
),
a_f AS (
  SELECT * FROM a_all
  WHERE contains(queue, '{P.workbasket_needle}') AND receipt_date >= DATE '{P.date_from}'
),
agents AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS agent FROM customer WHERE c_acctbal > {P.routing_min_balance}),
a_routed AS (
  SELECT * FROM a_f
  WHERE handler IN (SELECT agent FROM agents)
     OR (department = '{P.routing_dept}' AND NOT contains(queue, '{P.routing_exclude}'))
),
b_all AS (
  SELECT coalesce(c.c_mktsegment, 'unknown') AS series_id, l.l_orderkey AS case_no, CAST(l.l_shipdate AS VARCHAR) AS receipt_text,
         l.l_returnflag AS channel_dept, l.l_linestatus AS origin,
         CAST(try_strptime(substr(CAST(l.l_shipdate AS VARCHAR), 1, 10), '%Y-%m-%d') AS DATE) AS receipt_date
  FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey
),
b_f AS (SELECT * FROM b_all WHERE channel_dept = '{P.b_dept}' AND origin <> '{P.b_excluded_origin}')
"""

INTAKE = CASES + f""",
a_bounds AS (SELECT series_id, min(receipt_date) AS s, max(receipt_date) AS e FROM a_f GROUP BY series_id),
a_uniq AS (
  SELECT * FROM (
    SELECT series_id, case_id, receipt_date,
           row_number() OVER (PARTITION BY case_id ORDER BY receipt_date, series_id) AS rn
    FROM a_routed) WHERE rn = 1
),
a_cnt AS (SELECT series_id, receipt_date AS ds, count(*) AS y FROM a_uniq GROUP BY 1, 2),
a_cal AS (SELECT series_id, CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS ds FROM a_bounds),
a_dense AS (
  SELECT series_id, ds, y FROM a_cnt
  UNION ALL
  SELECT series_id, ds, 0 AS y FROM a_cal WHERE NOT EXISTS (
    SELECT 1 FROM a_cnt WHERE a_cnt.series_id = a_cal.series_id AND a_cnt.ds = a_cal.ds)
),
b_cnt AS (
  SELECT * FROM (SELECT series_id, receipt_date AS ds, count(*) AS y FROM b_f GROUP BY 1, 2)
  WHERE ds <= DATE '{P.b_window[1]}' AND ds > DATE '{P.b_window[0]}'
),
b_bounds AS (SELECT series_id, min(ds) AS s, max(ds) AS e FROM b_cnt GROUP BY series_id),
b_cal AS (SELECT series_id, CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS ds FROM b_bounds),
b_dense AS (
  SELECT series_id, ds, y FROM b_cnt
  UNION ALL
  SELECT series_id, ds, 0 AS y FROM b_cal WHERE NOT EXISTS (
    SELECT 1 FROM b_cnt WHERE b_cnt.series_id = b_cal.series_id AND b_cnt.ds = b_cal.ds)
),
combined AS (
  SELECT series_id, ds, CAST(sum(y) AS BIGINT) AS y
  FROM (SELECT * FROM a_dense UNION ALL SELECT * FROM b_dense) GROUP BY 1, 2
),
patch AS (
  SELECT series_id, receipt_date AS ds, count(*) AS y FROM b_all
  WHERE {_ranges_pred('receipt_date', P.patch_ranges)} GROUP BY 1, 2
),
patched AS (
  SELECT c.series_id, c.ds, CAST(coalesce(p.y, c.y) AS BIGINT) AS y
  FROM combined c LEFT JOIN patch p ON c.series_id = p.series_id AND c.ds = p.ds
),
rules AS (SELECT * FROM {_rules_values(P.patch_rules)}),
tgt AS (
  SELECT s.series_id, r.rule, s.ds, row_number() OVER (PARTITION BY s.series_id, r.rule ORDER BY s.ds) AS rk
  FROM patched s JOIN rules r ON s.ds BETWEEN r.t0 AND r.t1
),
src AS (
  SELECT s.series_id, r.rule, s.y, row_number() OVER (PARTITION BY s.series_id, r.rule ORDER BY s.ds) AS rk
  FROM patched s JOIN rules r ON s.ds BETWEEN r.s0 AND r.s1
),
copied AS (
  SELECT tgt.series_id, tgt.ds, max_by(src.y, tgt.rule) AS y
  FROM tgt JOIN src ON tgt.series_id = src.series_id AND tgt.rule = src.rule AND tgt.rk = src.rk
  GROUP BY 1, 2
),
intake AS (
  SELECT p.series_id, p.ds, CAST(coalesce(c.y, p.y) AS BIGINT) AS y
  FROM patched p LEFT JOIN copied c ON p.series_id = c.series_id AND p.ds = c.ds
)
"""



def with_(*parts: str, body: str) -> str:
    ctes = ",\n".join(p.strip().strip(",") for p in parts)
    return f"WITH {ctes}\n{body}"


def _q(s: str) -> str:
    return s.replace("'", "''")


# Text balance series derived from orders, parsed, trimmed and interpolated.
BAL = """
bal_daily AS (
  SELECT coalesce(c.c_mktsegment, 'unknown') AS series_id, CAST(o.o_orderdate AS DATE) AS d,
         sum(CAST(round(o.o_totalprice * 100, 0) AS BIGINT)) AS cents
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2
),
bal_parsed AS (
  SELECT series_id,
         CASE WHEN day(d) = 31 THEN 'TBC' ELSE strftime(d, '%-d/%-m/%Y') END AS "Date",
         CASE WHEN day(d) = 31 THEN NULL ELSE d END AS ds,
         CASE WHEN day(d) = 15 THEN NULL ELSE CAST(cents AS DOUBLE) / 100.0 END AS y
  FROM bal_daily
),
bal_nn AS (SELECT series_id, ds, y FROM bal_parsed WHERE ds IS NOT NULL AND y IS NOT NULL),
bal_rn AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS rn FROM bal_nn),
bal_stats AS (
  SELECT series_id, count(y) FILTER (WHERE rn <= 120) AS n, min(y) FILTER (WHERE rn <= 120) AS lo,
         max(y) FILTER (WHERE rn <= 120) AS hi
  FROM bal_rn GROUP BY 1
),
bal_last AS (
  SELECT r.series_id, max(r.ds) AS last_real FROM bal_nn r JOIN bal_stats s USING (series_id)
  WHERE r.y <> s.lo GROUP BY 1
),
bal_trim AS (
  SELECT r.series_id, r.ds, r.y FROM bal_nn r JOIN bal_stats s USING (series_id) LEFT JOIN bal_last l USING (series_id)
  WHERE NOT (s.n >= 30 AND s.lo = s.hi AND l.last_real IS NOT NULL) OR r.ds <= l.last_real
)
"""


def interp_sql(src: str, p: str) -> str:
    """Daily grid + linear interpolation of ``src`` (series_id, ds, y) as CTE ``{p}``."""
    w_prev = "PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    w_next = "PARTITION BY series_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    return f"""
{p}_bounds AS (SELECT series_id, min(ds) AS s, max(ds) AS e FROM {src} GROUP BY 1),
{p}_grid AS (
  SELECT g.series_id, g.ds, t.y FROM (
    SELECT series_id, CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS ds FROM {p}_bounds) g
  LEFT JOIN {src} t ON g.series_id = t.series_id AND g.ds = t.ds
),
{p}_nb AS (
  SELECT series_id, ds, y,
    last_value(CASE WHEN y IS NOT NULL THEN ds END IGNORE NULLS) OVER ({w_prev}) AS pd,
    last_value(CAST(y AS DOUBLE) IGNORE NULLS) OVER ({w_prev}) AS pv,
    first_value(CASE WHEN y IS NOT NULL THEN ds END IGNORE NULLS) OVER ({w_next}) AS nd,
    first_value(CAST(y AS DOUBLE) IGNORE NULLS) OVER ({w_next}) AS nv
  FROM {p}_grid
),
{p} AS (
  SELECT series_id, ds,
    CASE WHEN y IS NOT NULL THEN CAST(y AS DOUBLE)
         WHEN pd IS NOT NULL AND nd IS NOT NULL THEN pv + (nv - pv) * datediff('day', pd, ds) / datediff('day', pd, nd)
         ELSE coalesce(pv, nv) END AS y
  FROM {p}_nb
)
"""


BAL_CLEAN = BAL + "," + interp_sql("bal_trim", "bal")

_hol_rules = ", ".join(f"({m}, {d}, '{_q(n)}')" for m, d, n in FIXED_HOLIDAYS)
_code_cases = " ".join(f"WHEN '{_q(k)}' THEN {v}" for k, v in HOLIDAY_CODES.items())

HOL = f"""
hol_years AS (
  SELECT year(min(CAST(o_orderdate AS DATE))) AS y0, year(max(CAST(o_orderdate AS DATE))) + 1 AS y1 FROM orders
),
hol_days AS (
  SELECT make_date(CAST(y.yr AS INTEGER), r.m, r.d) AS ds, r.name AS holiday
  FROM (SELECT unnest(generate_series(y0, y1)) AS yr FROM hol_years) y, (VALUES {_hol_rules}) r(m, d, name)
),
hol_raw AS (
  SELECT ds, holiday, 1 AS is_ph FROM hol_days
  UNION ALL
  SELECT CAST(ds + 1 AS DATE), holiday || ' (Observed)', 1 FROM hol_days WHERE isodow(ds) = 7
),
hol_clean AS (
  SELECT ds, holiday AS raw_name,
         trim(regexp_replace(regexp_replace(holiday, '\\(Observed\\)', '', 'g'), '\\* \\(\\*estimated\\)', '', 'g')) AS holiday,
         is_ph
  FROM hol_raw
),
hol AS (SELECT ds, min(holiday) AS holiday, 1 AS is_ph FROM hol_clean GROUP BY ds)
"""

HOL_CODE = f"CAST(CASE coalesce(holiday, 'nan') {_code_cases} ELSE NULL END AS INTEGER)"

FEAT = """
hj AS (
  SELECT i.series_id, i.ds, i.y, h.holiday, CAST(coalesce(h.is_ph, 0) AS INTEGER) AS is_ph
  FROM intake i LEFT JOIN hol h ON i.ds = h.ds
),
hf0 AS (
  SELECT *, CAST(isodow(ds) - 1 AS INTEGER) AS wday,
    lag(is_ph, 1, 0) OVER (PARTITION BY series_id ORDER BY ds) AS l1,
    lag(is_ph, 2, 0) OVER (PARTITION BY series_id ORDER BY ds) AS l2,
    lag(is_ph, 3, 0) OVER (PARTITION BY series_id ORDER BY ds) AS l3
  FROM hj
),
hf1 AS (
  SELECT *, CASE WHEN wday = 0 AND (l3 = 1 OR l2 = 1) AND is_ph <> 1 THEN 1 ELSE 0 END AS helper FROM hf0
),
hflags AS (
  SELECT series_id, ds, y, holiday, is_ph, wday, helper,
    CAST(CASE WHEN is_ph = 1 THEN 0 WHEN wday IN (5, 6) THEN 0 WHEN helper = 1 THEN 1 ELSE l1 END AS INTEGER) AS is_ph_lag1
  FROM hf1
)
"""


def lag_cols(n: int = 14) -> str:
    return ", ".join(f"lag(y, {k}, 0) OVER (PARTITION BY series_id ORDER BY ds) AS count_lag{k}" for k in range(1, n + 1))


CVB = f"""
cvb AS (
  SELECT greatest(min(ds), DATE '{T.cv_start}') AS start, least(max(ds), DATE '{T.cv_end}') AS "end" FROM intake
),
cv AS (SELECT * FROM intake WHERE ds BETWEEN DATE '{T.cv_start}' AND DATE '{T.cv_end}'),
te AS (SELECT * FROM intake WHERE ds BETWEEN DATE '{T.test_start}' AND DATE '{T.test_end}')
"""

_L, _H, _S = T.roll_train, T.roll_horizon, T.roll_step
FOLDS = f"""
rfolds AS (
  SELECT CAST(k + 1 AS INTEGER) AS fold, CAST(start + CAST(k * {_S} AS INTEGER) AS DATE) AS train_start,
         CAST(start + CAST(k * {_S} + {_L} AS INTEGER) AS DATE) AS train_end,
         CAST(start + CAST(k * {_S} + {_L} AS INTEGER) AS DATE) AS test_start,
         CAST(start + CAST(k * {_S} + {_L + _H} AS INTEGER) AS DATE) AS test_end
  FROM (SELECT start, unnest(generate_series(0, CAST(floor((datediff('day', start, "end") - {_L} - {_H}) / {_S}) AS BIGINT))) AS k
        FROM cvb WHERE datediff('day', start, "end") - {_L} - {_H} >= 0)
),
ms AS (
  SELECT CAST(m AS DATE) AS cutoff FROM cvb,
    unnest(generate_series(CAST(date_trunc('month', start) AS TIMESTAMP),
                           CAST(CAST("end" - {T.cutoff_horizon} AS DATE) AS TIMESTAMP), INTERVAL 1 MONTH)) t(m)
  WHERE CAST(m AS DATE) >= start
),
cutoffs AS (SELECT CAST(row_number() OVER (ORDER BY cutoff) - 1 AS INTEGER) AS i, cutoff FROM ms),
cfolds AS (
  SELECT i AS fold, (SELECT start FROM cvb) AS train_start, CAST(cutoff + 1 AS DATE) AS train_end,
         CAST(cutoff + 1 AS DATE) AS test_start, CAST(cutoff + {T.cutoff_horizon + 1} AS DATE) AS test_end, cutoff
  FROM cutoffs WHERE i >= 1
)
"""


def expand_sql(src: str, folds: str, name: str, extra: str = "") -> str:
    return f"""
{name} AS (
  SELECT s.*, f.fold{extra}, CASE WHEN s.ds < f.train_end THEN 'train' ELSE 'test' END AS role
  FROM {src} s JOIN {folds} f ON s.ds >= f.train_start AND s.ds < f.test_end
   AND (s.ds < f.train_end OR s.ds >= f.test_start)
)
"""


def tw_sql(p: str, train: str, pred: str, keys: list[str], mode: str) -> str:
    """Trend × weekday model fitted on ``train`` per ``keys``, applied to ``pred`` → CTE ``p``."""
    k = ", ".join(keys)
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in keys)
    fc = "trend * coalesce(factor, 1.0)" if mode == "mul" else "trend + coalesce(\"offset\", 0.0)"
    return f"""
{p}_org AS (SELECT {k}, min(ds) AS origin FROM {train} GROUP BY {k}),
{p}_x AS (
  SELECT t.*, o.origin, CAST(datediff('day', o.origin, t.ds) AS DOUBLE) AS _t, CAST(t.y AS DOUBLE) AS _y,
         isodow(t.ds) - 1 AS _w
  FROM {train} t JOIN {p}_org o ON {on('t', 'o')}
),
{p}_l0 AS (
  SELECT {k}, origin, CAST(count(_y) AS DOUBLE) AS n, sum(CASE WHEN _y IS NOT NULL THEN _t END) AS st, sum(_y) AS sy,
         sum(CASE WHEN _y IS NOT NULL THEN _t * _t END) AS stt, sum(_t * _y) AS sty
  FROM {p}_x GROUP BY {k}, origin
),
{p}_l1 AS (SELECT *, coalesce((n * sty - st * sy) / nullif(n * stt - st * st, 0.0), 0.0) AS slope FROM {p}_l0),
{p}_lin AS (SELECT {k}, origin, slope, (sy - slope * st) / n AS intercept FROM {p}_l1),
{p}_w0 AS (
  SELECT {k}, _w, CAST(count(_y) AS DOUBLE) AS nw, sum(_t) AS stw, sum(_y) AS syw
  FROM {p}_x WHERE _y IS NOT NULL GROUP BY {k}, _w
),
{p}_wk AS (
  SELECT {", ".join("w." + c for c in keys)}, w._w AS wday,
         w.syw / nullif(w.nw * l.intercept + l.slope * w.stw, 0.0) AS factor,
         (w.syw - (w.nw * l.intercept + l.slope * w.stw)) / w.nw AS "offset"
  FROM {p}_w0 w JOIN {p}_lin l ON {on('w', 'l')}
),
{p}_fit AS (
  SELECT t.*, l.intercept + l.slope * CAST(datediff('day', l.origin, t.ds) AS DOUBLE) AS trend, w.factor, w."offset"
  FROM {train} t JOIN {p}_lin l ON {on('t', 'l')}
  LEFT JOIN {p}_wk w ON {on('t', 'w')} AND w.wday = isodow(t.ds) - 1
),
{p}_sp AS (
  SELECT {k}, sqrt(avg(pow(CAST(y AS DOUBLE) - ({fc}), 2))) AS rmse_in FROM {p}_fit GROUP BY {k}
),
{p}_ap AS (
  SELECT t.*, l.intercept + l.slope * CAST(datediff('day', l.origin, t.ds) AS DOUBLE) AS trend, w.factor, w."offset"
  FROM {pred} t JOIN {p}_lin l ON {on('t', 'l')}
  LEFT JOIN {p}_wk w ON {on('t', 'w')} AND w.wday = isodow(t.ds) - 1
),
{p}_fc AS (
  SELECT a.*, {fc} AS fc, {Z80} * coalesce(s.rmse_in, 0.0) AS half
  FROM {p}_ap a LEFT JOIN {p}_sp s ON {on('a', 's')}
),
{p} AS (
  SELECT {k}, ds, CAST(y AS DOUBLE) AS actual, fc AS fcst, round(fc - half, 6) AS lo,
         round(fc + half, 6) AS hi, 'trend_weekday_{mode}' AS model
  FROM {p}_fc
)
"""


def measures(a: str = "actual", f: str = "fcst") -> str:
    both = f"{a} IS NOT NULL AND {f} IS NOT NULL"
    aa, ff = f"CASE WHEN {both} THEN {a} END", f"CASE WHEN {both} THEN {f} END"
    return {
        "mae": f"round(avg(abs({aa} - {ff})), 6)",
        "rmse": f"round(sqrt(avg(pow({aa} - {ff}, 2))), 6)",
        "mape": f"round(avg(abs(({aa} - {ff}) / nullif({aa}, 0.0))) * 100.0, 6)",
        "kpi": f"round(avg(abs(({aa} - {ff}) / ({aa} + 0.1))) * 100.0, 6)",
        "wkpi": f"round(sum(abs(({aa} - {ff}) / ({aa} + 0.1)) * {aa}) * 100.0 / nullif(sum({aa}), 0.0), 6)",
        "n_matched": f"count(*) FILTER (WHERE {both})",
    }


def measure_list(names=("mae", "rmse", "mape", "kpi", "wkpi", "n_matched")) -> str:
    m = measures()
    return ", ".join(f"{m[n]} AS {n}" for n in names)


TW_TEST = tw_sql("twa", "cv", "te", ["series_id"], "add") + "," + tw_sql("twm", "cv", "te", ["series_id"], "mul") + """,
allf AS (SELECT * FROM twa UNION ALL SELECT * FROM twm)
"""

FOLD_ROWS = (f"""
pfolds AS (
  SELECT CAST(k + 1 AS INTEGER) AS fold, CAST(DATE '{T.cv_start}' + CAST(k * {_S} AS INTEGER) AS DATE) AS train_start,
         CAST(DATE '{T.cv_start}' + CAST(k * {_S} + {_L} AS INTEGER) AS DATE) AS train_end,
         CAST(DATE '{T.cv_start}' + CAST(k * {_S} + {_L} AS INTEGER) AS DATE) AS test_start,
         CAST(DATE '{T.cv_start}' + CAST(k * {_S} + {_L + _H} AS INTEGER) AS DATE) AS test_end
  FROM unnest(generate_series(0, CAST(floor((datediff('day', DATE '{T.cv_start}', DATE '{T.cv_end}') - {_L} - {_H}) / {_S}) AS BIGINT))) t(k)
),""" + expand_sql("cv", "pfolds", "rx") + """,
rtr AS (SELECT * FROM rx WHERE role = 'train'),
rte AS (SELECT * FROM rx WHERE role = 'test')
,""" + tw_sql("fra", "rtr", "rte", ["series_id", "fold"], "add") + ","
    + tw_sql("frm", "rtr", "rte", ["series_id", "fold"], "mul") + """,
frows AS (SELECT * FROM fra UNION ALL SELECT * FROM frm),
fmetrics AS (
  SELECT model, series_id, fold, """ + measure_list() + """, 'rolling_730_60_30' AS run
  FROM frows GROUP BY model, series_id, fold
)
""")

VALID = f"""
vsplit AS (
  SELECT *, CASE WHEN ds <= CAST(max(ds) OVER (PARTITION BY series_id) - {T.validation_days} AS DATE)
            THEN 'train' ELSE 'valid' END AS split FROM intake
),
vtr AS (SELECT * FROM vsplit WHERE split = 'train'),
vva AS (SELECT * FROM vsplit WHERE split = 'valid')
,""" + tw_sql("vm", "vtr", "vva", ["series_id"], "mul") + "," + tw_sql("va", "vtr", "vva", ["series_id"], "add") + """,
vfc AS (SELECT *, 1 AS param_id FROM vm UNION ALL SELECT *, 2 AS param_id FROM va),
gscores AS (
  SELECT series_id, param_id, model, """ + measure_list(("mae", "rmse", "mape")) + """
  FROM vfc GROUP BY series_id, param_id, model
)
"""

A_CNT = """
a_uniq AS (
  SELECT * FROM (
    SELECT series_id, case_id, receipt_date,
           row_number() OVER (PARTITION BY case_id ORDER BY receipt_date, series_id) AS rn
    FROM a_routed) WHERE rn = 1
),
a_cnt AS (SELECT series_id, receipt_date AS ds, count(*) AS y FROM a_uniq GROUP BY 1, 2),
a_bounds AS (SELECT series_id, min(receipt_date) AS start, max(receipt_date) AS "end" FROM a_f GROUP BY series_id)
"""

_tree_lr = "(VALUES (1, 0.25), (2, 0.5), (3, 1.0), (4, 1.5)) l(li, learning_rate)"
_cps = ", ".join(f"({i}, {v})" for i, v in enumerate([0.01, 0.05, 0.1, 0.2, 0.3, 0.5], 1))

SQL: dict[str, str] = {
    # scans and filters
    "scan_cases": with_(CASES, body="SELECT * FROM a_all"),
    "scan_cases_b": with_(CASES, body="SELECT series_id, case_no, receipt_text FROM b_all"),
    "filter_contains": with_(CASES, body=f"SELECT series_id, case_id, queue FROM a_all "
                                         f"WHERE contains(queue, '{P.workbasket_needle}')"),
    "filter_date_from": with_(CASES, body=f"SELECT series_id, case_id, receipt_date FROM a_all "
                                          f"WHERE receipt_date >= DATE '{P.date_from}'"),
    "filter_routing": with_(CASES, body="SELECT series_id, case_id, handler, department, queue FROM a_routed"),
    "filter_channel": with_(CASES, body="SELECT series_id, case_no, channel_dept, origin FROM b_f"),
    "date_from_text": with_(CASES, body="SELECT case_no, receipt_text, receipt_date FROM b_all"),
    "flag_child": """
SELECT CAST(CASE WHEN l_linenumber > 1 THEN 1 ELSE 0 END AS INTEGER) AS is_child, count(*) AS row_count
FROM lineitem GROUP BY 1""",
    # counting
    "dedupe_case": """
SELECT case_id, receipt_date, l_linenumber FROM (
  SELECT l_orderkey AS case_id, CAST(l_shipdate AS DATE) AS receipt_date, l_linenumber,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_shipdate AS DATE), l_linenumber) AS rn
  FROM lineitem) WHERE rn = 1""",
    "daily_count": with_(CASES, A_CNT, body="SELECT series_id, ds, y FROM a_cnt"),
    "daily_count_b": with_(CASES, body="SELECT series_id, receipt_date AS ds, count(*) AS y FROM b_f GROUP BY 1, 2"),
    "filter_window": with_(CASES, body=f"""SELECT * FROM (SELECT series_id, receipt_date AS ds, count(*) AS y FROM b_f GROUP BY 1, 2)
WHERE ds <= DATE '{P.b_window[1]}' AND ds > DATE '{P.b_window[0]}'"""),
    "date_bounds": with_(CASES, A_CNT, body="SELECT series_id, start, \"end\" FROM a_bounds"),
    "stage_funnel": with_(CASES, body="""
SELECT s.series_id, s.n AS n_scanned, coalesce(r.n, 0) AS n_routed, coalesce(r.u, 0) AS n_unique
FROM (SELECT series_id, count(*) AS n FROM a_f GROUP BY series_id) s
LEFT JOIN (SELECT series_id, count(*) AS n, count(DISTINCT case_id) AS u FROM a_routed GROUP BY series_id) r USING (series_id)"""),
    # series
    "missing_days": with_(CASES, A_CNT, body="""
SELECT c.series_id, c.ds FROM (
  SELECT series_id, CAST(unnest(generate_series(start, "end", INTERVAL 1 DAY)) AS DATE) AS ds FROM a_bounds) c
WHERE NOT EXISTS (SELECT 1 FROM a_cnt WHERE a_cnt.series_id = c.series_id AND a_cnt.ds = c.ds)"""),
    "densify_zero": with_(INTAKE, body="SELECT series_id, ds, CAST(y AS BIGINT) AS y FROM a_dense"),
    "combine_sources": with_(INTAKE, body="SELECT series_id, ds, y FROM combined"),
    "patch_dim": with_(INTAKE, body="SELECT series_id, ds, y FROM patch"),
    "patch_values": with_(INTAKE, body="SELECT series_id, ds, y FROM patched"),
    "patch_copy": with_(INTAKE, body="SELECT series_id, ds, y FROM intake"),
    "intake_series": with_(INTAKE, body="SELECT series_id, ds, y FROM intake"),
    # text series
    "parse_grouped_number": with_(BAL, body='SELECT series_id, "Date", y FROM bal_parsed'),
    "load_series_text": with_(BAL, body="SELECT series_id, ds, y FROM bal_parsed"),
    "drop_nulls": with_(BAL, body="SELECT series_id, ds, y FROM bal_nn"),
    "trim_plateau": with_(BAL, body="SELECT series_id, ds, y FROM bal_trim"),
    "interpolate": with_(BAL, interp_sql("bal_nn", "ip"), body="SELECT series_id, ds, y FROM ip"),
    "clean_series": with_(BAL_CLEAN, body="SELECT series_id, ds, y FROM bal"),
    "weekday_profile": with_(BAL_CLEAN, body="""
SELECT series_id, CAST(isodow(ds) - 1 AS INTEGER) AS wday, dayname(ds) AS weekday_name, round(avg(y), 6) AS y_mean
FROM bal GROUP BY 1, 2, 3"""),
    "split_tail": with_(BAL_CLEAN, body=f"""
SELECT series_id, ds, y, CASE WHEN ds <= CAST(max(ds) OVER (PARTITION BY series_id) - {T.validation_days} AS DATE)
  THEN 'train' ELSE 'valid' END AS split FROM bal"""),
    "preview_head": with_(BAL_CLEAN, body="""
SELECT * FROM (SELECT series_id, ds, y, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ds) AS INTEGER) AS rn FROM bal)
WHERE rn <= 5"""),
    "extend_horizon": with_(BAL_CLEAN, body="""
SELECT series_id, ds, y FROM bal
UNION ALL
SELECT series_id, CAST(last + CAST(k AS INTEGER) AS DATE) AS ds, CAST(NULL AS DOUBLE) AS y
FROM (SELECT series_id, max(ds) AS last FROM bal GROUP BY 1), unnest(generate_series(1, 90)) t(k)"""),
    "sink_horizon": with_(BAL_CLEAN, body="""
SELECT series_id, CAST(last + CAST(k AS INTEGER) AS DATE) AS ds, CAST(NULL AS DOUBLE) AS y
FROM (SELECT series_id, max(ds) AS last FROM bal GROUP BY 1), unnest(generate_series(1, 90)) t(k)"""),
    "yearend_window": with_(BAL_CLEAN, body="""
SELECT series_id, 'year_end_spike' AS holiday, anchor, CAST("offset" AS INTEGER) AS "offset", CAST(anchor + CAST("offset" AS INTEGER) AS DATE) AS ds
FROM (SELECT series_id, make_date(CAST(yr AS INTEGER), 12, 10) AS anchor FROM (
        SELECT series_id, unnest(generate_series(year(min(ds)), year(max(ds)) + 3)) AS yr FROM bal GROUP BY 1)),
     unnest(generate_series(-14, 31)) t("offset")"""),
}


def _fourier(name: str, period: float, order: int) -> str:
    import math
    cols = []
    for k in range(1, order + 1):
        c = repr(2.0 * math.pi * k / period)
        cols.append(f"round(sin(t * {c}), 6) AS {name}_sin{k}, round(cos(t * {c}), 6) AS {name}_cos{k}")
    return ", ".join(cols)


SQL["fourier_features"] = with_(BAL_CLEAN, body=f"""
SELECT series_id, ds, {_fourier('weekly', 7.0, 3)}, {_fourier('yearly', 365.25, 3)}
FROM (SELECT series_id, ds, CAST(datediff('day', DATE '1970-01-01', ds) AS DOUBLE) AS t FROM bal)""")

for _freq, _label in (("W", "CAST(ds + CAST(6 - (isodow(ds) - 1) AS INTEGER) AS DATE)"),
                      ("W-MON", "CAST(ds + CAST((7 - (isodow(ds) - 1)) % 7 AS INTEGER) AS DATE)"),
                      ("M", "last_day(ds)")):
    _key = {"W": "resample_week", "W-MON": "resample_week_mon", "M": "resample_month"}[_freq]
    SQL[_key] = with_(BAL_CLEAN, body=f"""
SELECT series_id, {_label} AS ds, round(avg(y), 6) AS y_mean, round(median(y), 6) AS y_median,
       arg_max(y, ds) AS y_last, count(y) AS n_days
FROM bal GROUP BY 1, 2""")

SQL.update({
    # features on the intake series
    "calendar": with_(INTAKE, body="""
SELECT series_id, CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS ds
FROM (SELECT series_id, min(ds) AS s, max(ds) AS e FROM intake GROUP BY 1)"""),
    "calendar_features": with_(INTAKE, body="""
SELECT series_id, ds, y, CAST(isodow(ds) - 1 AS INTEGER) AS wday, dayname(ds) AS weekday_name,
       CAST(dayofyear(ds) AS INTEGER) AS yearday, CASE WHEN isodow(ds) IN (6, 7) THEN 1 ELSE 0 END AS is_weekend
FROM intake"""),
    "holiday_clean": with_(HOL, body="SELECT ds, raw_name, holiday, is_ph FROM hol_clean"),
    "holiday_code": with_(INTAKE, HOL, body=f"""
SELECT i.series_id, i.ds, h.holiday, {HOL_CODE} AS holiday_code FROM intake i LEFT JOIN hol h ON i.ds = h.ds"""),
    "holiday_join": with_(INTAKE, HOL, FEAT, body="SELECT series_id, ds, y, holiday, is_ph FROM hj"),
    "holiday_range": with_(INTAKE, HOL, body="""
SELECT c.series_id, c.ds, h.holiday FROM (
  SELECT series_id, CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS ds
  FROM (SELECT series_id, min(ds) AS s, max(ds) AS e FROM intake GROUP BY 1)) c JOIN hol h ON c.ds = h.ds"""),
    "holiday_window": with_(HOL, body="""
SELECT CAST(ds + CAST("offset" AS INTEGER) AS DATE) AS ds, holiday, CAST("offset" AS INTEGER) AS "offset", ds AS anchor
FROM hol, unnest(generate_series(0, 1)) t("offset")"""),
    "holiday_flags": with_(INTAKE, HOL, FEAT, body="SELECT * FROM hflags"),
    "lag_flag": with_(INTAKE, HOL, FEAT, body="""
SELECT series_id, ds, is_ph, lag(is_ph, 1, 0) OVER (PARTITION BY series_id ORDER BY ds) AS is_ph_lag1 FROM hj"""),
    "lag_features": with_(INTAKE, body=f"SELECT series_id, ds, y, {lag_cols()} FROM intake"),
    "feature_frame": with_(INTAKE, HOL, FEAT, body=f"""
SELECT *, CASE WHEN wday IN (5, 6) THEN 1 ELSE 0 END AS is_weekend, {lag_cols()}, {HOL_CODE} AS holiday_code
FROM hflags"""),
    # folds and grids
    "folds_rolling": with_(INTAKE, CVB, FOLDS, body="SELECT * FROM rfolds"),
    "cutoffs_monthly": with_(INTAKE, CVB, FOLDS, body="SELECT i, cutoff FROM cutoffs"),
    "folds_cutoff": with_(INTAKE, CVB, FOLDS, body="SELECT * FROM cfolds"),
    "fold_expand": with_(INTAKE, CVB, FOLDS, expand_sql("cv", "rfolds", "rx"),
                         body="SELECT series_id, ds, y, fold, role FROM rx"),
    "grid_params": with_(INTAKE, body=f"""
SELECT s.series_id, g.param_id, CAST(g.changepoint_prior_scale AS DOUBLE) AS changepoint_prior_scale
FROM (SELECT DISTINCT series_id FROM intake) s, (VALUES {_cps}) g(param_id, changepoint_prior_scale)"""),
    "grid_tree": with_(INTAKE, body=f"""
SELECT s.series_id, CAST((d.max_depth - 2) * 36 + ((m.min_data_in_leaf - 10) // 5) * 4 + l.li AS INTEGER) AS param_id,
       CAST(d.max_depth AS INTEGER) AS max_depth, CAST(m.min_data_in_leaf AS INTEGER) AS min_data_in_leaf,
       CAST(l.learning_rate AS DOUBLE) AS learning_rate, 'regression' AS objective,
       CAST(round_even(pow(2.0, d.max_depth) * 0.8, 0) AS INTEGER) AS num_leaves,
       CASE WHEN l.learning_rate = 0.25 THEN 300 WHEN l.learning_rate = 0.5 THEN 200 ELSE 100 END AS num_iterations
FROM (SELECT DISTINCT series_id FROM intake) s, range(2, 7) d(max_depth), range(10, 51, 5) m(min_data_in_leaf), {_tree_lr}"""),
    # checkable model, scoring, blend
    "trend_weekday": with_(INTAKE, CVB, tw_sql("twm", "cv", "te", ["series_id"], "mul"), body="SELECT * FROM twm"),
    "all_forecasts": with_(INTAKE, CVB, TW_TEST, body="SELECT * FROM allf"),
    "round_forecast": with_(INTAKE, CVB, TW_TEST, body="SELECT series_id, ds, fcst, round_even(fcst, 0) AS fcst_round FROM twm"),
    "clip_forecast": with_(INTAKE, CVB, TW_TEST, body="""
SELECT series_id, ds, fcst, CASE WHEN fcst IS NOT NULL THEN greatest(fcst, 0.0) END AS fcst_clipped FROM twa"""),
    "pivot_models": with_(INTAKE, CVB, TW_TEST, body="""
SELECT series_id, ds, avg(fcst) FILTER (WHERE model = 'trend_weekday_add') AS trend_weekday_add,
       avg(fcst) FILTER (WHERE model = 'trend_weekday_mul') AS trend_weekday_mul
FROM allf GROUP BY 1, 2"""),
    "blend": with_(INTAKE, CVB, TW_TEST, """
bw AS (
  SELECT series_id, ds, avg(round_even(fcst, 0)) FILTER (WHERE model = 'trend_weekday_add') AS a,
         avg(round_even(fcst, 0)) FILTER (WHERE model = 'trend_weekday_mul') AS m, max(actual) AS actual
  FROM allf GROUP BY 1, 2
),
bh AS (
  SELECT *, round_even(CASE WHEN (CASE WHEN a IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN m IS NOT NULL THEN 1 ELSE 0 END) > 0
    THEN (0.0 + coalesce(a, 0.0) + coalesce(m, 0.0)) / (CASE WHEN a IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN m IS NOT NULL THEN 1 ELSE 0 END) END, 0) AS h
  FROM bw
)""", body="""
SELECT series_id, ds, CASE WHEN a IS NOT NULL THEN greatest(a, 0.0) END AS trend_weekday_add,
       CASE WHEN m IS NOT NULL THEN greatest(m, 0.0) END AS trend_weekday_mul,
       CASE WHEN h IS NOT NULL THEN greatest(h, 0.0) END AS hybrid, actual
FROM bh"""),
    "score_join": with_(INTAKE, CVB, TW_TEST, body="""
SELECT t.series_id, t.ds, CAST(t.y AS DOUBLE) AS actual, f.fcst FROM te t LEFT JOIN twm f ON t.series_id = f.series_id AND t.ds = f.ds"""),
    "forecast_with_actuals": with_(INTAKE, """
fut AS (
  SELECT series_id, ds, CAST(y AS BIGINT) AS y FROM intake
  UNION ALL
  SELECT series_id, CAST(last + CAST(k AS INTEGER) AS DATE), CAST(NULL AS BIGINT)
  FROM (SELECT series_id, max(ds) AS last FROM intake GROUP BY 1), unnest(generate_series(1, 90)) t(k)
)""", tw_sql("fh", "intake", "fut", ["series_id"], "mul"), body="""
SELECT f.series_id, f.ds, f.fcst, f.lo, f.hi, CAST(h.y AS DOUBLE) AS y
FROM fh f LEFT JOIN intake h ON f.series_id = h.series_id AND f.ds = h.ds"""),
})

SQL["sink_full"] = SQL["forecast_with_actuals"]

for _m in ("mae", "rmse", "mape", "kpi", "wkpi"):
    SQL[f"metric_{_m}"] = with_(INTAKE, CVB, TW_TEST, body=f"""
SELECT series_id, model, {measures()[_m]} AS {_m} FROM allf GROUP BY 1, 2""")

SQL.update({
    "fold_metrics": with_(INTAKE, CVB, FOLDS, FOLD_ROWS, body="SELECT * FROM fmetrics"),
    "cv_mean": with_(INTAKE, CVB, FOLDS, FOLD_ROWS, body="""
SELECT series_id, model, round(coalesce(avg(wkpi), CAST('inf' AS DOUBLE)), 6) AS cv_mean_wkpi, count(wkpi) AS n_folds
FROM fmetrics GROUP BY 1, 2"""),
    "cv_pooled": with_(INTAKE, CVB, FOLDS, FOLD_ROWS, body=f"""
SELECT series_id, model, {measures()['wkpi']} AS cv_pooled_wkpi FROM frows GROUP BY 1, 2"""),
    "metrics_by_horizon": with_(INTAKE, CVB, FOLDS, expand_sql("cv", "cfolds", "cx", ", f.cutoff"), """
ctr AS (SELECT * FROM cx WHERE role = 'train'),
cte AS (SELECT * FROM cx WHERE role = 'test')""", tw_sql("hm", "ctr", "cte", ["series_id", "fold", "cutoff"], "mul"), body=f"""
SELECT series_id, model, CAST(datediff('day', cutoff, ds) AS INTEGER) AS h,
       {measures()['mae']} AS mae, {measures()['rmse']} AS rmse, {measures()['mape']} AS mape,
       round(avg(CASE WHEN actual IS NOT NULL AND lo IS NOT NULL THEN CASE WHEN actual BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END END), 6) AS coverage,
       count(*) AS n
FROM hm GROUP BY 1, 2, 3"""),
    "grid_scores": with_(INTAKE, VALID, body="SELECT * FROM gscores"),
    "split_fixed": with_(INTAKE, body=f"""
SELECT series_id, ds, y, CASE WHEN ds BETWEEN DATE '{T.cv_start}' AND DATE '{T.cv_end}' THEN 'train' ELSE 'test' END AS split
FROM intake WHERE ds BETWEEN DATE '{T.cv_start}' AND DATE '{T.cv_end}' OR ds BETWEEN DATE '{T.test_start}' AND DATE '{T.test_end}'"""),
    "best_params": with_(INTAKE, VALID, body="""
SELECT series_id, arg_min(param_id, (mae, param_id)) AS param_id, min(mae) AS mae FROM gscores WHERE mae IS NOT NULL GROUP BY 1"""),
    "scoreboard": with_(INTAKE, CVB, FOLDS, FOLD_ROWS, TW_TEST, f"""
tw AS (SELECT series_id, model, {measures()['wkpi']} AS test_wkpi FROM allf GROUP BY 1, 2),
cvm AS (SELECT series_id, model, round(coalesce(avg(wkpi), CAST('inf' AS DOUBLE)), 6) AS cv_mean_wkpi FROM fmetrics GROUP BY 1, 2)
""", body="SELECT coalesce(tw.series_id, cvm.series_id) AS series_id, coalesce(tw.model, cvm.model) AS model, test_wkpi, cv_mean_wkpi "
          "FROM tw FULL JOIN cvm ON tw.series_id = cvm.series_id AND tw.model = cvm.model"),
})

# Easter by the golden number and the weekday of the full moon; the engine goes by epact and century.
FEASTS_SQL = """
fy AS (SELECT unnest(generate_series(year(min(ds)), year(max(ds)) + 1)) AS y FROM intake),
moon AS (SELECT y, y % 19 AS g, y // 100 AS c FROM fy),
moon2 AS (SELECT *, (c - c // 4 - (8 * c + 13) // 25 + 19 * g + 15) % 30 AS h FROM moon),
moon3 AS (SELECT *, h - (h // 28) * (1 - (29 // (h + 1)) * ((21 - g) // 11)) AS i FROM moon2),
easter AS (SELECT y, CAST(make_date(CAST(y AS INTEGER), 3, 28) + CAST(i - (y + y // 4 + i + 2 - c + c // 4) % 7 AS INTEGER) AS DATE) AS e FROM moon3),
rule_days AS (
  SELECT make_date(CAST(y AS INTEGER), m, d) AS ds, name AS holiday
  FROM fy, (VALUES (1, 1, 'New Year''s Day'), (5, 1, 'Labour Day'), (8, 9, 'National Day'), (12, 25, 'Christmas Day'), (12, 26, 'Boxing Day')) v(m, d, name)
  UNION ALL
  SELECT CAST(e + k AS DATE), name FROM easter, (VALUES (-2, 'Good Friday'), (1, 'Easter Monday'), (50, 'Whit Monday')) v(k, name)
  UNION ALL
  SELECT CAST(d AS DATE), 'Harvest Day' FROM (
    SELECT y, unnest(generate_series(make_date(CAST(y AS INTEGER), 11, 22), make_date(CAST(y AS INTEGER), 11, 28), INTERVAL 1 DAY)) AS d FROM fy
  ) WHERE isodow(d) = 4
),
rd AS (SELECT DISTINCT ds, holiday FROM rule_days),
feasts AS (
  SELECT ds, holiday, ds AS rule_ds, false AS observed FROM rd
  UNION ALL
  SELECT min(f.d), r.holiday, r.ds, true
  FROM rd r JOIN (SELECT CAST(ds + k AS DATE) AS d, ds FROM (SELECT DISTINCT ds FROM rd) z, (SELECT CAST(unnest(generate_series(1, 7)) AS INTEGER) AS k) w) f ON f.ds = r.ds
  WHERE isodow(r.ds) = 7 AND f.d NOT IN (SELECT ds FROM rd) GROUP BY r.holiday, r.ds
)
"""

_LOG = with_(INTAKE, CVB, FOLDS, FOLD_ROWS, VALID, f"""
vmetrics AS (SELECT series_id, model, {measures()['mae']} AS mae, {measures()['rmse']} AS rmse, {measures()['mape']} AS mape,
  {measures()['kpi']} AS kpi, {measures()['wkpi']} AS wkpi FROM vfc GROUP BY series_id, model),
wide AS (
  SELECT 'rolling_730_60_30' AS run, model, series_id, CAST(fold AS VARCHAR) AS fold, mae, rmse, mape, kpi, wkpi FROM fmetrics
  UNION ALL
  SELECT 'validation_tail', model, series_id, 'all', mae, rmse, mape, kpi, wkpi FROM vmetrics
),
mlog AS (
  SELECT run, model, series_id, fold, unnest(['mae', 'rmse', 'mape', 'kpi', 'wkpi']) AS metric,
         unnest([CAST(mae AS DOUBLE), rmse, mape, kpi, wkpi]) AS value FROM wide
)""", body="{}")

SQL.update({
    "feast_calendar": with_(INTAKE, FEASTS_SQL, body="SELECT ds, holiday, rule_ds, observed FROM feasts"),
    "feast_effect": with_(INTAKE, FEASTS_SQL, """
usual AS (SELECT series_id, isodow(ds) AS w, avg(CAST(y AS DOUBLE)) AS u FROM intake WHERE y IS NOT NULL AND ds NOT IN (SELECT ds FROM feasts) GROUP BY 1, 2)
""", body="""
SELECT i.series_id, f.holiday, count(*) AS n_days, round(avg(CAST(i.y AS DOUBLE)), 6) AS mean_y, round(avg(u.u), 6) AS mean_plain
FROM intake i JOIN (SELECT DISTINCT ds, holiday FROM feasts) f USING (ds) LEFT JOIN usual u ON u.series_id = i.series_id AND u.w = isodow(i.ds)
WHERE i.y IS NOT NULL GROUP BY 1, 2"""),
    "metric_log": _LOG.replace("{}", "SELECT run, model, series_id, fold, metric, value FROM mlog"),
    "compare_runs": _LOG.replace("{}", """
SELECT *, round(other - base, 6) AS change FROM (
  SELECT model, series_id, metric, count(CASE WHEN run = 'rolling_730_60_30' THEN value END) AS n_base,
         count(CASE WHEN run = 'validation_tail' THEN value END) AS n_other,
         round(avg(CASE WHEN run = 'rolling_730_60_30' THEN value END), 6) AS base,
         round(avg(CASE WHEN run = 'validation_tail' THEN value END), 6) AS other
  FROM mlog GROUP BY 1, 2, 3)"""),
})
