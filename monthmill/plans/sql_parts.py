"""Common table expressions shared by the SQL statements that check the plans."""

from __future__ import annotations

ISSUE = "DATE '2001-07-01'"


def r(expr: str, digits: int = 4) -> str:
    return f"(floor(({expr}) * 1e{digits} + 0.5e0) / 1e{digits})"


def rs(expr: str, digits: int = 4) -> str:
    """Rounding after the last bits are dropped."""
    return r(f"round(({expr}) * 1e7) / 1e7", digits)


def ym(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m')"


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip().rstrip(",") for p in parts) + "\n"


LINES = """
lines AS (
  SELECT c.c_mktsegment AS chain_id, p.p_brand AS product_id,
         'C' || (CAST(substr(p.p_brand, 7) AS INTEGER) % 5) AS category_id,
         l.l_partkey AS part_id, l.l_quantity AS qty,
         CAST(date_trunc('month', l.l_shipdate) AS DATE) AS ship_m,
         CAST(date_trunc('month', o.o_orderdate) AS DATE) AS order_m,
         l.l_orderkey, l.l_suppkey, l.l_linenumber, l.l_returnflag, l.l_linestatus, l.l_shipdate,
         o.o_orderdate, o.o_orderstatus, o.o_custkey, c.c_nationkey, p.p_name, p.p_type, p.p_size,
         l.l_extendedprice, l.l_discount
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN part p ON l.l_partkey = p.p_partkey)
"""


def monthly(keys: str = "chain_id, product_id, category_id", name: str = "monthly") -> str:
    return f"""
{name} AS (
  SELECT {keys}, period, sum(sales) AS sales, sum(orders) AS orders, sum(delivery) AS delivery
  FROM (SELECT {keys}, ship_m AS period, CASE WHEN l_returnflag = 'R' THEN 0e0 ELSE qty END AS sales,
               CAST(NULL AS DOUBLE) AS orders, qty AS delivery FROM lines
        UNION ALL SELECT {keys}, order_m, NULL, qty, NULL FROM lines)
  GROUP BY ALL)
"""


MONTHLY = monthly()
FACTS = """
facts AS (
  SELECT chain_id, product_id, category_id, period, 'SALES' AS metric_code, sales AS value FROM monthly WHERE sales IS NOT NULL
  UNION ALL SELECT chain_id, product_id, category_id, period, 'ORDER', orders FROM monthly WHERE orders IS NOT NULL
  UNION ALL SELECT chain_id, product_id, category_id, period, 'DELIVERY', delivery FROM monthly WHERE delivery IS NOT NULL)
"""
PANEL = f"""
spine AS (
  SELECT chain_id, product_id, category_id,
         CAST(unnest(generate_series(first_p, {ISSUE}, INTERVAL 1 MONTH)) AS DATE) AS period
  FROM (SELECT chain_id, product_id, category_id, min(period) AS first_p FROM monthly
        WHERE period <= {ISSUE} GROUP BY ALL)),
panel AS (
  SELECT s.*, m.sales, m.orders, m.delivery,
         row_number() OVER (PARTITION BY s.chain_id, s.product_id ORDER BY s.period) AS idx
  FROM spine s LEFT JOIN monthly m USING (chain_id, product_id, category_id, period))
"""
BASE = LINES.strip() + ",\n" + MONTHLY.strip()
PANEL_BASE = BASE + ",\n" + PANEL.strip()


def vals(
    source: str, sid: str, measure: str = "sales", order: str = "period", name: str = "vals", keep_zero: bool = True
) -> str:
    """Observed values from the first positive month, numbered from 1."""
    return f"""
{name} AS (
  SELECT sid, period, v, row_number() OVER (PARTITION BY sid ORDER BY period) AS idx,
         count(*) OVER (PARTITION BY sid) AS n
  FROM (SELECT {sid} AS sid, {order} AS period, {measure} AS v,
               min(CASE WHEN {measure} > 0 THEN {order} END) OVER (PARTITION BY {sid}) AS launch
        FROM {source} WHERE {measure} IS NOT NULL)
  WHERE {"launch IS NULL OR " if keep_zero else ""}period >= launch)
"""


BRAND_VALS = vals(f"(SELECT * FROM monthly WHERE period <= {ISSUE})", "chain_id || '|' || product_id")
PART_VALS = vals("part_monthly", "CAST(part_id AS VARCHAR)")
PART_BASE = LINES.strip() + ",\n" + monthly("part_id", "part_monthly").strip()

ISLANDS = """
runs AS (
  SELECT *, sum(CASE WHEN sales IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY chain_id, product_id ORDER BY idx) AS island
  FROM panel)
"""
ISLAND_VALS = ISLANDS.strip() + ",\n" + vals(
    "runs", "chain_id || '|' || product_id || '|' || island", keep_zero=False).strip()

STATES = """
st AS (
  SELECT a.sid, a.idx, a.v, a.v AS ses, a.v AS hl, b.v - a.v AS ht,
         CASE WHEN a.v > 0 THEN 1 ELSE 0 END AS seen, CASE WHEN a.v > 0 THEN a.v ELSE 0e0 END AS isize,
         CASE WHEN a.v > 0 THEN 1e0 ELSE 0e0 END AS ival, 1e0 AS gap,
         CASE WHEN a.v > 0 THEN 1e0 ELSE 0e0 END AS ip
  FROM vals a LEFT JOIN vals b ON b.sid = a.sid AND b.idx = 2 WHERE a.idx = 1
  UNION ALL
  SELECT x.sid, x.idx, x.v, 0.35e0 * x.v + 0.65e0 * s.ses,
         0.35e0 * x.v + 0.65e0 * (s.hl + s.ht),
         0.15e0 * (0.35e0 * x.v + 0.65e0 * (s.hl + s.ht) - s.hl) + 0.85e0 * s.ht,
         CASE WHEN s.seen = 1 OR x.v > 0 THEN 1 ELSE 0 END,
         CASE WHEN s.seen = 0 THEN CASE WHEN x.v > 0 THEN x.v ELSE 0e0 END
              WHEN x.v > 0 THEN 0.1e0 * x.v + 0.9e0 * s.isize ELSE s.isize END,
         CASE WHEN s.seen = 0 THEN CASE WHEN x.v > 0 THEN CAST(x.idx AS DOUBLE) ELSE 0e0 END
              WHEN x.v > 0 THEN 0.1e0 * s.gap + 0.9e0 * s.ival ELSE s.ival END,
         CASE WHEN s.seen = 0 OR x.v > 0 THEN 1e0 ELSE s.gap + 1e0 END,
         CASE WHEN s.seen = 0 THEN CASE WHEN x.v > 0 THEN 1e0 / x.idx ELSE 0e0 END
              ELSE 0.1e0 * CASE WHEN x.v > 0 THEN 1e0 ELSE 0e0 END + 0.9e0 * s.ip END
  FROM st s JOIN vals x ON x.sid = s.sid AND x.idx = s.idx + 1)
"""
HW = """
hw0 AS (
  SELECT sid, lvl, (m2 - lvl) / 12e0 AS tr, list_transform(f12, lambda q: q - lvl) AS seas
  FROM (SELECT sid, avg(v) FILTER (WHERE idx <= 12) AS lvl, avg(v) FILTER (WHERE idx BETWEEN 13 AND 24) AS m2,
               list(v ORDER BY idx) FILTER (WHERE idx <= 12) AS f12 FROM vals WHERE n >= 24 GROUP BY sid)),
hw AS (
  SELECT sid, CAST(0 AS BIGINT) AS idx, lvl, tr, seas FROM hw0
  UNION ALL
  SELECT sid, idx, lv2, 0.1e0 * (lv2 - lvl) + 0.9e0 * tr,
         list_transform(seas, lambda q, i: CASE WHEN i - 1 = (idx - 1) % 12 THEN 0.2e0 * (v - lv2) + 0.8e0 * q ELSE q END)
  FROM (SELECT h.sid, x.idx, h.lvl, h.tr, h.seas, x.v,
               0.3e0 * (x.v - h.seas[(x.idx - 1) % 12 + 1]) + 0.7e0 * (h.lvl + h.tr) AS lv2
        FROM hw h JOIN vals x ON x.sid = h.sid AND x.idx = h.idx + 1))
"""
REGS = """
regs AS (
  SELECT sid, n, sy, sxy, sxxy, sx, sxx, sx3, sx4,
         n * (sxx * sx4 - sx3 * sx3) - sx * (sx * sx4 - sx3 * sxx) + sxx * (sx * sx3 - sxx * sxx) AS det
  FROM (SELECT sid, CAST(idx AS DOUBLE) AS n, sum(v) OVER w AS sy, sum((idx - 1) * v) OVER w AS sxy,
               sum((idx - 1) * (idx - 1) * v) OVER w AS sxxy,
               CAST(sum(idx - 1) OVER w AS DOUBLE) AS sx, CAST(sum((idx - 1) ** 2) OVER w AS DOUBLE) AS sxx,
               CAST(sum((idx - 1) ** 3) OVER w AS DOUBLE) AS sx3, CAST(sum((idx - 1) ** 4) OVER w AS DOUBLE) AS sx4
        FROM vals WINDOW w AS (PARTITION BY sid ORDER BY idx)))
"""
MA = """
ma AS (
  SELECT sid, idx AS origin, k, 0 AS step, CAST(NULL AS DOUBLE) AS pred, buf
  FROM (SELECT sid, idx, 3 AS k, list(v) OVER (PARTITION BY sid ORDER BY idx ROWS 2 PRECEDING) AS buf FROM vals
        UNION ALL SELECT sid, idx, 6, list(v) OVER (PARTITION BY sid ORDER BY idx ROWS 5 PRECEDING) FROM vals
        UNION ALL SELECT sid, idx, 12, list(v) OVER (PARTITION BY sid ORDER BY idx ROWS 11 PRECEDING) FROM vals
        UNION ALL SELECT sid, idx, -3, list(v) OVER (PARTITION BY sid ORDER BY idx ROWS 2 PRECEDING) FROM vals)
  WHERE idx >= abs(k)
  UNION ALL
  SELECT sid, origin, k, step + 1, m, list_append(buf[2:], m)
  FROM (SELECT *, CASE WHEN k > 0 THEN list_sum(buf) / k
                       ELSE 0.2e0 * buf[1] + 0.3e0 * buf[2] + 0.5e0 * buf[3] END AS m FROM ma)
  WHERE step < 12)
"""
PATHS = ",\n".join(p.strip() for p in (STATES, HW, REGS, MA)) + """,
steps AS (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS step),
paths AS (
  SELECT sid, idx AS origin, 'Naive' AS model, step, v AS pred FROM st, steps
  UNION ALL
  SELECT o.sid, o.idx, 'Naive estacional', step, h.v FROM st o, steps, vals h
  WHERE h.sid = o.sid AND h.idx = o.idx - 12 + (step - 1) % 12 + 1 AND o.idx >= 12
  UNION ALL
  SELECT sid, origin, CASE k WHEN -3 THEN 'Media móvil ponderada' ELSE 'Media móvil ' || k END, step, pred FROM ma WHERE step > 0
  UNION ALL SELECT sid, idx, 'SES', step, ses FROM st, steps
  UNION ALL SELECT sid, idx, 'Holt', step, hl + ht * step FROM st, steps WHERE idx >= 3
  UNION ALL SELECT sid, idx, 'Holt-Winters', step, lvl + tr * step + seas[(idx + step - 1) % 12 + 1] FROM hw, steps WHERE idx >= 24
  UNION ALL
  SELECT sid, CAST(n AS BIGINT), 'Tendencia lineal', step,
         (sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n
         + (n * sxy - sx * sy) / (n * sxx - sx * sx) * (n + step - 1)
  FROM regs, steps WHERE n >= 3
  UNION ALL
  SELECT sid, CAST(n AS BIGINT), 'Tendencia polinómica', step,
         (sy * (sxx * sx4 - sx3 * sx3) - sx * (sxy * sx4 - sx3 * sxxy) + sxx * (sxy * sx3 - sxx * sxxy)) / det
         + (n * (sxy * sx4 - sx3 * sxxy) - sy * (sx * sx4 - sx3 * sxx) + sxx * (sx * sxxy - sxy * sxx)) / det * (n + step - 1)
         + (n * (sxx * sxxy - sxy * sx3) - sx * (sx * sxxy - sxy * sxx) + sy * (sx * sx3 - sxx * sxx)) / det * (n + step - 1) * (n + step - 1)
  FROM regs, steps WHERE n >= 4
  UNION ALL SELECT sid, idx, 'Croston', step, CASE WHEN seen = 1 THEN isize / greatest(ival, 1e-9) ELSE 0e0 END FROM st, steps
  UNION ALL SELECT sid, idx, 'SBA', step, CASE WHEN seen = 1 THEN isize / greatest(ival, 1e-9) * 0.95e0 ELSE 0e0 END FROM st, steps
  UNION ALL SELECT sid, idx, 'TSB', step, CASE WHEN seen = 1 THEN ip * isize ELSE 0e0 END FROM st, steps)
"""
