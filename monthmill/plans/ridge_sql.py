"""SQL statements of the pooled ridge: features, folds, normal equations and their solution by elimination."""

from __future__ import annotations

from monthmill.operators.pooled import FEATURES, MIN_TRAIN, RIDGE
from monthmill.plans.sql_parts import ISSUE

K = len(FEATURES)
SERIES = "chain_id, product_id"
W = f"PARTITION BY {SERIES} ORDER BY idx"

_ROLL = ", ".join(
    f"avg(sales) OVER r{w} AS mean_{w}, stddev_pop(sales) OVER r{w} AS std_{w}, min(sales) OVER r{w} AS min_{w}, max(sales) OVER r{w} AS max_{w}"
    for w in (3, 6, 12)
)
_LAGS = ", ".join(f"lag(sales, {k - 1}) OVER w AS lag_{k}" for k in (2, 3, 6, 12))

FEATURE_SQL = f"""
raw AS (SELECT chain_id, product_id, category_id, period, idx, sales, sales AS lag_1, {_LAGS}, {_ROLL},
    lag(sales, 1) OVER w AS p1, lag(sales, 11) OVER w AS p11, count(sales) OVER a AS n1, count(sales) OVER b AS n2,
    first_value(sales IGNORE NULLS) OVER a AS f1, last_value(sales IGNORE NULLS) OVER a AS l1, first_value(sales IGNORE NULLS) OVER b AS f2, last_value(sales IGNORE NULLS) OVER b AS l2,
    max(CASE WHEN sales > 0 THEN idx END) OVER w AS lst, min(CASE WHEN sales > 0 THEN idx END) OVER w AS fst, count(*) FILTER (WHERE sales > 0) OVER w AS hits,
    count(*) FILTER (WHERE sales = 0) OVER w AS zeros, count(sales) OVER w AS obs
  FROM panel WINDOW w AS ({W}), a AS ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), b AS ({W} ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING),
    {', '.join(f'r{w} AS ({W} ROWS {w - 1} PRECEDING)' for w in (3, 6, 12))}),
feat AS (SELECT *, idx - 1 AS position, obs AS age, sales / nullif(p1, 0) - 1 AS mom, sales / nullif(p11, 0) - 1 AS yoy,
    CASE WHEN n1 > 1 THEN (l1 - f1) / greatest(1, n1 - 1) END AS slope,
    CASE WHEN n1 > 1 THEN (l1 - f1) / greatest(1, n1 - 1) END - CASE WHEN n2 > 1 THEN (l2 - f2) / greatest(1, n2 - 1) END AS acceleration,
    coalesce(idx - lst, idx) AS months_since_sale, zeros AS zero_months, coalesce(hits / nullif(obs, 0), 0e0) AS movement_share,
    CASE WHEN hits > 1 THEN (lst - fst) / (hits - 1) END AS mean_interval FROM raw),
ahead AS (SELECT f.*, CAST(h AS INTEGER) AS horizon, CAST(period + to_months(CAST(h AS INTEGER)) AS DATE) AS target,
    lead(sales, CAST(h AS INTEGER)) OVER (PARTITION BY {SERIES}, h ORDER BY idx) AS label FROM feat f, (SELECT unnest(range(1, 13)) AS h)),
dated AS (SELECT *, year(target) AS year, month(target) AS month, quarter(target) AS quarter, sin(2 * pi() * month(target) / 12) AS sin_month, cos(2 * pi() * month(target) / 12) AS cos_month,
    year(target) * 12 + month(target) - 1 AS t, chain_id || '|' || product_id AS sid FROM ahead),
rw AS (SELECT chain_id, product_id, sid, period AS issue, target, horizon, t, label, row_number() OVER (ORDER BY sid, horizon, t) AS rid,
    [{', '.join(f'CAST({f} AS DOUBLE)' for f in FEATURES)}] AS xs FROM dated WHERE (label IS NOT NULL AND idx >= 2) OR period = {ISSUE}),
cnt AS (SELECT *, sum(n) OVER (PARTITION BY horizon ORDER BY t) - n AS before, row_number() OVER (PARTITION BY horizon ORDER BY t DESC) AS back, count(*) OVER (PARTITION BY horizon) AS months
  FROM (SELECT horizon, t, count(*) AS n FROM rw WHERE label IS NOT NULL GROUP BY ALL))
"""


def _numbered(source: str) -> str:
    return f"folds AS (SELECT *, row_number() OVER (ORDER BY horizon, t) AS fold FROM ({source}))"


FUTURE_FOLDS = _numbered(
    f"SELECT h AS horizon, year({ISSUE}) * 12 + month({ISSUE}) - 1 + h AS t FROM (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS h)")


def last_folds(last: int) -> str:
    return _numbered(
        f"SELECT horizon, t FROM cnt WHERE before >= {MIN_TRAIN} AND back <= CASE WHEN months > 4 THEN least({last}, months - 4) ELSE months END")


def valid_folds(last: int, horizons: str = "horizon") -> str:
    return _numbered(
        f"SELECT horizon, t FROM cnt WHERE before >= {MIN_TRAIN} AND horizon IN ({horizons}) QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY t DESC) <= {last}")


def valid_and_future_folds(last: int) -> str:
    """The folds of the records and, behind them, those of the months after the issue month."""
    past = f"SELECT horizon, t FROM cnt WHERE before >= {MIN_TRAIN} QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY t DESC) <= {last}"
    return _numbered(f"SELECT horizon, t FROM ({past}) UNION ALL SELECT h, year({ISSUE}) * 12 + month({ISSUE}) - 1 + h FROM (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS h)")


# d holds 1, the standardised values, the missing flags, and the label last
RIDGE_SQL = f"""
tr AS (SELECT f.fold, r.* FROM folds f JOIN rw r ON r.horizon = f.horizon AND r.t < f.t AND r.label IS NOT NULL),
lg AS (SELECT fold, unnest(xs) AS v, unnest(range(1, {K + 1})) AS j FROM tr),
md AS (SELECT fold, j, coalesce(median(v), 0e0) AS md FROM lg GROUP BY ALL),
mo AS (SELECT fold, j, md, avg(coalesce(v, md)) AS mu, CASE WHEN stddev_pop(coalesce(v, md)) < 1e-9 THEN 1e0 ELSE stddev_pop(coalesce(v, md)) END AS sd
  FROM lg JOIN md USING (fold, j) GROUP BY fold, j, md),
sc AS (SELECT fold, list(md ORDER BY j) AS mds, list(mu ORDER BY j) AS mus, list(sd ORDER BY j) AS sds FROM mo GROUP BY fold),
dz AS (SELECT tr.fold, rid, sid, list_concat([1e0], list_transform(range(1, {K + 1}), lambda j: (coalesce(xs[j], mds[j]) - mus[j]) / sds[j]),
    list_transform(xs, lambda v: CASE WHEN v IS NULL THEN 1e0 ELSE 0e0 END), [label]) AS d FROM tr JOIN sc ON sc.fold = tr.fold),
cl AS (SELECT fold, rid, sid, unnest(d) AS v, unnest(range(1, {2 * K + 3})) AS c FROM dz),
cv AS (SELECT fold, c, list(v ORDER BY rid) AS vs FROM cl GROUP BY ALL),
gm AS (SELECT a.fold, a.c AS i, b.c AS j, list_dot_product(a.vs, b.vs) AS g FROM cv a JOIN cv b ON b.fold = a.fold AND b.c >= a.c),
bs AS (SELECT fold, sid, c, sum(v) AS s FROM cl GROUP BY ALL),
sn AS (SELECT fold, sid, s AS n, {RIDGE}e0 * (s / tot) * (1 - s / tot) AS pen FROM (SELECT *, sum(s) OVER (PARTITION BY fold) AS tot FROM bs WHERE c = 1)),
sw AS (SELECT fold, sid, CASE WHEN pen > 1e-18 THEN 1 / (n + pen) ELSE 0e0 END AS w, pen, n FROM sn),
tk AS (SELECT a.fold, a.c AS i, b.c AS j, sum(a.s * b.s * w) AS g FROM bs a JOIN sw USING (fold, sid) JOIN bs b ON b.fold = a.fold AND b.sid = a.sid AND b.c >= a.c GROUP BY ALL),
up AS (SELECT fold, i, j, gm.g - tk.g + CASE WHEN i = j AND i > 1 THEN {RIDGE}e0 ELSE 0e0 END AS m FROM gm JOIN tk USING (fold, i, j)),
mt AS (SELECT fold, i, list(m ORDER BY j) AS line FROM (SELECT fold, i, j, m FROM up UNION ALL SELECT fold, j, i, m FROM up WHERE i < j) WHERE i <= {2 * K + 1} GROUP BY ALL),
gj(fold, k, i, line) AS (SELECT fold, 0, i, line FROM mt UNION ALL
  SELECT fold, k + 1, i, CASE WHEN i = k + 1 THEN list_transform(line, lambda x: x / line[k + 1])
    ELSE list_transform(range(1, {2 * K + 3}), lambda c: line[c] - line[k + 1] / p[k + 1] * p[c]) END
  FROM (SELECT *, max(CASE WHEN i = k + 1 THEN line END) OVER (PARTITION BY fold) AS p FROM gj WHERE k < {2 * K + 1})),
cf AS (SELECT fold, i AS c, line[{2 * K + 2}] AS b FROM gj WHERE k = {2 * K + 1}),
co AS (SELECT fold, list(b ORDER BY c) AS coefs FROM cf GROUP BY fold),
ef AS (SELECT fold, sid, any_value(w) * sum(CASE WHEN c = {2 * K + 2} THEN s ELSE -s * coalesce(b, 0e0) END) AS e, any_value(n) AS n
  FROM bs JOIN sw USING (fold, sid) LEFT JOIN cf USING (fold, c) GROUP BY fold, sid),
ts AS (SELECT f.fold, r.* FROM folds f JOIN rw r ON r.horizon = f.horizon AND r.t = f.t),
ml AS (SELECT ts.chain_id, ts.product_id, ts.sid, ts.issue, ts.target, ts.horizon, ts.label AS actual,
    greatest(0e0, list_dot_product(coefs, list_concat([1e0], list_transform(range(1, {K + 1}), lambda j: (coalesce(xs[j], mds[j]) - mus[j]) / sds[j]),
      list_transform(xs, lambda v: CASE WHEN v IS NULL THEN 1e0 ELSE 0e0 END))) + coalesce(e, 0e0)) AS pred
  FROM ts JOIN sc ON sc.fold = ts.fold JOIN co ON co.fold = ts.fold LEFT JOIN ef ON ef.fold = ts.fold AND ef.sid = ts.sid)
"""

IMPORTANCE_SQL = f"""
names AS (SELECT unnest([{', '.join(f"'{f}'" for f in FEATURES)}]) AS feature, unnest(range(2, {K + 2})) AS c),
wt AS (SELECT horizon, coalesce(feature, 'missing') AS feature, abs(b) AS w FROM cf JOIN folds USING (fold) LEFT JOIN names USING (c) WHERE c > 1
  UNION ALL SELECT horizon, 'product|' || sid, abs(e) * sqrt(greatest(0e0, n / tot * (1 - n / tot))) FROM (SELECT *, sum(n) OVER (PARTITION BY fold) AS tot FROM ef) JOIN folds USING (fold)),
im AS (SELECT horizon, feature, coalesce(w / nullif(sum(w) OVER (PARTITION BY horizon), 0), 0e0) AS importance FROM wt)
"""
