"""Reference SQL for DuckDB, one statement per registered query."""

from __future__ import annotations

import math


def up(value: str, digits: int = 0) -> str:
    """Round half away from zero, as a double."""
    scale = f"1e{digits}"
    return f"(sign({value}) * floor(abs({value}) * {scale} + 0.5) / {scale})"


def dbl(value: str) -> str:
    return f"CAST({value} AS DOUBLE)"


def cash(value: str, digits: int = 2) -> str:
    """Exact decimal sum, rounded and handed out as a double."""
    return dbl(f"round({value}, {digits})")


def pct(part: str, whole: str) -> str:
    return f"({dbl(part)} * 100.0 / nullif({dbl(whole)}, 0))"


def avg(column: str) -> str:
    return f"({dbl(f'sum({column})')} / nullif({dbl(f'count({column})')}, 0))"


BASE = """
WITH geo AS (
  SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey
), sup AS (
  SELECT s_suppkey AS supplier_id, s_name AS supplier_name, r_name AS category, n_name AS country,
    CASE s_suppkey % 3 WHEN 0 THEN 'Net 30' WHEN 1 THEN 'Net 45' ELSE 'Net 60' END AS payment_terms,
    CASE WHEN r_name = 'AFRICA' THEN 'NGN' ELSE 'USD' END AS currency,
    CAST(3.0 AS DOUBLE) + CAST(s_suppkey % 21 AS DOUBLE) / CAST(10.0 AS DOUBLE) AS quality_rating,
    s_acctbal >= 0 AS is_approved,
    CASE WHEN s_acctbal < 1000 THEN 'High' WHEN s_acctbal < 5000 THEN 'Medium' ELSE 'Low' END AS risk_level
  FROM supplier LEFT JOIN geo ON s_nationkey = n_nationkey
), mat AS (
  SELECT p_partkey AS material_id, p_name AS material_name, p_type AS category,
    CASE p_size % 4 WHEN 0 THEN 'PCS' WHEN 1 THEN 'KG' WHEN 2 THEN 'LTR' ELSE 'BOX' END AS unit_of_measure,
    CAST(p_retailprice AS DECIMAL(18,2)) AS standard_price_ngn, p_size AS lead_time_days
  FROM part
), po AS (
  SELECT l_orderkey AS po_number, CAST(o_orderdate AS DATE) AS po_date, l_suppkey AS supplier_id,
    s.supplier_name, l_partkey AS material_id, p_name AS material_name, p_type AS category,
    CAST(l_quantity AS DECIMAL(18,3)) AS quantity,
    CAST(floor(l_extendedprice / nullif(l_quantity, 0) * 100 + 0.5) / 100 AS DECIMAL(18,2)) AS unit_price_ngn,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS total_amount_ngn,
    CASE WHEN s.currency = 'USD'
      THEN CAST(floor(l_extendedprice / (800 + l_orderkey % 801) * 100 + 0.5) / 100 AS DECIMAL(18,2)) END
      AS total_amount_usd,
    s.currency, CAST(o_orderdate AS DATE) + p_size AS expected_delivery_date,
    CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) END AS actual_delivery_date,
    CASE WHEN l_linestatus = 'F' THEN 'Delivered' ELSE 'Pending' END AS delivery_status,
    CASE o_orderstatus WHEN 'F' THEN 'Paid' WHEN 'O' THEN 'Pending' WHEN 'P' THEN 'Overdue' END AS payment_status,
    c_mktsegment AS buyer, g.r_name AS plant_location
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN sup s ON l_suppkey = s.supplier_id
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN geo g ON c_nationkey = g.n_nationkey
), inc AS (
  SELECT 'QI-' || l_orderkey || '-' || l_partkey || '-' || l_suppkey AS incident_id, l_orderkey AS po_number,
    l_suppkey AS supplier_id,
    CASE l_linenumber % 3 WHEN 0 THEN 'Quality Defect' WHEN 1 THEN 'Contamination' ELSE 'Wrong Spec' END
      AS incident_type,
    CASE WHEN l_discount >= 0.07 THEN 'High' WHEN l_discount >= 0.03 THEN 'Medium' ELSE 'Low' END AS severity,
    CAST(floor(l_extendedprice * l_discount * 100 + 0.5) / 100 AS DECIMAL(18,2)) AS cost_impact_ngn
  FROM lineitem WHERE l_returnflag = 'R' AND l_tax >= 0.08
)"""

ON_TIME = "sum(CASE WHEN actual_delivery_date <= expected_delivery_date THEN 1 ELSE 0 END)"
LATE = "sum(CASE WHEN actual_delivery_date > expected_delivery_date THEN 1 ELSE 0 END)"
OTD = up(pct(ON_TIME, "count(actual_delivery_date)"), 2)

PERF = f""", so AS (
  SELECT supplier_id, count(DISTINCT po_number) AS total_orders, sum(total_amount_ngn) AS spend,
    {up(avg("total_amount_ngn"), 2)} AS avg_order_value, {OTD} AS otd
  FROM po GROUP BY supplier_id
), si AS (
  SELECT supplier_id, count(DISTINCT incident_id) AS incidents, sum(cost_impact_ngn) AS cost
  FROM inc GROUP BY supplier_id
), perf AS (
  SELECT s.supplier_id, s.supplier_name, s.category, s.country, s.risk_level, s.quality_rating,
    coalesce(total_orders, 0) AS total_orders, {cash("spend")} AS total_spend_ngn, avg_order_value,
    otd AS on_time_delivery_pct, coalesce(incidents, 0) AS quality_incidents,
    {cash("coalesce(cost, 0)")} AS total_quality_cost
  FROM sup s LEFT JOIN so USING (supplier_id) LEFT JOIN si USING (supplier_id)
)"""

GRADED = """, graded AS (
  SELECT supplier_id, supplier_name, category, country, total_orders, total_spend_ngn, on_time_delivery_pct,
    quality_incidents, total_quality_cost,
    CASE WHEN coalesce(on_time_delivery_pct, 0) >= 95 AND quality_incidents <= 1 THEN 'A'
      WHEN coalesce(on_time_delivery_pct, 0) >= 90 AND quality_incidents <= 2 THEN 'B'
      WHEN coalesce(on_time_delivery_pct, 0) >= 80 AND quality_incidents <= 4 THEN 'C'
      WHEN coalesce(on_time_delivery_pct, 0) >= 70 AND quality_incidents <= 6 THEN 'D' ELSE 'E' END
      AS performance_grade
  FROM perf WHERE total_orders > 0
)"""


def over(spend: str, average: str, lowest: str) -> str:
    return up(f"({dbl(spend)} * ({average} - {lowest}) / nullif({average}, 0))")


def price_ctes(source: str = "po") -> str:
    return f""", raw_prices AS (
  SELECT material_name, category, count(DISTINCT supplier_id) AS supplier_count,
    {dbl("min(unit_price_ngn)")} AS lo, {avg("unit_price_ngn")} AS av, {dbl("max(unit_price_ngn)")} AS hi,
    sum(total_amount_ngn) AS spend
  FROM {source} GROUP BY material_name, category
), prices AS (
  SELECT material_name, category, supplier_count, {up("lo", 2)} AS min_price, {up("av", 2)} AS avg_price,
    {up("hi", 2)} AS max_price, {up("((hi - lo) / nullif(lo, 0) * 100)", 2)} AS price_variance_pct,
    {up("((av - lo) / nullif(lo, 0) * 100)", 2)} AS overpayment_pct, {over("spend", "av", "lo")} AS potential_savings_ngn
  FROM raw_prices
)"""


PRICES = price_ctes()
TOP_PRICES = """, top_prices AS (
  SELECT * FROM prices WHERE supplier_count > 1 AND potential_savings_ngn > 0
  ORDER BY potential_savings_ngn DESC, material_name, category LIMIT 20
)"""

OPPORTUNITIES = f""", raw_opp AS (
  SELECT category, supplier_name, count(*) AS order_count, {avg("unit_price_ngn")} AS av,
    {dbl("min(unit_price_ngn)")} AS lo, sum(total_amount_ngn) AS spend
  FROM po GROUP BY category, supplier_name
), opp AS (
  SELECT category, supplier_name, order_count, {up("av", 2)} AS avg_price_paid, {up("lo", 2)} AS best_price,
    {up("((av - lo) / nullif(lo, 0) * 100)", 2)} AS potential_savings_pct,
    {over("spend", "av", "lo")} AS potential_savings_ngn
  FROM raw_opp
), opportunities AS (SELECT * FROM opp WHERE order_count > 5 AND potential_savings_pct > 5)"""

RATES = f""", fx AS (
  SELECT po_date, total_amount_usd, {dbl("total_amount_ngn")} / nullif({dbl("total_amount_usd")}, 0) AS rate
  FROM po WHERE currency = 'USD' AND total_amount_usd > 0
)"""

MAVERICK = """, flagged AS (SELECT * FROM sup WHERE NOT is_approved OR risk_level = 'High')"""

SPREAD = f""", spread AS (
  SELECT category, count(DISTINCT supplier_id) AS supplier_count, sum(total_amount_ngn) AS spend
  FROM po GROUP BY category
), merged AS (
  SELECT category, supplier_count, {cash("spend", 0)} AS total_spend,
    {up(f"({dbl('spend')} / supplier_count)")} AS spend_per_supplier,
    {up(f"({dbl('spend')} * 0.06::DOUBLE)", 2)} AS consolidation_savings_ngn
  FROM spread WHERE supplier_count > 8
)"""

WEAK = "(on_time_delivery_pct < 80 OR quality_incidents > 2) AND total_orders > 5"


def cents_sum(column: str) -> str:
    return f"coalesce({dbl(f'sum(CAST({column} AS DECIMAL(28,2)))')}, 0)"


METRICS = f""", inc_po AS (
  SELECT po_number, supplier_id, count(DISTINCT incident_id) AS incidents, sum(cost_impact_ngn) AS cost
  FROM inc GROUP BY po_number, supplier_id
), bridge AS (SELECT DISTINCT category, supplier_id, po_number FROM po), inc_cat AS (
  SELECT b.category, b.supplier_id, sum(i.incidents) AS incidents, sum(i.cost) AS cost
  FROM bridge b JOIN inc_po i ON b.po_number = i.po_number AND b.supplier_id = i.supplier_id
  GROUP BY b.category, b.supplier_id
), sums AS (
  SELECT category, supplier_id, supplier_name, sum(quantity) AS q, sum(total_amount_ngn) AS spend,
    {OTD} AS otd, count(DISTINCT po_number) AS total_orders
  FROM po GROUP BY category, supplier_id, supplier_name
), metrics AS (
  SELECT m.category, m.supplier_id, m.supplier_name, s.risk_level, {cash("q")} AS total_quantity,
    {cash("spend")} AS total_spend_ngn, {up(f"({dbl('spend')} / nullif({dbl('q')}, 0))", 4)} AS avg_unit_cost_ngn,
    otd AS on_time_delivery_pct, CAST(coalesce(incidents, 0) AS BIGINT) AS quality_incident_count,
    {cash("coalesce(cost, 0)")} AS total_quality_cost_ngn, total_orders
  FROM sums m JOIN sup s ON m.supplier_id = s.supplier_id
  LEFT JOIN inc_cat c ON c.category = m.category AND c.supplier_id = m.supplier_id
  WHERE round(q, 2) > 0
), history AS (
  SELECT category, {cash("sum(quantity)")} AS category_quantity, {cash("sum(total_amount_ngn)")} AS category_spend_ngn,
    {up(f"({dbl('sum(total_amount_ngn)')} / nullif({dbl('sum(quantity)')}, 0))", 4)} AS category_avg_unit_cost
  FROM po GROUP BY category
)"""


def _scale(column: str, inverted: bool) -> str:
    low, high = f"min({column}) OVER c", f"max({column}) OVER c"
    position = f"({column} - {low}) / ({high} - {low})"
    return (
        f"CASE WHEN {low} IS NULL OR {low} = {high} THEN CAST(1.0 AS DOUBLE) "
        f"ELSE {'1 - ' if inverted else ''}{position} END"
    )


ALLOCATION = f"""{METRICS}, scores AS (
  SELECT *, {_scale("avg_unit_cost_ngn", True)} AS cost_score, {_scale("on_time_delivery_pct", False)} AS delivery_score,
    {_scale("total_quality_cost_ngn", True)} AS quality_score,
    CAST(CASE risk_level WHEN 'Low' THEN 1.0 WHEN 'Medium' THEN 0.6 WHEN 'High' THEN 0.2 ELSE 0.4 END AS DOUBLE)
      AS risk_score
  FROM metrics WINDOW c AS (PARTITION BY category)
), composed AS (
  SELECT *, 0.45::DOUBLE * cost_score + 0.3::DOUBLE * delivery_score + 0.15::DOUBLE * quality_score
    + 0.1::DOUBLE * risk_score AS composite
  FROM scores
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY composite DESC, supplier_id, supplier_name) AS place
  FROM composed WHERE composite IS NOT NULL
), base_share AS (
  SELECT *, greatest(CASE WHEN sum(composite) OVER c > 0 THEN composite / sum(composite) OVER c
    ELSE 1.0::DOUBLE / count(*) OVER c END, 0.15::DOUBLE) AS raised
  FROM placed WHERE place <= 3 WINDOW c AS (PARTITION BY category)
), shared AS (
  SELECT *, raised / sum(raised) OVER (PARTITION BY category) AS share FROM base_share
), allocated AS (
  SELECT s.*, h.category_quantity, h.category_spend_ngn, h.category_avg_unit_cost,
    share * category_quantity AS pq, share * category_quantity * avg_unit_cost_ngn AS ps
  FROM shared s JOIN history h ON s.category = h.category
)"""

OPT_SAVINGS = """, projected AS (SELECT category, sum(ps) AS ps FROM allocated GROUP BY category), opt AS (
  SELECT sum(h.category_spend_ngn) AS before, sum(coalesce(p.ps, h.category_spend_ngn)) AS after
  FROM history h LEFT JOIN projected p ON h.category = p.category
)"""


def sourcing_ctes(
    otd: float, incidents: float, risk: int, price: float, threshold: float, cap: float, strict: bool = False
) -> str:
    """Step by step: eligible, fallback, price band, fallback, one or two sources."""
    primary = min(0.65, cap)
    limit = f"least({{}}, {cap}::DOUBLE)" if strict else "{}"
    return f"""{METRICS}, ranked AS (
  SELECT *, CASE risk_level WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 ELSE 3 END AS risk_numeric
  FROM metrics
), strict_pool AS (
  SELECT * FROM ranked WHERE on_time_delivery_pct >= {otd} AND quality_incident_count <= {incidents}
    AND risk_numeric <= {risk}
), cheapest AS (
  SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY category ORDER BY avg_unit_cost_ngn, supplier_id) = 1
), pool AS (
  SELECT * FROM strict_pool
  UNION ALL SELECT * FROM cheapest WHERE category NOT IN (SELECT category FROM strict_pool)
), limits AS (
  SELECT category, max(avg_unit_cost_ngn) - (1.0::DOUBLE - {price}::DOUBLE) *
    CASE WHEN max(avg_unit_cost_ngn) > min(avg_unit_cost_ngn)
      THEN max(avg_unit_cost_ngn) - min(avg_unit_cost_ngn) ELSE 1.0::DOUBLE END AS price_limit
  FROM pool GROUP BY category
), band AS (
  SELECT p.* FROM pool p JOIN limits l ON p.category = l.category WHERE avg_unit_cost_ngn <= price_limit
), qualified AS (
  SELECT * FROM band
  UNION ALL
  SELECT * FROM (SELECT * FROM pool WHERE category NOT IN (SELECT category FROM band)
    QUALIFY row_number() OVER (PARTITION BY category ORDER BY avg_unit_cost_ngn, supplier_id) = 1)
), placed AS (
  SELECT q.*, h.category_quantity, h.category_spend_ngn,
    row_number() OVER (PARTITION BY q.category ORDER BY avg_unit_cost_ngn, supplier_id) AS place,
    h.category_spend_ngn > {threshold} AND count(*) OVER (PARTITION BY q.category) > 1 AS dual
  FROM qualified q JOIN history h ON q.category = h.category
), picked AS (
  SELECT *, {limit.format(f"CASE WHEN NOT dual THEN 1.0::DOUBLE WHEN place = 1 THEN {primary}::DOUBLE ELSE 1.0::DOUBLE - {primary}::DOUBLE END")}
    AS share FROM placed WHERE place = 1 OR (dual AND place = 2)
), sourced AS (SELECT *, share * category_quantity AS pq, share * category_quantity * avg_unit_cost_ngn AS ps FROM picked)"""


# Thresholds that reach every branch at the size of the check.
RULE_ARGS = {
    "standard": (70, 5, 2, 0.8, 5e10, 0.8),
    "conservative": (80, 3, 1, 0.9, 3e10, 0.65),
    "aggressive": (60, 10, 2, 0.7, 1e11, 0.9),
    "mixed": (60, 2, 0, 0.8, 5.2e8, 0.8),
    "dual": (55, 5, 1, 0.8, 1e8, 0.8),
}

SOURCING_SELECT = f"""
SELECT category, supplier_id, supplier_name, total_quantity, total_spend_ngn, avg_unit_cost_ngn, on_time_delivery_pct,
  quality_incident_count, total_quality_cost_ngn, total_orders, risk_level, risk_numeric,
  {up("share", 6)} AS constrained_share, {up("pq", 2)} AS projected_quantity, {up("ps")} AS projected_spend_ngn,
  category_spend_ngn AS historical_category_spend_ngn, CAST(dual AS INTEGER) AS dual_sourced
FROM sourced"""


def sourcing_totals(strict: bool = False) -> str:
    rest = " + (1.0::DOUBLE - sum(share)) * category_spend_ngn" if strict else ""
    return f""", per_cat AS (
  SELECT category, category_spend_ngn AS spend, sum(ps){rest} AS after, sum(CAST(dual AS INTEGER)) AS dual
  FROM sourced GROUP BY category, category_spend_ngn
), con AS (SELECT sum(spend) AS before, sum(after) AS after, sum(dual) AS dual FROM per_cat)"""


CON_SELECT = f"""
SELECT {up("after")} AS constrained_spend_ngn, {up("greatest(0, before - after)")} AS constrained_savings_ngn,
  {up(pct("greatest(0, before - after)", "before"), 4)} AS constrained_savings_pct,
  CAST(dual AS BIGINT) AS dual_sourced_categories
FROM con"""

COMPONENTS = f"""{PERF}{PRICES}{TOP_PRICES}{SPREAD}, parts AS (
  SELECT category, potential_savings_ngn AS price, 0::DOUBLE AS performance, 0::DOUBLE AS consolidation FROM top_prices
  UNION ALL
  SELECT category, 0, {cents_sum("total_quality_cost")} + {cents_sum("total_spend_ngn")} * 0.03::DOUBLE, 0
  FROM perf WHERE {WEAK} GROUP BY category
  UNION ALL
  SELECT category, 0, 0, consolidation_savings_ngn FROM merged
), factors(scenario, fp, fq, fc) AS (
  VALUES ('Conservative', 0.7::DOUBLE, 0.65::DOUBLE, 0.6::DOUBLE), ('Base', 1.0, 1.0, 1.0),
    ('Aggressive', 1.2, 1.15, 1.25)
), scaled AS (
  SELECT scenario, category, sum(price) * fp AS price, sum(performance) * fq AS performance,
    sum(consolidation) * fc AS consolidation
  FROM parts CROSS JOIN factors GROUP BY scenario, category, fp, fq, fc
)"""


def scenario_select(keys: str, group: str) -> str:
    total = "(sum(price) + sum(performance) + sum(consolidation))"
    return f"""
SELECT {keys}, {up("sum(price)", 2)} AS price_standardization_savings_ngn,
  {up("sum(performance)", 2)} AS performance_improvement_savings_ngn,
  {up("sum(consolidation)", 2)} AS consolidation_savings_ngn, {up(total, 2)} AS total_savings_ngn,
  {up(pct(total, "(SELECT sum(total_amount_ngn) FROM po)"), 4)} AS savings_pct_of_spend
FROM scaled GROUP BY {group}"""


INSIGHTS = f"""{COMPONENTS}{RATES}{MAVERICK}{sourcing_ctes(*RULE_ARGS["standard"]).replace("placed AS", "source_placed AS").replace("FROM placed", "FROM source_placed")}{sourcing_totals()}
{ALLOCATION.removeprefix(METRICS)}{OPT_SAVINGS}, v AS (
  SELECT {cash("(SELECT sum(total_amount_ngn) FROM po)")} AS spend,
    (SELECT {cents_sum("potential_savings_ngn")} FROM top_prices) AS price,
    (SELECT {up(f"({cents_sum('total_quality_cost')} + {cents_sum('total_spend_ngn')} * 0.03::DOUBLE)", 2)}
      FROM perf WHERE {WEAK}) AS performance,
    (SELECT {cents_sum("consolidation_savings_ngn")} FROM merged) AS consolidation,
    (SELECT {up("greatest(0, before - after)")} FROM opt) AS optimization,
    (SELECT {up(pct("greatest(0, before - after)", "before"), 4)} FROM opt) AS optimization_pct,
    (SELECT {up("greatest(0, before - after)")} FROM con) AS constrained,
    (SELECT {up(pct("greatest(0, before - after)", "before"), 4)} FROM con) AS constrained_pct,
    (SELECT {cash("coalesce(sum(total_amount_ngn), 0)")} FROM po JOIN flagged USING (supplier_id)) AS maverick,
    (SELECT {cash("coalesce(sum(total_amount_usd), 0)")} FROM fx) AS usd,
    (SELECT {up("((max(rate) - min(rate)) / min(rate) * 100)", 6)} FROM fx) AS volatility
), insights AS (
  SELECT 'Total Spend' AS metric, spend AS value, 'NGN' AS unit FROM v
  UNION ALL SELECT 'Price Standardization Savings', price, 'NGN' FROM v
  UNION ALL SELECT 'Supplier Performance Savings', performance, 'NGN' FROM v
  UNION ALL SELECT 'Supplier Consolidation Savings', consolidation, 'NGN' FROM v
  UNION ALL SELECT 'Optimization Savings', optimization, 'NGN' FROM v
  UNION ALL SELECT 'Total Savings Potential', {up("(price + performance + consolidation)", 2)}, 'NGN' FROM v
  UNION ALL SELECT 'Savings Percentage', {up(pct("(price + performance + consolidation)", "spend"), 4)}, 'percent' FROM v
  UNION ALL SELECT 'Optimization Savings Percentage', optimization_pct, 'percent' FROM v
  UNION ALL SELECT 'Constrained Savings', constrained, 'NGN' FROM v
  UNION ALL SELECT 'Constrained Savings Percentage', constrained_pct, 'percent' FROM v
  UNION ALL SELECT 'Maverick Spend', maverick, 'NGN' FROM v
  UNION ALL SELECT 'USD Spend', usd, 'USD' FROM v
  UNION ALL SELECT 'FX Volatility', volatility, 'percent' FROM v
)"""

# Expected normalized tables for the raw tables of the check.
CLEAN = """, n_sup AS (
  SELECT CAST(supplier_id AS VARCHAR) AS supplier_id, supplier_name, category, country, 'Net 30' AS payment_terms,
    CASE WHEN supplier_id % 5 <> 0 THEN lower(currency) END AS currency,
    CASE WHEN supplier_id % 7 = 0 THEN 4.0::DOUBLE ELSE quality_rating END AS quality_rating,
    supplier_id % 6 NOT IN (1, 3) AS is_approved,
    CASE supplier_id % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Low' ELSE 'Medium' END AS risk_level
  FROM sup
), n_sup_all AS (
  SELECT * FROM n_sup
  UNION ALL SELECT * REPLACE (supplier_name || ' (old)' AS supplier_name) FROM n_sup WHERE CAST(supplier_id AS BIGINT) % 10 = 0
  UNION ALL SELECT * REPLACE (NULL AS supplier_name) FROM n_sup WHERE CAST(supplier_id AS BIGINT) % 15 = 0
  UNION ALL SELECT * FROM n_sup WHERE CAST(supplier_id AS BIGINT) % 7 = 0
), n_mat AS (
  SELECT CAST(material_id AS VARCHAR) AS material_id, material_name, category, 'PCS' AS unit_of_measure,
    CASE WHEN material_id % 9 = 0 THEN 0 ELSE standard_price_ngn END AS standard_price_ngn,
    CASE WHEN material_id % 8 = 0 THEN 30 WHEN material_id % 11 = 0 THEN 14 ELSE lead_time_days END AS lead_time_days
  FROM mat
), n_mat_all AS (
  SELECT * FROM n_mat
  UNION ALL SELECT * REPLACE (NULL AS material_name) FROM n_mat WHERE CAST(material_id AS BIGINT) % 12 = 0
), raw_po AS (
  SELECT l_orderkey AS k, l_linenumber AS line, CAST(o_orderdate AS DATE) AS d, l_suppkey, l_partkey, p_type,
    CAST(CASE WHEN l_orderkey % 41 = 0 THEN 0 ELSE l_quantity END AS DECIMAL(18,3)) AS q,
    CASE WHEN l_orderkey % 37 = 0 THEN 0
      ELSE CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS DECIMAL(18,2)) END AS price,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, l_linestatus, CAST(l_shipdate AS DATE) AS shipped, o_orderstatus
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
), twice AS (SELECT * FROM raw_po UNION ALL SELECT * FROM raw_po WHERE k % 101 = 0), keyed AS (
  SELECT *, CASE WHEN k % 97 = 0 THEN '999999' ELSE CAST(l_suppkey AS VARCHAR) END AS sid,
    CASE WHEN k % 89 = 0 THEN 'X' ELSE CAST(l_partkey AS VARCHAR) END AS mid,
    CASE WHEN k % 50 <> 0 THEN d END AS day
  FROM twice
), n_po AS (
  SELECT CAST(k AS VARCHAR) AS po_number, day AS po_date, sid AS supplier_id,
    CASE WHEN k % 19 = 0 THEN 'Own vendor' ELSE s.supplier_name END AS supplier_name, mid AS material_id,
    CASE WHEN k % 23 = 0 THEN 'Own item' ELSE m.material_name END AS material_name,
    coalesce(CASE WHEN k % 3 = 2 THEN p_type || ' custom' END, m.category, s.category, 'Unclassified') AS category,
    q AS quantity, CAST(price AS DECIMAL(18,2)) AS unit_price_ngn,
    CASE WHEN line % 2 = 0 THEN amount ELSE CAST(q * price AS DECIMAL(18,2)) END AS total_amount_ngn,
    CASE WHEN k % 17 = 0 THEN amount END AS total_amount_usd, CASE WHEN k % 5 = 0 THEN 'NGN' ELSE 'USD' END AS currency,
    CASE WHEN k % 31 = 0 THEN DATE '1999-12-31' ELSE day + 30 END AS expected_delivery_date, CASE WHEN l_linestatus = 'F' THEN shipped END AS actual_delivery_date,
    CASE WHEN k % 43 = 0 THEN 'Partial' ELSE 'Delivered' END AS delivery_status, CASE WHEN k % 13 = 0 THEN 'Paid' ELSE o_orderstatus END AS payment_status,
    'Unassigned' AS buyer, 'Unknown' AS plant_location
  FROM keyed LEFT JOIN n_sup s ON sid = s.supplier_id LEFT JOIN n_mat m ON mid = m.material_id
), n_range AS (SELECT po_number, min(supplier_id) AS supplier_id, max(supplier_id) AS last FROM n_po GROUP BY po_number
), n_bridge AS (SELECT * FROM n_range WHERE supplier_id = last), raw_inc AS (
  SELECT incident_id, CASE WHEN po_number % 29 = 0 THEN 'none' ELSE CAST(po_number AS VARCHAR) END AS po_number,
    CASE WHEN po_number % 4 <> 0 THEN CAST(supplier_id AS VARCHAR) END AS supplier_id, severity,
    CASE WHEN po_number % 6 = 0 THEN 0 ELSE cost_impact_ngn END AS cost_impact_ngn
  FROM inc
), n_inc AS (
  SELECT incident_id, i.po_number, coalesce(i.supplier_id, b.supplier_id) AS supplier_id,
    'Quality Defect' AS incident_type, severity, CAST(cost_impact_ngn AS DECIMAL(18,2)) AS cost_impact_ngn
  FROM raw_inc i LEFT JOIN n_bridge b ON i.po_number = b.po_number AND i.supplier_id IS NULL
)"""

COLUMNS = {
    "n_sup": "supplier_id supplier_name category country payment_terms currency quality_rating is_approved risk_level",
    "n_mat": "material_id material_name category unit_of_measure standard_price_ngn lead_time_days",
    "n_po": (
        "po_number po_date supplier_id supplier_name material_id material_name category quantity unit_price_ngn "
        "total_amount_ngn total_amount_usd currency expected_delivery_date actual_delivery_date delivery_status "
        "payment_status buyer plant_location"
    ),
    "n_inc": "incident_id po_number supplier_id incident_type severity cost_impact_ngn",
}
DATASET_OF = {"n_sup": "suppliers", "n_mat": "materials", "n_po": "purchase_orders", "n_inc": "quality_incidents"}
NUMBERS = {"quantity", "unit_price_ngn", "total_amount_ngn", "total_amount_usd", "standard_price_ngn", "cost_impact_ngn"}
DAYS = {"po_date", "expected_delivery_date", "actual_delivery_date"}


def plain(table: str) -> str:
    """All columns with money as doubles and dates as text."""
    shown = []
    for column in COLUMNS[table].split():
        if column in NUMBERS:
            shown.append(f"{dbl(column)} AS {column}")
        elif column in DAYS:
            shown.append(f"strftime({column}, '%Y-%m-%d') AS {column}")
        else:
            shown.append(column)
    return f"SELECT {', '.join(shown)} FROM {table}"


def per_dataset(column: str, measure) -> str:
    rows = [
        f"SELECT '{DATASET_OF[table]}' AS dataset, CAST({measure(UNMERGED[table])} AS BIGINT) AS {column}" for table in COLUMNS
    ]
    return "\nUNION ALL ".join(rows)


def nulls(table: str) -> str:
    cells = " + ".join(f"count(*) - count({c})" for c in COLUMNS[table.removesuffix("_all")].split())
    return f"(SELECT {cells} FROM {table})"


# The tables before rows are merged and filled.
UNMERGED = {"n_sup": "n_sup_all", "n_mat": "n_mat_all", "n_po": "n_po", "n_inc": "n_inc"}

MONTH = "strftime(po_date, '%Y-%m')"
YEAR, MM = "strftime(po_date, '%Y')", "strftime(po_date, '%m')"
TOTAL = "(SELECT sum(total_amount_ngn) FROM po)"
PRICE_COLUMNS = "material_name, category, supplier_count, min_price, avg_price, max_price"
FILTER = "category IN ('PROMO', 'ECONOMY', 'LARGE') AND po_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"


def performance(source: str) -> str:
    quality, late = cents_sum("total_quality_cost"), f"{cents_sum('total_spend_ngn')} * 0.03::DOUBLE"
    return f"""
SELECT count(*) AS suppliers, {up(quality, 2)} AS quality_cost_ngn, {up(f"({late})", 2)} AS delivery_cost_ngn,
  {up(f"({quality} + {late})", 2)} AS performance_improvement_savings_ngn
FROM {source}"""


def bootstrap(replicates: int) -> str:
    """Savings of resampled lines; the weight of a line in a replicate follows from its digest."""
    line = ["po_number", "supplier_id", "material_id", "quantity", "unit_price_ngn", "total_amount_ngn"]
    keys = ["material_name", "category"]
    text = ", ".join(f"coalesce({c}::VARCHAR, '')" for c in (*keys, *line, "n"))

    def number(k: int, factor: int) -> str:
        powers = ", ".join(f"{pow(factor, r + 1, 2**31 - 1)}::BIGINT" for r in range(replicates))
        start = f"(('0x' || substr(digest, {1 + 8 * k}, 8))::BIGINT % 2147483646 + 1)"
        return f"({start} * ([{powers}])[replicate + 1] % 2147483647 // 32)"

    uniform = f"({number(0, 16807)} * 67108864 + {number(1, 48271)})::DOUBLE / 4503599627370496.0::DOUBLE"
    term, total, counts = math.exp(-1), 0.0, []
    while total + term > total:
        total += term
        counts.append(total)
        term /= len(counts)
    single = " + ".join(f"(u >= {p!r}::DOUBLE)::INT" for p in counts if p < 1)
    weight = f"CASE WHEN n = 1 THEN {single} ELSE low + len(list_filter(sums, lambda s: s <= u)) END"
    quantiles = {name: up(f"quantile_cont(savings, {p})", 2) for name, p in (("p05", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95))}
    spread = up("(quantile_cont(savings, 0.95) - quantile_cont(savings, 0.05))", 2)
    return f""", several AS (
  SELECT material_name, category FROM po GROUP BY ALL HAVING count(DISTINCT supplier_id) > 1
), copied AS (
  SELECT {", ".join((*keys, *line))}, count(*) AS n FROM po GROUP BY ALL
), hashed AS (
  SELECT material_name, category, unit_price_ngn AS price, total_amount_ngn AS amount, n, md5(concat_ws('|', {text})) AS digest
  FROM copied JOIN several USING (material_name, category)
), reach AS (
  SELECT n, greatest(0, n - ceil(9 * sqrt(n))::BIGINT - 9) AS low, n + ceil(9 * sqrt(n))::BIGINT + 32 AS high
  FROM (SELECT DISTINCT n FROM hashed WHERE n > 1)
), terms AS (SELECT n, low, unnest(range(low, high + 1)) AS k FROM reach), added AS (
  SELECT n, low, k, sum(exp(k * ln(n) - n - lgamma(k + 1))) OVER (PARTITION BY n ORDER BY k) AS s FROM terms
), laws AS (SELECT n AS many, any_value(low) AS low, list(s ORDER BY k) AS sums FROM added GROUP BY n), drawn AS (
  SELECT *, {uniform} AS u FROM (SELECT *, unnest(range(0, {replicates})) AS replicate FROM hashed)
), weighed AS (SELECT *, {weight} AS w FROM drawn LEFT JOIN laws ON n = many), per_material AS (
  SELECT replicate, {dbl("sum(amount * w)")} AS spend, {dbl("sum(price * w)")} / nullif({dbl("sum(w)")}, 0) AS av, {dbl("min(price)")} AS lo
  FROM weighed WHERE w > 0 GROUP BY replicate, material_name, category
), per_replicate AS (
  SELECT replicate, {dbl(f"sum(CAST({up('greatest(coalesce(spend * (av - lo) / nullif(av, 0), 0), 0)', 2)} AS DECIMAL(28,2)))")} AS savings
  FROM per_material GROUP BY replicate
)
SELECT count(*) AS replicates, {up(f"({dbl('sum(savings::DECIMAL(28,2))')} / count(savings))", 2)} AS mean, {up("stddev_pop(savings)", 2)} AS stddev,
  {", ".join(f"{q} AS {name}" for name, q in quantiles.items())}, {spread} AS interval_width
FROM per_replicate"""


def percentile(name: str, p: float) -> str:
    return f"{up(f'quantile_cont({dbl('unit_price_ngn')}, {p})', 4)} AS {name}"


STATEMENTS: dict[str, str] = {
    "executive_summary": f"""
SELECT count(DISTINCT po_number) AS total_orders, count(DISTINCT supplier_id) AS total_suppliers,
  {cash("sum(total_amount_ngn)", 0)} AS total_spend_ngn, {up(avg("total_amount_ngn"))} AS avg_order_value,
  {cash("sum(CASE WHEN currency = 'USD' THEN total_amount_usd ELSE 0 END)", 0)} AS total_usd_spend
FROM po""",
    "category_spend": f"""
SELECT category, count(*) AS order_count, {cash("sum(total_amount_ngn)", 0)} AS total_spend,
  {up(pct("sum(total_amount_ngn)", TOTAL), 2)} AS pct_of_total, {up(avg("total_amount_ngn"))} AS avg_order_value,
  count(DISTINCT supplier_id) AS supplier_count
FROM po GROUP BY category ORDER BY total_spend DESC""",
    "supplier_concentration": f"""
SELECT po.supplier_name, po.category, country, count(*) AS order_count,
  {cash("sum(total_amount_ngn)", 0)} AS total_spend, {up(pct("sum(total_amount_ngn)", TOTAL), 2)} AS pct_of_total_spend
FROM po LEFT JOIN sup ON po.supplier_id = sup.supplier_id
GROUP BY po.supplier_name, po.category, country
ORDER BY total_spend DESC, po.supplier_name, po.category, country LIMIT 10""",
    "price_variance": f"""{PRICES}
SELECT {PRICE_COLUMNS}, price_variance_pct, potential_savings_ngn FROM prices
WHERE supplier_count > 1 AND price_variance_pct > 10
ORDER BY potential_savings_ngn DESC, material_name, category LIMIT 20""",
    "price_variance_savings": f"""{PRICES}{TOP_PRICES}
SELECT {PRICE_COLUMNS}, price_variance_pct, potential_savings_ngn FROM top_prices""",
    "price_overpayment": f"""{PRICES}
SELECT {PRICE_COLUMNS}, overpayment_pct, potential_savings_ngn FROM prices
WHERE supplier_count > 1 AND overpayment_pct > 10
ORDER BY potential_savings_ngn DESC, material_name, category LIMIT 10""",
    "supplier_performance": f"""{PERF}
SELECT * FROM perf""",
    "supplier_performance_compat": f"""
SELECT s.supplier_id, s.supplier_name, s.category, s.country, s.risk_level, s.quality_rating,
  count(DISTINCT po.po_number) AS total_orders, {cash("sum(total_amount_ngn)")} AS total_spend_ngn,
  {up(avg("total_amount_ngn"), 2)} AS avg_order_value, {OTD} AS on_time_delivery_pct,
  count(DISTINCT incident_id) AS quality_incidents, {cash("coalesce(sum(cost_impact_ngn), 0)")} AS total_quality_cost
FROM sup s LEFT JOIN po ON s.supplier_id = po.supplier_id LEFT JOIN inc ON s.supplier_id = inc.supplier_id
GROUP BY s.supplier_id, s.supplier_name, s.category, s.country, s.risk_level, s.quality_rating""",
    "supplier_scorecard": f"""{PERF}
SELECT supplier_name, category, country, total_orders, {up("total_spend_ngn")} AS total_spend,
  on_time_delivery_pct AS otd_pct, quality_incidents, {up("total_quality_cost")} AS quality_cost,
  CASE WHEN on_time_delivery_pct >= 90 AND quality_incidents = 0 THEN 'A - Excellent'
    WHEN on_time_delivery_pct >= 80 AND quality_incidents <= 2 THEN 'B - Good'
    WHEN on_time_delivery_pct >= 70 OR quality_incidents <= 5 THEN 'C - Average'
    ELSE 'D - Poor' END AS performance_grade
FROM perf WHERE total_orders > 5 ORDER BY total_spend DESC""",
    "supplier_grade": f"""{PERF}{GRADED}
SELECT * FROM graded""",
    "grade_distribution": f"""{PERF}{GRADED}
SELECT performance_grade, category, count(*) AS supplier_count FROM graded GROUP BY performance_grade, category""",
    "top_suppliers": f"""{PERF}{GRADED}
SELECT * FROM graded ORDER BY total_spend_ngn DESC, supplier_id LIMIT 15""",
    "late_delivery": f"""
SELECT supplier_name, category, count(*) AS total_deliveries, CAST({LATE} AS BIGINT) AS late_deliveries,
  {up(pct(LATE, "count(*)"), 2)} AS late_delivery_pct,
  {up(f"({dbl('sum(actual_delivery_date - expected_delivery_date)')} / nullif(count(actual_delivery_date - expected_delivery_date), 0))", 1)}
    AS avg_delay_days
FROM po WHERE actual_delivery_date IS NOT NULL GROUP BY supplier_name, category HAVING count(*) > 5
ORDER BY late_delivery_pct DESC, supplier_name, category LIMIT 15""",
    "late_delivery_rate": f"""
SELECT CAST({LATE} AS BIGINT) AS late_deliveries, {up(pct(LATE, "count(actual_delivery_date)"), 2)} AS late_delivery_pct
FROM po""",
    "payment_terms": f"""
SELECT payment_terms, count(*) AS order_count, {cash("sum(total_amount_ngn)", 0)} AS total_value,
  count(*) FILTER (payment_status = 'Paid') AS paid_count,
  count(*) FILTER (payment_status = 'Overdue') AS overdue_count,
  {cash("sum(CASE WHEN payment_status = 'Overdue' THEN total_amount_ngn ELSE 0 END)", 0)} AS overdue_value
FROM po JOIN sup ON po.supplier_id = sup.supplier_id GROUP BY payment_terms""",
    "fx_monthly": f"""{RATES}
SELECT {MONTH} AS month, count(*) AS usd_orders, {cash("sum(total_amount_usd)", 0)} AS total_usd,
  {up("avg(rate)", 2)} AS avg_fx_rate, {up("min(rate)", 2)} AS min_fx_rate, {up("max(rate)", 2)} AS max_fx_rate,
  {up("((max(rate) - min(rate)) / min(rate) * 100)", 2)} AS fx_volatility_pct
FROM fx GROUP BY month""",
    "fx_exposure": f"""{RATES}
SELECT {cash("sum(total_amount_usd)", 0)} AS total_usd_spend, {up("avg(rate)", 2)} AS avg_fx_rate,
  {up("min(rate)", 2)} AS min_fx_rate, {up("max(rate)", 2)} AS max_fx_rate,
  {up(f"(({up('max(rate)', 2)} - {up('min(rate)', 2)}) / {up('min(rate)', 2)} * 100)", 6)} AS fx_volatility_pct
FROM fx""",
    "fx_exposure_exact": f"""{RATES}
SELECT {cash("coalesce(sum(total_amount_usd), 0)")} AS total_usd_spend, {up("avg(rate)", 2)} AS avg_fx_rate,
  {up("min(rate)", 2)} AS min_fx_rate, {up("max(rate)", 2)} AS max_fx_rate,
  CASE WHEN min(rate) > 0 THEN {up("((max(rate) - min(rate)) / min(rate) * 100)", 6)} ELSE 0 END AS fx_volatility_pct
FROM fx""",
    "quality_cost": f""", spent AS (SELECT supplier_id, sum(total_amount_ngn) AS spend FROM po GROUP BY supplier_id)
SELECT supplier_name, category, quality_rating, count(incident_id) AS incident_count,
  count(*) FILTER (severity = 'High') AS high_severity_count, {cash("sum(cost_impact_ngn)", 0)} AS total_quality_cost,
  {up(pct("sum(cost_impact_ngn)", "spend"), 2)} AS quality_cost_pct_of_spend
FROM inc JOIN sup USING (supplier_id) LEFT JOIN spent USING (supplier_id)
GROUP BY supplier_name, category, quality_rating, spend""",
    "maverick_suppliers": f"""{MAVERICK}
SELECT po.supplier_name, risk_level, is_approved, count(*) AS order_count,
  {cash("sum(total_amount_ngn)", 0)} AS total_spend, string_agg(DISTINCT buyer, ',' ORDER BY buyer) AS buyers
FROM po JOIN flagged USING (supplier_id) GROUP BY po.supplier_name, risk_level, is_approved""",
    "maverick_total": f"""{MAVERICK}
SELECT {cash("coalesce(sum(total_amount_ngn), 0)")} AS maverick_spend_ngn,
  {up(pct("coalesce(sum(total_amount_ngn), 0)", TOTAL), 4)} AS maverick_pct_of_spend
FROM po JOIN flagged USING (supplier_id)""",
    "maverick_by_risk": f"""{MAVERICK}
SELECT risk_level, {cash("sum(total_amount_ngn)")} AS total_amount_ngn
FROM po JOIN flagged USING (supplier_id) GROUP BY risk_level""",
    "spend_trend": f"""
SELECT {YEAR} AS year, {MM} AS month, category, count(*) AS order_count,
  {cash("sum(total_amount_ngn)", 0)} AS total_spend, {up(avg("total_amount_ngn"))} AS avg_order_value
FROM po GROUP BY year, month, category""",
    "monthly_spend_by_category": f"""
SELECT {MONTH} AS month, category, {cash("sum(total_amount_ngn)")} AS total_spend_ngn
FROM po WHERE po_date IS NOT NULL GROUP BY month, category""",
    "category_month": f"""
SELECT category, {YEAR} AS year, {MM} AS month, count(DISTINCT po_number) AS total_orders,
  {cash("sum(total_amount_ngn)")} AS total_spend_ngn, {up(avg("total_amount_ngn"), 2)} AS avg_order_value,
  count(DISTINCT supplier_id) AS unique_suppliers
FROM po WHERE po_date IS NOT NULL GROUP BY category, year, month""",
    "savings_opportunities": f"""{OPPORTUNITIES}
SELECT * FROM opportunities""",
    "savings_summary": f"""{PERF}{OPPORTUNITIES}{SPREAD}
SELECT 'Price Standardization' AS opportunity_type, count(*) AS opportunities,
  {up(cents_sum("potential_savings_ngn"))} AS total_potential_savings FROM opportunities
UNION ALL
SELECT 'Quality Cost Reduction', count(DISTINCT supplier_id), {up(cents_sum("total_quality_cost"))}
FROM perf WHERE quality_incidents > 0
UNION ALL
SELECT 'Supplier Consolidation', count(DISTINCT category), {up(f"(coalesce({dbl('sum(spend)')}, 0) * 0.05::DOUBLE)")}
FROM spread WHERE supplier_count > 10""",
    "action_items": f"""{PERF}{OPPORTUNITIES}
SELECT * FROM (
  SELECT 'Renegotiate Price' AS action_item, supplier_name AS target, category,
    {up("potential_savings_ngn")} AS estimated_savings, 'High price variance detected' AS reason
  FROM opportunities ORDER BY potential_savings_ngn DESC, supplier_name, category LIMIT 5)
UNION ALL
SELECT * FROM (
  SELECT 'Replace Supplier', supplier_name, category,
    {up("(total_quality_cost + total_spend_ngn * 0.03::DOUBLE)")}, 'Poor delivery & quality performance'
  FROM perf WHERE on_time_delivery_pct < 70 AND quality_incidents > 3
  ORDER BY total_spend_ngn DESC, supplier_id LIMIT 5)""",
    "consolidation": f"""{SPREAD}
SELECT * FROM merged""",
    "performance_savings": f"""{PERF}{performance(f"perf WHERE {WEAK}")}""",
    "performance_savings_top10": f"""{PERF}, biggest AS (
  SELECT {up("total_quality_cost")} AS total_quality_cost, {up("total_spend_ngn")} AS total_spend_ngn
  FROM perf WHERE {WEAK} ORDER BY 2 DESC, supplier_id LIMIT 10
){performance("biggest")}""",
    "price_distribution": f"""
SELECT material_name, category, count(unit_price_ngn) AS line_count, {up(avg("unit_price_ngn"), 4)} AS mean,
  {up(f"stddev_pop({dbl('unit_price_ngn')})", 4)} AS stddev, {percentile("p05", 0.05)}, {percentile("p25", 0.25)},
  {percentile("median", 0.5)}, {percentile("p75", 0.75)}, {percentile("p95", 0.95)}
FROM po GROUP BY material_name, category""",
    # The executed quantile of the approximate form is exact for groups below its accuracy.
    "price_distribution_approx": f"""
SELECT material_name, category, count(unit_price_ngn) AS line_count,
  {", ".join(f"quantile_disc({dbl('unit_price_ngn')}, {p}) AS {name}" for name, p in (("p05", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95)))}
FROM po GROUP BY material_name, category""",
    "savings_bootstrap": bootstrap(100),
    "savings_scenarios": COMPONENTS + scenario_select("scenario", "scenario"),
    "savings_scenarios_by_category": COMPONENTS
    + scenario_select("scenario, category", "GROUPING SETS ((scenario), (scenario, category))"),
    "supplier_optimization": f"""{ALLOCATION}
SELECT category, supplier_id, supplier_name, total_quantity, total_spend_ngn, avg_unit_cost_ngn, on_time_delivery_pct,
  total_quality_cost_ngn AS quality_cost_ngn, risk_level, {up("cost_score", 6)} AS cost_score,
  {up("delivery_score", 6)} AS delivery_score, {up("quality_score", 6)} AS quality_score, risk_score,
  {up("composite", 6)} AS composite_score, {up("share", 6)} AS recommended_share,
  {up("pq", 2)} AS projected_quantity, {up("ps")} AS projected_spend_ngn,
  category_spend_ngn AS historical_category_spend_ngn, category_avg_unit_cost AS historical_category_avg_unit_cost
FROM allocated""",
    "optimization_savings": f"""{ALLOCATION}{OPT_SAVINGS}
SELECT {up("before", 2)} AS historical_spend_ngn, {up("after")} AS optimized_spend_ngn,
  {up("greatest(0, before - after)")} AS optimization_savings_ngn,
  {up(pct("greatest(0, before - after)", "before"), 4)} AS optimization_savings_pct
FROM opt""",
    "constrained_sourcing": sourcing_ctes(*RULE_ARGS["standard"]) + SOURCING_SELECT,
    **{
        f"constrained_sourcing_{name}": sourcing_ctes(*RULE_ARGS[name]) + SOURCING_SELECT
        for name in ("conservative", "aggressive", "mixed", "dual")
    },
    "constrained_sourcing_strict_cap": sourcing_ctes(*RULE_ARGS["mixed"], strict=True) + SOURCING_SELECT,
    "constrained_savings": sourcing_ctes(*RULE_ARGS["standard"]) + sourcing_totals() + CON_SELECT,
    "constrained_savings_dual": sourcing_ctes(*RULE_ARGS["dual"]) + sourcing_totals() + CON_SELECT,
    "constrained_savings_strict_cap": sourcing_ctes(*RULE_ARGS["mixed"], strict=True)
    + sourcing_totals(strict=True)
    + CON_SELECT,
    "insights_summary": f"""{INSIGHTS}
SELECT * FROM insights""",
    "insights_display": f"""{INSIGHTS}
SELECT metric, CASE unit WHEN 'percent' THEN printf('%.2f%%', value)
  ELSE CASE unit WHEN 'USD' THEN '$' ELSE '₦' END || format('{{:,}}', CAST(round_even(value, 0) AS BIGINT)) END AS display
FROM insights""",
    "filtered_kpis": f""", view AS (SELECT * FROM po WHERE {FILTER}){MAVERICK}{price_ctes("view")}{TOP_PRICES}
SELECT {cash("coalesce(sum(total_amount_ngn), 0)")} AS filtered_total_spend,
  (SELECT {cash("coalesce(sum(total_amount_ngn), 0)")} FROM view JOIN flagged USING (supplier_id))
    AS filtered_maverick_spend,
  (SELECT {cents_sum("potential_savings_ngn")} FROM top_prices) AS filtered_savings,
  count(DISTINCT supplier_id) AS filtered_supplier_count
FROM view""",
    "sql_over_views": f"""{PERF}{OPPORTUNITIES}
SELECT p.category, count(*) AS suppliers, {up("sum(CAST(total_spend_ngn AS DECIMAL(28,2)))", 2)} AS total_spend_ngn,
  (SELECT count(*) FROM opportunities) AS opportunities
FROM perf p WHERE total_orders > 0 GROUP BY p.category""",
    "files_to_mart": f"""{CLEAN}
SELECT category, {YEAR} AS year, {MM} AS month, count(DISTINCT po_number) AS total_orders,
  {cash("sum(total_amount_ngn)")} AS total_spend_ngn, {up(avg("total_amount_ngn"), 2)} AS avg_order_value,
  count(DISTINCT supplier_id) AS unique_suppliers
FROM n_po WHERE po_date IS NOT NULL GROUP BY category, year, month""",
    "normalized_suppliers": f"""{CLEAN}
{plain("n_sup")}""",
    "normalized_materials": f"""{CLEAN}
{plain("n_mat")}""",
    "normalized_orders": f"""{CLEAN}
{plain("n_po")}""",
    "normalized_incidents": f"""{CLEAN}
{plain("n_inc")}""",
    "dq_row_counts": f"""{CLEAN}
{per_dataset("row_count", lambda table: f"(SELECT count(*) FROM {table})")}""",
    "dq_nulls": f"""{CLEAN}
{per_dataset("null_cells", nulls)}""",
    "dq_duplicates": f"""{CLEAN}
{per_dataset("duplicate_rows", lambda t: f"((SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})))")}""",
    "dq_unmapped": f"""{CLEAN}
SELECT 'unmapped_supplier_ids' AS "check", count(*) AS unmapped
FROM n_po WHERE NOT EXISTS (SELECT 1 FROM n_sup s WHERE s.supplier_id = n_po.supplier_id)
UNION ALL
SELECT 'unmapped_material_ids', count(*)
FROM n_po WHERE NOT EXISTS (SELECT 1 FROM n_mat m WHERE m.material_id = n_po.material_id)
UNION ALL
SELECT 'quality_incidents_without_po', count(*)
FROM n_inc WHERE NOT EXISTS (SELECT 1 FROM n_po p WHERE p.po_number = n_inc.po_number)
UNION ALL
SELECT 'incidents_with_ambiguous_supplier', count(*)
FROM raw_inc i JOIN n_range r ON i.po_number = r.po_number WHERE i.supplier_id IS NULL AND r.supplier_id < r.last""",
    "dq_duplicate_keys": f"""{CLEAN}
SELECT 'suppliers' AS dataset, count(*) - count(DISTINCT supplier_id) AS duplicate_keys FROM n_sup_all
UNION ALL SELECT 'materials', count(*) - count(DISTINCT material_id) FROM n_mat_all
UNION ALL SELECT 'quality_incidents', count(*) - count(DISTINCT incident_id) FROM n_inc""",
    "landing_variants": f"""{CLEAN}
{plain("n_sup").replace("currency, quality_rating", "CASE WHEN CAST(supplier_id AS BIGINT) % 3 = 1 THEN 'NGN' ELSE currency END AS currency, quality_rating")}""",
}

PAIRS = f"""{MAVERICK}, pairs AS (
  SELECT po.supplier_name, risk_level, is_approved, buyer, count(*) AS order_count, sum(total_amount_ngn) AS spend
  FROM po JOIN flagged USING (supplier_id) GROUP BY ALL
)"""
STATEMENTS |= {
    "maverick_buyers": f"""{PAIRS}
SELECT supplier_name, risk_level, is_approved, buyer, order_count, {dbl("spend")} AS spend FROM pairs""",
    "maverick_top_buyers": f"""{PAIRS}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY supplier_name, risk_level, is_approved ORDER BY spend DESC, buyer) AS place FROM pairs
)
SELECT supplier_name, risk_level, is_approved, sum(order_count)::BIGINT AS order_count, {cash("sum(spend)", 0)} AS total_spend,
  string_agg(buyer, ',' ORDER BY place) FILTER (place <= 3) AS top_buyers, count(*) FILTER (place > 3) AS other_buyers,
  {cash("coalesce(sum(spend) FILTER (place > 3), 0)", 0)} AS other_spend
FROM placed GROUP BY supplier_name, risk_level, is_approved""",
}

# Cells of the raw tables that their column's type cannot hold, by the rules that made them.
RAW_CELLS = (
    ("suppliers", "quality_rating", "n_sup_all", "true", "CAST(supplier_id AS BIGINT) % 7 = 0"),
    ("suppliers", "is_approved", "n_sup_all", "CAST(supplier_id AS BIGINT) % 6 <> 5", "CAST(supplier_id AS BIGINT) % 6 = 4"),
    ("materials", "standard_price_ngn", "n_mat_all", "true", "CAST(material_id AS BIGINT) % 9 = 0"),
    ("materials", "lead_time_days", "n_mat_all", "CAST(material_id AS BIGINT) % 8 <> 0", "false"),
    ("purchase_orders", "quantity", "twice", "true", "k % 41 = 0"),
    ("purchase_orders", "unit_price_ngn", "twice", "k % 37 <> 0", "false"),
    ("purchase_orders", "total_amount_ngn", "twice", "line % 2 = 0", "false"),
    ("purchase_orders", "total_amount_usd", "twice", "k % 17 < 2", "k % 17 = 1"),
    ("purchase_orders", "po_date", "twice", "true", "k % 50 = 0"),
    ("purchase_orders", "expected_delivery_date", "twice", "k % 31 < 2", "k % 31 = 1"),
    ("purchase_orders", "actual_delivery_date", "twice", "l_linestatus = 'F'", "false"),
    ("quality_incidents", "cost_impact_ngn", "inc", "true", "po_number % 6 = 0"),
)
RAGGED = """, raw_sup AS (
  SELECT supplier_id AS k, CAST(supplier_id AS VARCHAR) AS a, supplier_name AS b, category AS c, country AS d,
    CASE WHEN supplier_id % 5 <> 0 THEN lower(currency) END AS e,
    CASE WHEN supplier_id % 7 = 0 THEN 'unrated' ELSE CAST(quality_rating AS VARCHAR) END AS f,
    CASE supplier_id % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN ' APPROVED ' WHEN 3 THEN 'Rejected' WHEN 4 THEN 'maybe' END AS g,
    CASE supplier_id % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'low' WHEN 2 THEN ' ' END AS h
  FROM sup
), raw_sup_all AS (
  SELECT * FROM raw_sup UNION ALL SELECT * REPLACE (b || ' (old)' AS b) FROM raw_sup WHERE k % 10 = 0
  UNION ALL SELECT * REPLACE (NULL AS b) FROM raw_sup WHERE k % 15 = 0 UNION ALL SELECT * FROM raw_sup WHERE k % 7 = 0
)"""
QUOTED = ", ".join(f"'\"' || coalesce({c}, '') || '\"'" for c in "abcdefg")
STATEMENTS |= {
    "dq_unreadable": CLEAN
    + "\nUNION ALL ".join(
        f"""
SELECT '{dataset}' AS dataset, '{column}' AS "column", count(*) FILTER ({present}) AS present, count(*) FILTER ({bad}) AS unreadable
FROM {table}"""
        for dataset, column, table, present, bad in RAW_CELLS
    ),
    "dq_malformed_rows": f"""{RAGGED}
SELECT 'suppliers' AS dataset, CAST(8 - CAST(k % 13 = 0 AS INT) + CAST(k % 11 = 0 AS INT) AS INT) AS cells, 8::INT AS expected,
  concat_ws(',', {QUOTED}, CASE WHEN k % 13 <> 0 THEN '"' || coalesce(h, '') || '"' END, CASE WHEN k % 11 = 0 THEN '"a, b"' END) AS record,
  true AS has_file
FROM raw_sup_all WHERE (k % 13 = 0) <> (k % 11 = 0)""",
    "landing_quarantine": f"""{CLEAN}
SELECT * REPLACE (CASE WHEN CAST(supplier_id AS BIGINT) % 143 = 0 THEN 'A, B' ELSE risk_level END AS risk_level) FROM n_sup
WHERE (CAST(supplier_id AS BIGINT) % 13 = 0) = (CAST(supplier_id AS BIGINT) % 11 = 0)""",
    "normalized_orders_other_days": STATEMENTS["normalized_orders"],
    "folder_scan": STATEMENTS["normalized_materials"],
    "report_as_json": f"""
SELECT *, '₦' || CASE WHEN abs(total_spend_ngn) >= 1e9 THEN printf('%.1fB', total_spend_ngn / 1e9)
  WHEN abs(total_spend_ngn) >= 1e6 THEN printf('%.1fM', total_spend_ngn / 1e6) ELSE printf('%.1fK', total_spend_ngn / 1e3) END AS short
FROM (SELECT category, {cash("sum(total_amount_ngn)")} AS total_spend_ngn, {up(pct("sum(total_amount_ngn)", TOTAL), 2)} AS pct_of_total
  FROM po GROUP BY category)""",
}

# The complete forms take all materials with a saving, the named variants the largest 20.
TOP_20 = ("insights_summary", "savings_scenarios", "savings_scenarios_by_category", "filtered_kpis")
STATEMENTS |= {f"{name}_top20": STATEMENTS[name] for name in TOP_20}
STATEMENTS |= {
    name: STATEMENTS[name].replace(TOP_PRICES, TOP_PRICES.replace(" LIMIT 20", "")) for name in (*TOP_20, "insights_display")
}

# Marts of the filtered lines, and of those that ranges with a part of a month keep.
PART_FILTER = FILTER.replace("1996-01-01", "1996-01-15").replace("1999-12-31", "1999-11-10")
FILTERED = {
    "filtered_category_spend": ("category_spend", FILTER),
    "filtered_supplier_performance": ("supplier_performance", FILTER),
    "filtered_price_variance": ("price_variance_savings", FILTER),
    "filtered_monthly_spend": ("monthly_spend_by_category", FILTER),
    "partials_category_spend": ("category_spend", PART_FILTER),
    "partials_price_variance": ("price_variance_savings", PART_FILTER),
    "filtered_by_table": (
        "monthly_spend_by_category",
        "category IS NOT NULL AND po_date BETWEEN DATE '1996-01-15' AND DATE '1999-11-10' "
        "AND supplier_id IN (SELECT supplier_id FROM sup WHERE risk_level = 'Medium')",
    ),
}
CHOSEN = "category IN ('PROMO', 'ECONOMY', 'LARGE')"
STATEMENTS |= {
    "filtered_supplier_optimization": f"{STATEMENTS['supplier_optimization']} WHERE {CHOSEN}",
    "filtered_constrained_sourcing": f"{STATEMENTS['constrained_sourcing_mixed']} WHERE {CHOSEN}",
    "filtered_maverick_lines": f"""{MAVERICK}
SELECT po_number, strftime(po_date, '%Y-%m-%d') AS po_date, supplier_id, material_id, po.category,
  {dbl("total_amount_ngn")} AS total_amount_ngn, flagged.risk_level, is_approved
FROM po JOIN flagged USING (supplier_id) WHERE po.{PART_FILTER}""",
    "partials_kpis": STATEMENTS["filtered_kpis"].replace(FILTER, PART_FILTER),
    "partials_late_month": STATEMENTS["monthly_spend_by_category"],
    "partials_distinct_orders": """
SELECT category, count(DISTINCT po_number) AS total_orders, count(DISTINCT supplier_id) AS unique_suppliers, true AS estimate_holds
FROM po GROUP BY category""",
}


def filtered_base(condition: str) -> str:
    """The canonical tables with the order lines that a condition keeps."""
    kept = f"), po AS (SELECT * FROM all_po WHERE {condition}), inc AS ("
    return BASE.replace("), po AS (", "), all_po AS (", 1).replace("), inc AS (", kept, 1)


def oracle_sql() -> dict[str, str]:
    plain = {name: BASE + body for name, body in STATEMENTS.items()}
    return plain | {name: filtered_base(condition) + STATEMENTS[body] for name, (body, condition) in FILTERED.items()}
