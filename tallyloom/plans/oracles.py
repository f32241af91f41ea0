"""DuckDB SQL with the same columns and rows as the registered queries, on the same tables."""

from __future__ import annotations

from tallyloom.functions.fiscal import MONTH_LABELS
from tallyloom.functions.names import DOSE_WORDS
from tallyloom.operators.bulk import HEADER_NAMES
from tallyloom.plans.queries import BY_YEAR, CSV, GREEK, TERM, TOP, WILD, YEAR

_D = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"
_FY = "year({0}) + CASE WHEN month({0}) >= 10 THEN 1 ELSE 0 END"
_IDX = "(month({0}) + 2) % 12"
_TURNED = "array_to_string(list_reverse(string_split(p_name, ' ')), ' ') || ' ' || p_size || ' mg'"

INPUTS = f"""
WITH dispense AS (SELECT CAST(l_partkey AS VARCHAR) AS icode, CAST(l_shipdate AS DATE) AS d, l_quantity AS qty FROM lineitem WHERE l_linestatus = 'F'),
items AS (SELECT CAST(p_partkey AS VARCHAR) AS icode, p_name || ' ' || p_size || ' mg' AS name FROM part),
lines AS (
  SELECT CAST(l_partkey AS VARCHAR) AS working_code, l_quantity AS qty, l_extendedprice AS value, CAST(o_orderdate AS DATE) AS d
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'O'
),
catalog AS (SELECT CAST(p_partkey AS VARCHAR) AS working_code, {_TURNED} AS drug_name FROM part WHERE p_partkey % 10 <> 0),
links AS (
  SELECT p_partkey AS id, CAST(p_partkey AS VARCHAR) AS icode, CAST(p_partkey AS VARCHAR) AS working_code,
    CASE p_partkey % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'manual' ELSE 'approved' END AS match_method
  FROM part WHERE p_partkey % 5 <> 0
),
exclusions AS (SELECT CAST(p_partkey AS VARCHAR) AS icode, 'not stocked' AS reason FROM part WHERE p_partkey % 25 = 0),
h AS (SELECT icode, CAST({_FY.format("d")} AS INT) AS fy, CAST({_IDX.format("d")} AS INT) AS month_idx, {_D.format("qty")} AS qty FROM dispense GROUP BY ALL),
i AS (SELECT working_code, CAST({_FY.format("d")} AS INT) AS fy, CAST({_IDX.format("d")} AS INT) AS month_idx, {_D.format("qty")} AS qty, {_D.format("value")} AS value FROM lines GROUP BY ALL),
grid AS (SELECT CAST(unnest(range(12)) AS INT) AS month_idx)"""

_RECONCILE = f""",
cells AS (
  SELECT icode, working_code, fy, month_idx, qty AS d, 0.0 AS q, 0.0 AS v FROM h JOIN links USING (icode)
  UNION ALL SELECT icode, working_code, fy, month_idx, 0.0, qty, value FROM i JOIN links USING (working_code)
),
keys AS (SELECT DISTINCT icode, working_code, fy FROM cells),
m AS (
  SELECT k.icode, k.working_code, k.fy, g.month_idx, coalesce({_D.format("d")}, 0) AS d, coalesce({_D.format("q")}, 0) AS q, coalesce({_D.format("v")}, 0) AS v
  FROM keys k CROSS JOIN grid g LEFT JOIN cells c ON c.icode = k.icode AND c.working_code = k.working_code AND c.fy = k.fy AND c.month_idx = g.month_idx GROUP BY ALL
),
mp AS (
  SELECT *, CASE WHEN v > 0 AND q > 0 THEN v / q END AS price, q - d AS delta,
    CAST(sum(CAST(q - d AS DECIMAL(18,2))) OVER (PARTITION BY icode, working_code, fy ORDER BY month_idx) AS DOUBLE) AS stock FROM m
),
y AS (
  SELECT icode, working_code, fy, {_D.format("d")} AS yd, {_D.format("q")} AS yq, {_D.format("v")} AS yv, median(price) AS med,
    stddev_pop(d) / nullif(avg(d), 0) AS cvd, stddev_pop(v) / nullif(avg(v), 0) AS cvv, max(CASE WHEN month_idx = 11 THEN stock END) AS last
  FROM mp GROUP BY ALL
),
flags AS (
  SELECT icode, working_code, fy, 'zero-use-full-purchase' AS kind, CAST(NULL AS INT) AS month, CAST(NULL AS VARCHAR) AS gap, yd AS dispensed_qty, yq AS purchased_qty, yv AS purchased_value FROM y WHERE yd <= 0 AND yv > 0
  UNION ALL SELECT icode, working_code, fy, 'dispensed-without-purchase', NULL, NULL, yd, yq, yv FROM y WHERE yd > 0 AND yv <= 0
  UNION ALL SELECT icode, working_code, fy, 'unit-price-spike', month_idx, NULL, d, q, v FROM mp JOIN y USING (icode, working_code, fy) WHERE CASE WHEN med > 0 THEN price > 3 * med ELSE price > 0 END
  UNION ALL SELECT icode, working_code, fy, 'year-end-stock-gap', NULL, CASE WHEN last > 0 THEN 'overstock' ELSE 'overuse' END, yd, yq, yv FROM y WHERE yd > 0 AND abs(last) > 0.25 * yd
)"""

_YEAR_COLUMNS = """SELECT icode, working_code, fy, round(yd, 6) AS year_dispensed, round(yq, 6) AS year_purchased_qty, round(yv, 6) AS year_value,
  round(CASE WHEN yd > 0 THEN yv / yd END, 6) AS unit_price_year, round(CASE WHEN yq > 0 THEN yd / yq END, 6) AS coverage_ratio,
  round(cvd, 6) AS cv_dispensed_qty, round(cvv, 6) AS cv_purchased_value, round(med, 6) AS median_price,
  CAST((SELECT count(*) FROM flags f WHERE f.icode = y.icode AND f.working_code = y.working_code AND f.fy = y.fy) AS INT) AS n_flags FROM y"""

_DOSE = ", ".join(f"'{w}'" for w in DOSE_WORDS)


def _norm(name: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower({name}), '[0-9]+|[a-z]+'), lambda t: NOT regexp_full_match(t, '[0-9]+') AND t NOT IN ({_DOSE})))), ' ')"


def _score(a: str, b: str) -> str:
    x, y = f"string_split({a}, ' ')", f"string_split({b}, ' ')"
    share = f"len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y})))"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 WHEN {share} > 0 THEN 0.5 + 0.5 * {share} ELSE 1.0 - levenshtein({a}, {b}) / greatest(length({a}), length({b}), 1) END"


def _term(name: str) -> str:
    return f"substr(CASE WHEN length(string_split({name}, ' ')[1]) < 3 THEN string_split({name}, ' ')[1] || ' ' || string_split({name}, ' ')[2] ELSE string_split({name}, ' ')[1] END, 1, 16)"


def _candidates(items: str, k: int | None) -> str:
    """k: rows of a term that are scored (None: all)."""
    cut = "" if k is None else f"\n  QUALIFY row_number() OVER (PARTITION BY term ORDER BY tier, candidate_name, working_code) <= {k}"
    return f""",
asked AS (SELECT icode, drug_name, {_norm("drug_name")} AS a, lower({_term("drug_name")}) AS term FROM {items}),
hits AS (
  SELECT term, working_code, drug_name AS candidate_name, {_norm("drug_name")} AS b,
    CASE WHEN lower(working_code) = term THEN 0 WHEN starts_with(lower(working_code), term) THEN 1 ELSE 2 END AS tier
  FROM (SELECT DISTINCT term FROM asked) JOIN catalog ON starts_with(lower(working_code), term) OR contains(lower(drug_name), term){cut}
),
scored AS (SELECT icode, asked.drug_name, working_code, candidate_name, {_score("a", "b")} AS score FROM asked JOIN hits USING (term)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY icode ORDER BY score DESC, working_code) AS INT) AS rank FROM scored)"""


_PAGE = f"""page AS (SELECT icode, name FROM items WHERE contains(icode, '{TERM}') OR contains(lower(name), '{TERM}') ORDER BY name, icode LIMIT 100),
listed AS (
  SELECT page.icode, name AS drug_name, CASE WHEN l.icode IS NOT NULL THEN 'mapped' WHEN e.icode IS NOT NULL THEN 'no_invs' ELSE 'unmapped' END AS status,
    l.working_code, CASE WHEN l.icode IS NULL THEN reason END AS reason
  FROM page LEFT JOIN links l USING (icode) LEFT JOIN exclusions e USING (icode)
)"""

_STATUS = """SELECT items.icode, CASE WHEN l.icode IS NOT NULL THEN 'mapped' WHEN e.icode IS NOT NULL THEN 'no_invs' ELSE 'unmapped' END AS status,
  l.working_code, l.match_method, CASE WHEN l.icode IS NULL THEN e.reason END AS reason FROM items LEFT JOIN {} l USING (icode) LEFT JOIN {} e USING (icode)"""

_LABELS = "[" + ", ".join(f"'{x}'" for x in MONTH_LABELS) + "]"


def _h_vectors(where: str) -> str:
    return f"""{INPUTS}, t AS (SELECT icode, {_D.format("qty")} AS total FROM h WHERE fy = {YEAR} {where} GROUP BY icode)
SELECT t.icode, name, total, grid.month_idx, coalesce(qty, 0) AS monthly_qty FROM t JOIN items USING (icode) CROSS JOIN grid LEFT JOIN h ON h.icode = t.icode AND fy = {YEAR} AND h.month_idx = grid.month_idx"""


def _i_vectors(where: str) -> str:
    return f"""{INPUTS}, t AS (SELECT working_code, {_D.format("qty")} AS total_qty, {_D.format("value")} AS total_value FROM i WHERE fy = {YEAR} {where} GROUP BY working_code),
g AS (SELECT t.*, grid.month_idx, coalesce(qty, 0) AS monthly_qty, coalesce(value, 0) AS monthly_value FROM t CROSS JOIN grid LEFT JOIN i ON i.working_code = t.working_code AND fy = {YEAR} AND i.month_idx = grid.month_idx)
SELECT g.working_code, coalesce(drug_name, '') AS name, total_qty, total_value, month_idx, monthly_qty, monthly_value,
  CAST(first_value(month_idx) OVER (PARTITION BY g.working_code ORDER BY monthly_value DESC, month_idx DESC) + 1 AS INT) AS peak_fiscal_month
FROM g LEFT JOIN catalog USING (working_code)"""


_MATCHED = f"{INPUTS}, {_PAGE}, open_rows AS (SELECT icode, drug_name FROM listed WHERE status = 'unmapped'){_candidates('open_rows', 10)}"


_GREEK = ", ".join(f"'{w}'" for w in GREEK.split())
#: The same on names that are alike but for one word.
_NEAR = _MATCHED.replace("items AS (", "items0 AS (", 1).replace("catalog AS (", "catalog0 AS (", 1).replace(
    "page AS (",
    f"""items AS (SELECT icode, 'x' || translate(icode, '0123456789', 'abcdefghij') || 'q ' || array_to_string([{_GREEK}][1 : 7 + CAST(icode AS BIGINT) % 3], ' ') AS name FROM items0),
catalog AS (SELECT icode AS working_code, name || CASE CAST(icode AS BIGINT) % 4 WHEN 0 THEN '' ELSE ' kappa' END AS drug_name FROM items),
page AS (""",
    1,
).replace(f"'{TERM}'", "'x'")


def _thai(text: str) -> str:
    """Normalised tokens of a name with a dose in inner brackets, other brackets at the end and Thai words."""
    plain = f"regexp_replace(regexp_replace(lower({text}), '\\([0-9]+mg\\)', '', 'g'), '[()]', ' ', 'g')"
    spelled = f"replace(replace(regexp_replace({plain}, 'รา([^ะ-๏]|$)', 'ร\\1', 'g'), 'รร', 'ร'), 'รึ', 'ริ')"
    found = f"regexp_extract_all({spelled}, '[0-9]+|[๐-๙]+|[ก-๏]+|[a-z]+')"
    return f"array_to_string(list_sort(list_distinct(list_filter({found}, lambda t: NOT regexp_full_match(t, '[0-9]+|[๐-๙]+') AND t NOT IN ({_DOSE})))), ' ')"


_HEADER = ", ".join(f"'{w}'" for w in HEADER_NAMES)
_TEXT = CSV.replace("'", "''").replace("\n", "' || chr(10) || '")
#: The pasted text as records, and these held against the links: `seen` by a dry run, `done` when applied.
_IMPORT = f"""{INPUTS},
raw AS (SELECT unnest(s) AS t, unnest(range(1, len(s) + 1)) AS physical_line FROM (SELECT string_split('{_TEXT}', chr(10)) AS s)),
records AS (
  SELECT physical_line, list_transform(regexp_extract_all(t, '("[^"]*"|[^,]*)(,|$)', 1), lambda f: trim(f, ' "')) AS f,
    length(regexp_replace(t, '"[^"]*"|[^,]', '', 'g')) + 1 AS n FROM raw WHERE regexp_replace(t, '[ ,]', '', 'g') <> ''
),
pasted AS (
  SELECT CAST(row_number() OVER (ORDER BY physical_line) AS INT) AS line, CAST(physical_line AS INT) AS physical_line, f[1] AS icode, f[2] AS working_code
  FROM records WHERE n >= 2 AND NOT (lower(f[1]) IN ({_HEADER}) AND lower(f[2]) IN ({_HEADER}))
),
usable AS (SELECT * FROM pasted WHERE icode <> '' AND working_code <> ''),
held AS (
  SELECT p.*, l.working_code AS linked,
    coalesce(l.working_code, (SELECT arg_min(u.working_code, u.line) FROM usable u WHERE u.icode = p.icode AND u.line <= p.line)) AS met FROM pasted p LEFT JOIN links l USING (icode)
)"""


def _outcome(linked: str) -> str:
    usable = "icode <> '' AND working_code <> ''"
    clash = f"coalesce({linked} <> working_code, false)"
    return f"""SELECT line, physical_line, icode, working_code, CASE WHEN NOT ({usable}) THEN 'skipped' WHEN {clash} THEN 'conflict' ELSE 'added' END AS outcome,
  CASE WHEN {usable} AND {clash} THEN {linked} END AS existing FROM held"""


#: The records of the files that are made of all items.
_FILES = f"""{INPUTS},
filed AS (SELECT CAST(icode AS BIGINT) AS k, CAST(icode AS BIGINT) % 6 AS kind, icode AS code, name FROM items),
held AS (
  SELECT r.*, l.working_code AS linked, l.working_code AS met FROM (
    SELECT CAST(row_number() OVER (ORDER BY k) AS INT) AS line, CASE kind WHEN 4 THEN '' ELSE code END AS icode, CASE kind WHEN 1 THEN 'W' || code ELSE code END AS working_code,
      CASE kind WHEN 0 THEN replace(name, 'mg', '"mg", or') WHEN 1 THEN 'first' || chr(10) || 'second, of ' || code WHEN 4 THEN 'no code' ELSE '' END AS dispensed_name FROM filed WHERE kind <> 2
  ) r LEFT JOIN links l USING (icode)
)"""

ORACLES: dict[str, str] = {
    "h_years": f"{INPUTS} SELECT DISTINCT fy FROM h",
    "i_years": f"{INPUTS} SELECT DISTINCT CAST({_FY.format('CAST(o_orderdate AS DATE)')} AS INT) AS fy FROM orders",
    "merged_years": f"{INPUTS} SELECT fy FROM h UNION SELECT CAST({_FY.format('CAST(o_orderdate AS DATE)')} AS INT) FROM orders",
    "h_monthly": _h_vectors(""),
    "i_monthly": _i_vectors(""),
    "h_item_monthly": _h_vectors("AND icode = '7'"),
    "i_item_monthly": f"""{INPUTS}, g AS (SELECT '7' AS working_code, grid.month_idx, coalesce(qty, 0) AS monthly_qty, coalesce(value, 0) AS monthly_value FROM grid LEFT JOIN i ON i.working_code = '7' AND fy = {YEAR} AND i.month_idx = grid.month_idx)
SELECT g.working_code, coalesce(drug_name, '') AS name, sum(monthly_qty) OVER () AS total_qty, sum(monthly_value) OVER () AS total_value, month_idx, monthly_qty, monthly_value,
  CAST(first_value(month_idx) OVER (ORDER BY monthly_value DESC, month_idx DESC) + 1 AS INT) AS peak_fiscal_month FROM g LEFT JOIN catalog USING (working_code)""",
    "h_top_drugs": f"""{INPUTS}, t AS (SELECT icode, {_D.format("qty")} AS total_qty FROM h WHERE fy = {YEAR} GROUP BY icode ORDER BY total_qty DESC, icode LIMIT {TOP}),
c AS (SELECT t.icode, month, coalesce(qty, 0) AS q FROM t CROSS JOIN (SELECT unnest(range(1, 13)) AS month) LEFT JOIN h ON h.icode = t.icode AND fy = {YEAR} AND month_idx = (month + 2) % 12)
SELECT t.icode, name, total_qty, CAST((SELECT month FROM c WHERE c.icode = t.icode ORDER BY q DESC, month DESC LIMIT 1) AS INT) AS peak_calendar_month FROM t JOIN items USING (icode)""",
    "i_top_drugs": f"""{INPUTS}, t AS (SELECT working_code, {_D.format("value")} AS total_value FROM i WHERE fy = {YEAR} GROUP BY working_code ORDER BY total_value DESC, working_code LIMIT {TOP}),
c AS (SELECT t.working_code, grid.month_idx, coalesce(value, 0) AS v FROM t CROSS JOIN grid LEFT JOIN i ON i.working_code = t.working_code AND fy = {YEAR} AND i.month_idx = grid.month_idx),
p AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY working_code ORDER BY v DESC, month_idx DESC) = 1)
SELECT t.working_code, coalesce(drug_name, '') AS name, total_value, CAST(p.month_idx + 1 AS INT) AS peak_fiscal_month, p.v AS peak_value FROM t JOIN p USING (working_code) LEFT JOIN catalog USING (working_code)""",
    "h_year_summary": f"{INPUTS} SELECT coalesce({_D.format('qty')}, 0) AS total_qty, count(DISTINCT icode) AS unique_drug_count FROM h WHERE fy = {YEAR}",
    "i_year_summary": f"""{INPUTS}, g AS (SELECT grid.month_idx, coalesce({_D.format("value")}, 0) AS v FROM grid LEFT JOIN i ON i.month_idx = grid.month_idx AND fy = {YEAR} GROUP BY 1)
SELECT {_D.format("v")} AS total_value, (SELECT count(DISTINCT working_code) FROM lines WHERE value > 0 AND {_FY.format("d")} = {YEAR}) AS unique_drug_count,
  CAST((SELECT month_idx + 1 FROM g ORDER BY v DESC, month_idx DESC LIMIT 1) AS INT) AS peak_fiscal_month, max(v) AS peak_value FROM g""",
    "h_search": f"{INPUTS} SELECT icode, name FROM items WHERE contains(icode, '{TERM}') OR contains(lower(name), '{TERM}') ORDER BY name, icode LIMIT 50",
    "i_search": f"{INPUTS} SELECT working_code, drug_name FROM catalog WHERE starts_with(lower(working_code), '{TERM}') OR contains(lower(drug_name), '{TERM}') ORDER BY working_code, drug_name LIMIT 30",
    "i_search_wildcard_indexed": f"{INPUTS} SELECT working_code, drug_name FROM catalog WHERE lower(working_code) LIKE '{WILD}%' OR lower(drug_name) LIKE '%{WILD}%' ORDER BY working_code, drug_name LIMIT 30",
    "i_search_wildcard": f"{INPUTS} SELECT working_code, drug_name FROM catalog WHERE lower(working_code) LIKE 'r_ng%' OR lower(drug_name) LIKE '%r_ng%' ORDER BY working_code, drug_name LIMIT 30",
    "mapping_rows": f"{INPUTS}, {_PAGE} SELECT * FROM listed",
    "mapping_rows_unmapped": f"{INPUTS}, {_PAGE} SELECT * FROM listed WHERE status = 'unmapped'",
    "mapping_next_unmapped": f"""{INPUTS}, {_PAGE}, o AS (SELECT *, row_number() OVER (ORDER BY drug_name, icode) AS n FROM listed)
SELECT icode, status, (SELECT icode FROM o x WHERE x.n > o.n AND x.status = 'unmapped' ORDER BY x.n LIMIT 1) AS next_icode FROM o""",
    "mapping_status_by_icode": f"{INPUTS} {_STATUS.format('links', 'exclusions')}",
    "mapping_status_by_code": f"{INPUTS} SELECT c.working_code, CASE WHEN l.icode IS NULL THEN 'unmapped' ELSE 'mapped' END AS status, l.icode, l.match_method FROM catalog c LEFT JOIN links l USING (working_code)",
    "mapping_stats": f"""{INPUTS} SELECT count(*) AS total, (SELECT count(*) FROM exclusions) AS exclusions, count(*) FILTER (match_method = 'auto') AS n_auto,
  count(*) FILTER (match_method = 'manual') AS n_manual, count(*) FILTER (match_method = 'approved') AS n_approved FROM links""",
    "mapping_unmapped": f"{INPUTS} SELECT * FROM items WHERE icode NOT IN (SELECT icode FROM links) AND icode NOT IN (SELECT icode FROM exclusions)",
    "mapping_upsert": f"""{INPUTS}, good AS (SELECT working_code AS icode FROM catalog WHERE length(drug_name) <= 18),
l2 AS (SELECT icode, working_code, match_method FROM links WHERE icode NOT IN (FROM good) UNION ALL SELECT icode, 'W' || icode, 'manual' FROM good),
e2 AS (SELECT * FROM exclusions WHERE icode NOT IN (FROM good)) {_STATUS.format("l2", "e2")}""",
    "mapping_rejected": f"""{INPUTS}, kinds AS (
  SELECT unnest(['no code', 'null code', 'no other code', 'unknown method', 'no method', 'no number', 'above', 'below']) AS kind, working_code AS c, drug_name AS name FROM catalog
)
SELECT kind, CASE kind WHEN 'no code' THEN chr(12288) WHEN 'null code' THEN NULL ELSE c END AS icode, name, CAST(CASE kind WHEN 'no code' THEN 0.5 WHEN 'null code' THEN 0.5 WHEN 'no other code' THEN NULL
  WHEN 'no number' THEN -99 WHEN 'above' THEN 1.0::DOUBLE + c::DOUBLE / 1e6 WHEN 'below' THEN -(c::DOUBLE) ELSE 1 END AS DOUBLE) AS match_score FROM kinds""",
    "mapping_checked": f"""{INPUTS}, good AS (SELECT working_code AS icode FROM catalog),
l2 AS (SELECT icode, working_code, match_method FROM links WHERE icode NOT IN (FROM good) UNION ALL SELECT icode, 'V' || icode, 'auto' FROM good),
e2 AS (SELECT * FROM exclusions WHERE icode NOT IN (FROM good)) {_STATUS.format("l2", "e2")}""",
    "mapping_exclude": f"""{INPUTS}, l2 AS (SELECT * FROM links WHERE match_method <> 'auto'),
e2 AS (SELECT icode, 'mark ' || name AS reason FROM items WHERE icode NOT IN (SELECT icode FROM l2))
SELECT icode, status, working_code, reason FROM ({_STATUS.format("l2", "e2")})""",
    "mapping_remove": f"{INPUTS} SELECT icode, working_code, match_method FROM links WHERE NOT (icode = '7' AND working_code = '7')",
    "mapping_include": f"{INPUTS} SELECT * FROM exclusions WHERE icode <> '25'",
    "reconcile_year": f"{INPUTS}{_RECONCILE} {_YEAR_COLUMNS}",
    "reconcile_month": f"{INPUTS}{_RECONCILE} SELECT icode, working_code, fy, month_idx, d AS dispensed_qty, q AS purchased_qty, v AS purchased_value, round(price, 6) AS price, delta, round(stock, 6) AS stock FROM mp WHERE fy = {YEAR}",
    "reconcile_flags": f"{INPUTS}{_RECONCILE} SELECT * FROM flags",
    "reconcile_flag_texts": f"""{INPUTS}{_RECONCILE} SELECT icode, kind, month,
  round(CASE gap WHEN 'overstock' THEN purchased_qty - dispensed_qty WHEN 'overuse' THEN dispensed_qty - purchased_qty END, 6) AS residue,
  round(CASE WHEN gap = 'overstock' THEN (purchased_qty / dispensed_qty - 1) * 100 END, 6) AS overstock_percent,
  round(CASE WHEN kind = 'unit-price-spike' THEN purchased_value / purchased_qty END, 6) AS spike_price FROM flags WHERE fy = {YEAR}""",
    "reconcile_headline": f"""{INPUTS}{_RECONCILE} SELECT icode, working_code, fy, year_dispensed, year_purchased_qty, year_value, unit_price_year, coverage_ratio,
  coalesce(coverage_ratio < 0.75 OR coverage_ratio > 1.25, false) AS coverage_warning, n_flags FROM ({_YEAR_COLUMNS}) WHERE fy = {YEAR}""",
    "reconcile_item": f"{INPUTS}{_RECONCILE} SELECT * FROM ({_YEAR_COLUMNS}) WHERE fy = {YEAR} AND icode = '7'",
    "stock_curve": f"""{INPUTS}, c AS (SELECT icode AS code, fy, month_idx, -qty AS q FROM h UNION ALL SELECT working_code, fy, month_idx, qty FROM i),
k AS (SELECT DISTINCT code, fy FROM c),
m AS (SELECT k.code, k.fy, grid.month_idx, coalesce({_D.format("q")}, 0) AS delta FROM k CROSS JOIN grid LEFT JOIN c ON c.code = k.code AND c.fy = k.fy AND c.month_idx = grid.month_idx GROUP BY ALL)
SELECT *, round(CAST(sum(CAST(delta AS DECIMAL(18,2))) OVER (PARTITION BY code, fy ORDER BY month_idx) AS DOUBLE), 6) AS stock FROM m""",
    "moving_average": f"""{INPUTS}, m AS (SELECT k.icode, k.fy, grid.month_idx, coalesce(qty, 0) AS qty FROM (SELECT DISTINCT icode, fy FROM h) k CROSS JOIN grid LEFT JOIN h ON h.icode = k.icode AND h.fy = k.fy AND h.month_idx = grid.month_idx)
SELECT *, round(avg(qty) OVER (PARTITION BY icode, fy ORDER BY month_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS average FROM m""",
    "month_share": f"""{INPUTS}, m AS (SELECT k.icode, k.fy, grid.month_idx, coalesce(qty, 0) AS qty FROM (SELECT DISTINCT icode, fy FROM h) k CROSS JOIN grid LEFT JOIN h ON h.icode = k.icode AND h.fy = k.fy AND h.month_idx = grid.month_idx)
SELECT *, round(qty / greatest(sum(qty) OVER (PARTITION BY icode, fy), 1) * 100, 1) AS percent, {_LABELS}[month_idx + 1] AS label FROM m""",
    "default_years": f"{INPUTS} SELECT icode, CAST(CASE WHEN bool_or(fy = {YEAR}) THEN {YEAR} ELSE coalesce(max(fy), {YEAR}) END AS INT) AS fy FROM items LEFT JOIN h USING (icode) GROUP BY icode",
    "years_back": f"""{INPUTS}, y AS (SELECT fy FROM h UNION SELECT CAST({_FY.format('CAST(o_orderdate AS DATE)')} AS INT) FROM orders)
SELECT fy, CAST({_FY.format('current_date')} - fy AS INT) AS back FROM y""",
    "months_reordered": f"""{INPUTS}, k AS (SELECT DISTINCT icode, fy FROM h)
SELECT k.icode, k.fy, grid.month_idx, coalesce(qty, 0) AS qty FROM k CROSS JOIN grid LEFT JOIN h ON h.icode = k.icode AND h.fy = k.fy AND h.month_idx = grid.month_idx""",
    "terms_escaped": f"""{INPUTS}, n AS (SELECT CAST(icode AS BIGINT) AS k, translate(name, 'aei', '%_~') AS odd FROM items), t AS (SELECT *, substr(odd, 2, 8) AS part FROM n)
SELECT t.k, replace(replace(replace(part, '~', '~~'), '%', '~%'), '_', '~_') AS escaped, contains(t.odd, part) AS own, contains(n.odd, part) AS found FROM t JOIN n ON n.k = t.k + 1""",
    "names_normalized": f"{INPUTS} SELECT icode, {_norm('name')} AS normalized, {_term('name')} AS term FROM items",
    "similarity_pairs": f"""{INPUTS}, n AS (SELECT CAST(icode AS BIGINT) AS k, name, {_norm("name")} AS a FROM items)
SELECT x.k, x.name AS name_a, y.name AS name_b, round({_score("x.a", "y.a")}, 6) AS score FROM n x JOIN n y ON y.k = x.k + 1""",
    "similarity_thai": f"""WITH RECURSIVE {INPUTS.removeprefix(chr(10) + "WITH")},
spelled AS (SELECT CAST(icode AS BIGINT) AS k, translate(icode, '0123456789', 'กขคงจฉชซฌญ') AS s FROM items),
pairs AS (SELECT p.k, 'ยาน' || p.s || 'มฟ' AS name_a, 'ด' || n.s || 'หลู' AS name_b FROM spelled p JOIN spelled n ON n.k = p.k + 1),
words AS (SELECT k, string_split(name_a, '') AS a, string_split(name_b, '') AS b FROM pairs),
steps AS (
  SELECT k, a, b, 0 AS i, range(len(b) + 1) AS costs FROM words
  UNION ALL SELECT k, a, b, i + 1, list_transform(range(len(b) + 1), lambda j: j + list_min(list_transform(range(j + 1), lambda t:
    CASE WHEN t = 0 THEN i + 1 ELSE least(costs[t + 1] + 1, costs[t] + CASE WHEN a[i + 1] = b[t] THEN 0 ELSE 1 END) - t END))) FROM steps WHERE i < len(a)
)
SELECT k, name_a, name_b, round(1.0::DOUBLE - costs[len(b) + 1] / greatest(len(a), len(b)), 6) AS score FROM steps JOIN pairs USING (k) WHERE i = len(a)""",
    "suggest_candidates": f"{INPUTS}, named AS (SELECT icode, name AS drug_name FROM items){_candidates('named', None)} SELECT * REPLACE (round(score, 6) AS score) FROM ranked WHERE rank <= {TOP}",
    "auto_match_preview": f"{INPUTS}, {_PAGE}, open_rows AS (SELECT icode, drug_name FROM listed WHERE status = 'unmapped'){_candidates('open_rows', 10)} SELECT icode, drug_name, working_code, candidate_name, round(score, 6) AS score FROM ranked WHERE rank = 1 AND score >= 0.6",
    "auto_match_default": f"{_NEAR} SELECT icode, drug_name, working_code, candidate_name, round(score, 6) AS score FROM ranked WHERE rank = 1 AND score >= 0.95",
    "auto_match_apply": f"""{_MATCHED}, new AS (SELECT icode, working_code, 'auto' AS match_method FROM ranked WHERE rank = 1 AND score >= 0.6),
l2 AS (SELECT icode, working_code, match_method FROM links WHERE icode NOT IN (SELECT icode FROM new) UNION ALL FROM new) {_STATUS.format("l2", "exclusions")}""",
    "names_thai": f"""{INPUTS}, n AS (
  SELECT icode, {_norm("name")} AS plain, CAST(unnest(range(4)) AS INT) AS way,
    unnest([name || ' (พาราเซตามอล ' || icode || ' มก.)', substr(name, 1, 3) || '(' || icode || 'mg)' || substr(name, 4), 'บรรจุ ธารา ' || name || ' ๕๐๐ มก. (ยาเม็ด)', name || ' (ตรึม']) AS text FROM items
), m AS (SELECT icode, way, plain, {_thai("text")} AS normalized FROM n)
SELECT icode, way, normalized, round({_score("plain", "normalized")}, 6) AS score FROM m""",
    "bulk_import_classified": f"{_IMPORT} {_outcome('linked')}",
    "bulk_import_applied": f"{_IMPORT} {_outcome('met')}",
    "bulk_import_counters": f"""{_IMPORT} SELECT count(*) AS total, count(*) FILTER (outcome = 'added') AS added, count(*) FILTER (outcome = 'skipped') AS skipped,
  count(*) FILTER (outcome = 'conflict') AS conflicts, (SELECT count(*) FROM records WHERE n < 2) AS errors FROM ({_outcome('linked')})""",
    "bulk_import_after": f"""{_IMPORT}, added AS (SELECT icode, arg_max(working_code, line) AS working_code, 'approved' AS match_method FROM ({_outcome('met')}) WHERE outcome = 'added' GROUP BY icode),
l2 AS (SELECT icode, working_code, match_method FROM links WHERE icode NOT IN (SELECT icode FROM added) UNION ALL FROM added),
e2 AS (SELECT * FROM exclusions WHERE icode NOT IN (SELECT icode FROM added)) {_STATUS.format("l2", "e2")}""",
    "bulk_files_classified": f"{_FILES} {_outcome('linked')}".replace("physical_line", "dispensed_name"),
    "bulk_files_counters": f"""{_FILES} SELECT count(*) AS total, count(*) FILTER (outcome = 'added') AS added, count(*) FILTER (outcome = 'skipped') AS skipped,
  count(*) FILTER (outcome = 'conflict') AS conflicts, (SELECT count(*) FROM filed WHERE kind = 2) AS errors FROM ({_outcome('linked').replace('physical_line', 'dispensed_name')})""",
    "bulk_files_after": f"""{_FILES}, added AS (SELECT icode, working_code, 'approved' AS match_method FROM ({_outcome('met').replace('physical_line', 'dispensed_name')}) WHERE outcome = 'added'),
l2 AS (SELECT icode, working_code, match_method FROM links WHERE icode NOT IN (SELECT icode FROM added) UNION ALL FROM added),
e2 AS (SELECT * FROM exclusions WHERE icode NOT IN (SELECT icode FROM added)) {_STATUS.format("l2", "e2")}""",
    "number_texts": """WITH q AS (SELECT DISTINCT l_quantity AS qty, l_quantity / 8 AS q FROM lineitem WHERE l_linestatus = 'F')
SELECT qty, regexp_replace(regexp_replace(format('{:,.2f}', q * 1000), '0+$', ''), '\\.$', '') AS quantity, '฿' || format('{:,.0f}', q * 100000) AS baht,
  CASE WHEN q > 3 THEN '+' ELSE '' END || regexp_replace(regexp_replace(format('{:,.2f}', q - 3), '0+$', ''), '\\.$', '') AS signed,
  round(pow(10, floor(log10(q))) * CASE WHEN q / pow(10, floor(log10(q))) < 1.5 THEN 1 WHEN q / pow(10, floor(log10(q))) < 3 THEN 2 WHEN q / pow(10, floor(log10(q))) < 7 THEN 5 ELSE 10 END, 6) AS step,
  CASE WHEN qty * 100 >= 1000 THEN format('{:.1f}', qty * 100 / 1000) || 'K' ELSE CAST(CAST(round(qty * 100) AS BIGINT) AS VARCHAR) END AS label FROM q""",
}


def oracle_sql() -> dict[str, str]:
    same = {f"{name}_by_year": name for name in BY_YEAR} | {f"{name}_kept": name for name in ("h_monthly", "i_monthly")} | {f"{name}_indexed": name for name in ("h_search", "i_search")} | {"mapping_stored": "mapping_upsert"}
    return ORACLES | {name: ORACLES[plain] for name, plain in same.items()}
