"""Common table expressions for the checking SQL (DuckDB)."""

from __future__ import annotations

import re

# name -> text; an expression may use any other by name.
CTES: dict[str, str] = {}

CTES["wide_lines"] = """
SELECT lower(n_name) AS ccaa_slug,
  CASE WHEN n_nationkey % 3 <> 0 THEN CAST(c_custkey % 10 AS VARCHAR) END AS entidad_id,
  CAST(year(o_orderdate) AS INTEGER) AS anio,
  CASE WHEN n_nationkey % 2 = 0 THEN CAST(quarter(o_orderdate) AS INTEGER) END AS trimestre,
  CASE WHEN n_nationkey % 5 <> 4 THEN CAST(1 + l_partkey % 9 AS INTEGER) END AS capitulo_id,
  CASE WHEN n_nationkey % 4 = 0 THEN substr(o_orderpriority, 1, 1) END AS grupo_funcional_id,
  'ds/' || CAST(l_suppkey % 5 AS VARCHAR) AS dataset_uri,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS PRE,
  CASE WHEN n_nationkey % 7 <> 6 THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 + CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(18,2)) END AS CRE,
  CASE WHEN l_linestatus = 'F' AND n_nationkey % 6 <> 5
    THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2)) END AS OBR,
  CASE WHEN l_linestatus = 'F' AND n_nationkey % 6 <> 5 AND l_returnflag = 'R'
    THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2)) END AS PAG
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey"""

CTES["fact"] = """
SELECT ccaa_slug, entidad_id, anio, trimestre, capitulo_id, grupo_funcional_id, dataset_uri, fase, importe_eur
FROM (
  SELECT *, 'PRE' AS fase, PRE AS importe_eur FROM wide_lines
  UNION ALL SELECT *, 'CRE', CRE FROM wide_lines
  UNION ALL SELECT *, 'OBR', OBR FROM wide_lines
  UNION ALL SELECT *, 'PAG', PAG FROM wide_lines) WHERE importe_eur IS NOT NULL"""

CTES["wide"] = """
SELECT ccaa_slug, entidad_id, anio, trimestre, capitulo_id, grupo_funcional_id,
  CAST(sum(importe_eur) FILTER (fase = 'PRE') AS DOUBLE) AS PRE,
  CAST(sum(importe_eur) FILTER (fase = 'CRE') AS DOUBLE) AS CRE,
  CAST(sum(importe_eur) FILTER (fase = 'ARN') AS DOUBLE) AS ARN,
  CAST(sum(importe_eur) FILTER (fase = 'DIS') AS DOUBLE) AS DIS,
  CAST(sum(importe_eur) FILTER (fase = 'OBR') AS DOUBLE) AS OBR,
  CAST(sum(importe_eur) FILTER (fase = 'PAG') AS DOUBLE) AS PAG
FROM fact GROUP BY ALL"""

CTES["feat"] = """
SELECT *, PRE - OBR AS brecha_eur, (PRE - OBR) / nullif(PRE, 0) AS brecha_pct,
  CRE / nullif(PRE, 0) AS ratio_cre_pre, OBR / nullif(CRE, 0) AS ejecutado_pct,
  PAG / nullif(OBR, 0) AS pago_pct,
  lag(OBR, 1) OVER w AS obr_lag_1, lag(OBR, 2) OVER w AS obr_lag_2,
  lag(OBR, 3) OVER w AS obr_lag_3, lag(OBR, 4) OVER w AS obr_lag_4,
  avg(OBR) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS obr_rolling4_mean,
  stddev_samp(OBR) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS obr_rolling4_std,
  sin(2 * pi() * coalesce(trimestre, 0) / 4.0) AS q_sin, cos(2 * pi() * coalesce(trimestre, 0) / 4.0) AS q_cos
FROM wide
WINDOW w AS (PARTITION BY ccaa_slug, entidad_id, capitulo_id, grupo_funcional_id
  ORDER BY anio NULLS LAST, trimestre NULLS LAST)"""

CTES["clean_feat"] = """
SELECT * FROM feat WHERE NOT coalesce(abs(PRE) > 1e11, false) AND NOT coalesce(abs(CRE) > 1e11, false)
  AND NOT coalesce(abs(OBR) > 1e11, false) AND NOT coalesce(abs(PAG) > 1e11, false)"""


def _used(text: str) -> list[str]:
    return [name for name in CTES if re.search(rf"\b{name}\b", text)]


def check(body: str) -> str:
    """`body` with the expressions it names, directly or through others, put
    before it in the order they need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in _used(CTES[name]):
            if other != name:
                visit(other)
        ordered.append(name)

    for name in _used(body):
        visit(name)
    if not ordered:
        return body.strip()
    head = ",\n".join(f"{name} AS ({CTES[name].strip()})" for name in ordered)
    return f"WITH {head}\n{body.strip()}"
