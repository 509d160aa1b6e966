"""DuckDB text shared by the oracle queries: fixture views plus derived CTEs."""

from __future__ import annotations

from riskloom import constants as K
from riskloom.sources.tables import SQL_VIEWS

_W, _SP, _SU = (", ".join(str(m) for m in K.SEASON_MONTHS[s])
                for s in (K.SEASON_WINTER, K.SEASON_SPRING, K.SEASON_SUMMER))


def season_sql(m: str) -> str:
    return (f"CASE WHEN {m} IN ({_W}) THEN '{K.SEASON_WINTER}' WHEN {m} IN ({_SP}) THEN '{K.SEASON_SPRING}' "
            f"WHEN {m} IN ({_SU}) THEN '{K.SEASON_SUMMER}' ELSE '{K.SEASON_AUTUMN}' END")


def cal_cte(src: str) -> str:
    return f"""cal AS (
  SELECT i.*, CAST(hour(incident_time) AS INTEGER) AS hour,
         CAST(isodow(incident_time) - 1 AS INTEGER) AS dow,
         CAST(month(incident_time) AS INTEGER) AS month,
         {season_sql('month(incident_time)')} AS season
  FROM {src} i)"""


FEAT_CTE = """named AS (
  SELECT c.*, t.name AS threat_name FROM cal c LEFT JOIN threats t ON t.threat_id = c.threat_code),
feat AS (
  SELECT n.*,
         CAST(count(*) OVER (PARTITION BY threat_code) AS BIGINT) AS threat_freq,
         CAST(count(*) OVER (PARTITION BY region) AS BIGINT) AS region_freq,
         CAST(count(*) OVER (PARTITION BY enterprise_type) AS BIGINT) AS industry_freq,
         CAST(dow IN (5, 6) AS INTEGER) AS is_weekend,
         CAST(hour >= 22 OR hour <= 5 AS INTEGER) AS night_attack,
         CAST(hour BETWEEN 9 AND 18 AS INTEGER) AS working_hours,
         coalesce(region, 'None') || '_' || coalesce(enterprise_type, 'None') AS region_industry,
         coalesce(enterprise_type, 'None') || '_' || coalesce(CAST(threat_code AS VARCHAR), 'None') AS industry_threat,
         sin(2 * pi() * hour / 24.0) AS hour_sin, cos(2 * pi() * hour / 24.0) AS hour_cos,
         sin(2 * pi() * dow / 7.0) AS dow_sin, cos(2 * pi() * dow / 7.0) AS dow_cos,
         sin(2 * pi() * month / 12.0) AS month_sin, cos(2 * pi() * month / 12.0) AS month_cos
  FROM named n)"""


def q(body: str, src: str = "incidents_li", cal: bool = True, feat: bool = False,
      views: tuple[str, ...] = (), ctes: tuple[str, ...] = (), recursive: bool = False) -> str:
    """Compose ``WITH <views>, cal, [named, feat] <body>`` for DuckDB."""
    names = [src] if src else []
    if feat and "threats" not in names:
        names.append("threats")
    for v in views:
        if v not in names:
            names.append(v)
    out = [f"{n} AS ({SQL_VIEWS[n]})" for n in names]
    if cal or feat:
        out.append(cal_cte(src))
    if feat:
        out.append(FEAT_CTE)
    out.extend(ctes)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(out) + "\n" + body
