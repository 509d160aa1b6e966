"""Table access and the fixture views built on the driver tables.

The incident and threat tables of the reference are re-expressed as views over
the TPC-H-like parquet tables (see FIXTURES.md):

* ``incidents_ev`` – events ⋈ customer ⋈ nation: true time of day, unique times,
  one month; also the stream source.
* ``incidents_li`` – lineitem ⋈ orders ⋈ customer ⋈ nation: twelve months,
  duplicate upsert keys, the bench-size table.
* ``all_threats`` / ``whole_catalog`` – every part row; names repeat.
* ``threats`` / ``threat_catalog`` – the same with gaps, for the jobs whose point is a missing
  threat (the incident → threat join and what follows from it, upserts of new threats).

Joins carry no broadcast hint except for ``nation`` (the fixed 25-row TPC-H
dimension): customer, orders and part grow with the scale factor, so adaptive
execution decides at run time from the measured shuffle size whether a side
is small enough to broadcast, and uses a sort-merge join otherwise.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def incidents_from_events(e: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Incident projection of an event frame (batch or stream; customer and nation are static)."""
    c = customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    n = nation.select("n_nationkey", "n_name")
    dims = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)      # customer-sized, nation fixed (25)
    joined = e.join(dims, e.user_id == dims.c_custkey)
    return joined.select(
        F.col("event_id").alias("incident_id"),
        F.col("c_mktsegment").alias("enterprise_type"),
        F.col("user_id").cast("string").alias("enterprise_code"),
        F.floor("value").cast("int").alias("host_count"),
        F.regexp_extract("props", r"([0-9]+)", 1).cast("int").alias("threat_code"),
        F.when(F.col("event_type").isin("error", "purchase"), 1).otherwise(0).alias("success"),
        F.col("n_name").alias("region"),
        F.col("ts").cast("date").alias("incident_date"),
        F.col("ts").alias("incident_time"),
    )


def incidents_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    return incidents_from_events(e, table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"))


def incidents_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # Dimension side first: orders ⋈ customer ⋈ nation is orders-sized; lineitem then
    # joins it on the order key, so the lineitem-sized rows are shuffled once (by
    # order key) instead of a second time by customer key.  Catalyst keeps the
    # written order when no cost statistics exist, so the order is stated here.
    order_dims = (o.join(c, o.o_custkey == c.c_custkey)
                   .join(F.broadcast(n), c.c_nationkey == n.n_nationkey))
    joined = li.join(order_dims, li.l_orderkey == order_dims.o_orderkey)
    return joined.select(
        F.col("c_mktsegment").alias("enterprise_type"),
        F.col("o_custkey").cast("string").alias("enterprise_code"),
        F.col("l_quantity").cast("int").alias("host_count"),
        F.col("l_partkey").cast("int").alias("threat_code"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("success"),
        F.col("n_name").alias("region"),
        F.col("l_shipdate").cast("date").alias("incident_date"),
        F.timestamp_add("HOUR", (F.col("l_suppkey") % 24).cast("int"), F.col("l_shipdate"))
        .alias("incident_time"),
    )


def all_threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("threat_id"), F.col("p_name").alias("name"))


def threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_threats(spark, sf_dir).where(F.col("threat_id") % 7 != 3)


def threat_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_catalog(spark, sf_dir).where(F.col("threat_id") % 7 != 3)


def whole_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide catalogue with the twelve columns of the threat model."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("threat_id"),
        F.col("p_name").alias("name"),
        F.repeat(F.concat_ws(" ", "p_name", "p_brand", F.lit("")), 3).alias("description"),
        F.concat(F.repeat(F.concat(F.col("p_type"), F.lit(" ")), 2), F.col("p_name"), F.lit(" "),
                 F.col("p_brand")).alias("threat_source"),
        F.col("p_type").alias("target_object"),
        ((F.col("p_size").bitwiseAND(1)) != 0).alias("confidentiality_breach"),
        ((F.col("p_size").bitwiseAND(2)) != 0).alias("integrity_breach"),
        ((F.col("p_size").bitwiseAND(4)) != 0).alias("availability_breach"),
        F.date_add(F.lit("2019-01-01").cast("date"), F.col("p_size")).alias("date_added"),
        F.date_add(F.lit("2023-01-01").cast("date"), F.col("p_size")).alias("last_modified"),
        F.col("p_brand").alias("status"),
        F.when(F.col("p_size") % 2 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("note "), F.col("p_type"))).alias("notes"),
    )


# ---------------------------------------------------------------------------
# The same views as DuckDB text, used by the SQL oracle.
# ---------------------------------------------------------------------------

SQL_INCIDENTS_EV = """
SELECT e.event_id AS incident_id, c.c_mktsegment AS enterprise_type,
       CAST(e.user_id AS VARCHAR) AS enterprise_code, CAST(floor(e.value) AS INT) AS host_count,
       CAST(regexp_extract(e.props,'([0-9]+)',1) AS INT) AS threat_code,
       CASE WHEN e.event_type IN ('error','purchase') THEN 1 ELSE 0 END AS success,
       n.n_name AS region, CAST(e.ts AS DATE) AS incident_date, e.ts AS incident_time
FROM events e JOIN customer c ON e.user_id = c.c_custkey
              JOIN nation n ON c.c_nationkey = n.n_nationkey
"""

SQL_INCIDENTS_LI = """
SELECT c.c_mktsegment AS enterprise_type, CAST(o.o_custkey AS VARCHAR) AS enterprise_code,
       CAST(l.l_quantity AS INT) AS host_count, CAST(l.l_partkey AS INT) AS threat_code,
       CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS success, n.n_name AS region,
       CAST(l.l_shipdate AS DATE) AS incident_date,
       l.l_shipdate + to_hours(CAST(l.l_suppkey % 24 AS INT)) AS incident_time
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                JOIN customer c ON o.o_custkey = c.c_custkey
                JOIN nation n ON c.c_nationkey = n.n_nationkey
"""

SQL_ALL_THREATS = """
SELECT CAST(p_partkey AS INT) AS threat_id, p_name AS name FROM part
"""

SQL_WHOLE_CATALOG = """
SELECT CAST(p_partkey AS INT) AS threat_id, p_name AS name,
       repeat(p_name || ' ' || p_brand || ' ', 3) AS description,
       repeat(p_type || ' ', 2) || p_name || ' ' || p_brand AS threat_source,
       p_type AS target_object,
       (p_size & 1) <> 0 AS confidentiality_breach,
       (p_size & 2) <> 0 AS integrity_breach,
       (p_size & 4) <> 0 AS availability_breach,
       CAST(DATE '2019-01-01' + CAST(p_size AS INT) AS DATE) AS date_added,
       CAST(DATE '2023-01-01' + CAST(p_size AS INT) AS DATE) AS last_modified,
       p_brand AS status,
       CASE WHEN p_size % 2 = 0 THEN NULL ELSE 'note ' || p_type END AS notes
FROM part
"""

_GAPS = " WHERE p_partkey % 7 <> 3"

SQL_VIEWS = {
    "incidents_ev": SQL_INCIDENTS_EV,
    "incidents_li": SQL_INCIDENTS_LI,
    "all_threats": SQL_ALL_THREATS,
    "whole_catalog": SQL_WHOLE_CATALOG,
    "threats": SQL_ALL_THREATS + _GAPS,
    "threat_catalog": SQL_WHOLE_CATALOG + _GAPS,
}


def with_views(sql: str, *names: str) -> str:
    """Prefix a DuckDB query with the fixture views it uses as CTEs."""
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names)
    return f"WITH {ctes}\n{sql}"


def catalog_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later catalogue batch: revised rows for large parts, including ids absent before."""
    p = table(spark, sf_dir, "part").where(F.col("p_size") > 25)
    base = p.select(
        F.col("p_partkey").cast("int").alias("threat_id"),
        F.concat(F.col("p_name"), F.lit(" (rev)")).alias("name"),
        F.repeat(F.concat_ws(" ", "p_name", "p_brand", F.lit("")), 3).alias("description"),
        F.concat(F.repeat(F.concat(F.col("p_type"), F.lit(" ")), 2), F.col("p_name"), F.lit(" "),
                 F.col("p_brand")).alias("threat_source"),
        F.col("p_type").alias("target_object"),
        ((F.col("p_size").bitwiseAND(1)) != 0).alias("confidentiality_breach"),
        ((F.col("p_size").bitwiseAND(2)) != 0).alias("integrity_breach"),
        ((F.col("p_size").bitwiseAND(4)) != 0).alias("availability_breach"),
        F.date_add(F.lit("2019-01-01").cast("date"), F.col("p_size")).alias("date_added"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).alias("last_modified"),
        F.concat(F.lit("rev "), F.col("p_brand")).alias("status"),
        F.lit(None).cast("string").alias("notes"),
    )
    return base


SQL_CATALOG_REVISION = """
SELECT CAST(p_partkey AS INT) AS threat_id, p_name || ' (rev)' AS name,
       repeat(p_name || ' ' || p_brand || ' ', 3) AS description,
       repeat(p_type || ' ', 2) || p_name || ' ' || p_brand AS threat_source,
       p_type AS target_object,
       (p_size & 1) <> 0 AS confidentiality_breach,
       (p_size & 2) <> 0 AS integrity_breach,
       (p_size & 4) <> 0 AS availability_breach,
       CAST(DATE '2019-01-01' + CAST(p_size AS INT) AS DATE) AS date_added,
       CAST(DATE '2024-01-01' + CAST(p_size AS INT) AS DATE) AS last_modified,
       'rev ' || p_brand AS status,
       CAST(NULL AS VARCHAR) AS notes
FROM part WHERE p_size > 25
"""
SQL_VIEWS["catalog_revision"] = SQL_CATALOG_REVISION
