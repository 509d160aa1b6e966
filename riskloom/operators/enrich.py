"""Threat lookup (J01), frequency encodings (W01–W03) and the feature frame.

Frequencies are ``groupBy(key).count()`` (partial aggregation, so a key that
holds a third of the rows is collapsed map-side) joined back through a
size-checked broadcast.  A ``count().over(partitionBy(key))`` window would
instead shuffle every row to the task of its key, which is exactly the skew
failure mode on few-valued keys such as region or industry.

The threat name and the threat frequency share one key: the frequency table
is joined to the catalogue first (one row per code) and the result is joined
onto the incidents once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import calendar as cal
from riskloom.functions.text import join_key
from riskloom.operators.joins import bounded_broadcast
from riskloom.session import reliable_checkpoint


def threat_names(threats: DataFrame, code_col: str = "threat_code") -> DataFrame:
    """Catalogue as (code, threat_name) — key normalised as in S09."""
    return threats.select(F.col("threat_id").cast("int").alias(code_col), F.col("name").alias("threat_name"))


def join_threat_names(incidents: DataFrame, threats: DataFrame, code_col: str = "threat_code") -> DataFrame:
    """Left join incident → threat name; unmatched incidents keep a null name."""
    return incidents.join(bounded_broadcast(threat_names(threats, code_col)), code_col, "left")


def frequency(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def add_frequency(df: DataFrame, key: str, name: str) -> DataFrame:
    """Size of the row's group on every row (pandas ``transform('count')``)."""
    return df.join(bounded_broadcast(frequency(df, key, name)), key, "left")


def add_threat_lookup(df: DataFrame, threats: DataFrame, code_col: str = "threat_code") -> DataFrame:
    """J01 + W03 in one join: threat_name and threat_freq on every incident."""
    lookup = frequency(df, code_col, "threat_freq").join(threat_names(threats, code_col), code_col, "left")
    return df.join(bounded_broadcast(lookup), code_col, "left")


def frequencies(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """All frequency tables in one pass: (set, key, n) for every ``name -> key`` in ``keys``.

    Each row is exploded into one (set, key-as-text) pair per key and a single
    grouped count (partial aggregation) produces every table at once.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("set"), F.col(k).cast("string").alias("key"))
                                for name, k in keys.items()]))
    return df.select(pairs.alias("p")).select("p.*").groupBy("set", "key").agg(F.count(F.lit(1)).alias("n"))


def feature_frame(incidents: DataFrame, threats: DataFrame) -> DataFrame:
    """The analysis frame: incident columns, calendar, threat name and the 14 features.

    The three frequencies come from one pass (:func:`frequencies`); each table is checked
    for size by itself, so that a large threat table does not keep the others from being broadcast; the
    threat catalogue joins onto the small threat-frequency table, not onto the incidents.
    """
    df = cal.with_calendar(incidents)
    keys = {"threat_freq": "threat_code", "region_freq": "region", "industry_freq": "enterprise_type"}
    freq = reliable_checkpoint(frequencies(df, keys))
    for name, key in keys.items():
        dtype = dict(df.dtypes)[key]
        part = freq.where(F.col("set") == name).select(F.col("key").cast(dtype).alias(key), F.col("n").alias(name))
        if name == "threat_freq":
            part = part.join(threat_names(threats, key).hint("merge"), key, "left")
        df = df.join(bounded_broadcast(part), key, "left")
    df = cal.with_time_flags(df)
    df = df.withColumns(_combined_keys())
    return cal.with_cyclic(df)


def _combined_keys() -> dict:
    return {
        "region_industry": join_key("region", "enterprise_type"),
        "industry_threat": join_key("enterprise_type", "threat_code"),
    }


def categorical_frame(incidents: DataFrame) -> DataFrame:
    """Incident columns, calendar and the combined keys: every categorical column
    of :func:`feature_frame`, without its frequency pass and catalogue join."""
    return cal.with_calendar(incidents).withColumns(_combined_keys())
