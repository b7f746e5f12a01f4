"""The events table seen as trades, in Spark and as a common table expression for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .registry import Tables

TRADES_SQL = """t AS (SELECT event_id AS trade_id, ts, CAST(floor(epoch(ts)) AS BIGINT) AS sec, user_id AS taker,
  event_type AS market, value AS usd, (CAST(round(value * 100) AS BIGINT) % 98 + 1) / 1e2 AS price,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 2 AS side_buy,
  CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 3 = 0 AS INTEGER) AS outcome_yes
  FROM events)"""


def trades(t: Tables) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return t.events.select(
        F.col("event_id").alias("trade_id"), "ts", F.unix_timestamp("ts").alias("sec"),
        F.col("user_id").alias("taker"), F.col("event_type").alias("market"), F.col("value").alias("usd"),
        ((F.round(F.col("value") * 100).cast("bigint") % 98 + 1) / 100.0).alias("price"),
        k.alias("k"), (k % 2).alias("side_buy"), (k % 3 == 0).cast("int").alias("outcome_yes"),
    )


def r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round the named double columns."""
    return df.withColumns({c: F.round(c, digits) for c in cols})

# fixed values: two-sided 95 % Student quantiles for 1 to 10 degrees of freedom, then the leading terms of the series
T_SQL = ("CASE WHEN {dof} <= 10 THEN [12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836, 2.446911851, 2.364624252, "
         "2.306004135, 2.262157163, 2.228138852][{dof}::INTEGER]::DOUBLE ELSE 1.959963984540054 + 2.372271230298562 / {dof} + 2.8224986157396112 / ({dof} * {dof}) "
         "+ 2.555849679507722 / pow({dof}, 3) + 1.5895340533938225 / pow({dof}, 4) END")
