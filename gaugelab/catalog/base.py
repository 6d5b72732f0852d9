"""Registry of runnable queries, each with its reference SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


# Share of the last decimal added before rounding: averages of short decimals end in exact
# halves, which the last bit of a sum would send up on one engine and down on the other.
NUDGE = 0.0137


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to a fixed number of decimals, so that summation order cannot show."""
    nudge = NUDGE * 10.0**-digits
    return df.select(*[F.round(F.col(f"`{f.name}`") + nudge, digits).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def query(name: str, sql: str | None = None, floats: str | list[str] = "", digits: int = DIGITS) -> Callable[[Query], Query]:
    """Register a query; ``floats`` lists the double columns its SQL returns."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir), digits)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            nudge = NUDGE * 10.0**-digits
            replaced = ", ".join(f'round("{c}" + CAST({nudge!r} AS DOUBLE), {digits}) + 0.0 AS "{c}"' for c in (floats.split() if isinstance(floats, str) else floats))
            ORACLES[name] = f"SELECT * REPLACE ({replaced}) FROM ({sql}) q" if replaced else sql
        return fn

    return register


def duck_word(*keys: str, start: int = 1) -> str:
    """SQL for eight hex digits of the MD5 of the joined keys, as a number in (0, 1)."""
    return f"((CAST(concat('0x', substr(md5(concat_ws('|', {', '.join(keys)})), {start}, 8)) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE))"


def duck_normal(*keys: str) -> str:
    return f"(sqrt(-2.0 * ln({duck_word(*keys)})) * cos(2.0 * pi() * {duck_word(*keys, start=9)}))"


SENSORS = """sensors AS (
  SELECT *, CASE WHEN y = 1 THEN 'Bad' ELSE 'Good' END AS "Class" FROM (
    SELECT *, CASE WHEN (CASE Fruit WHEN 'view' THEN Temp > 40 WHEN 'click' THEN Humidity > 50 WHEN 'error' THEN Light <= 60
        WHEN 'signup' THEN CO2 > 720 ELSE Temp > 30 AND Humidity <= 70 END) <> (id % 23 = 0) THEN 1 ELSE 0 END AS y
    FROM (SELECT event_id AS id, event_type AS Fruit, value AS Temp, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS Humidity,
        CAST(user_id AS DOUBLE) AS Light, CAST(hour(ts) * 60 + minute(ts) AS DOUBLE) AS CO2 FROM events)))"""

GAUGES = """gauges AS (
  SELECT l_quantity AS Temp, CAST(100 AS DOUBLE) * l_discount AS Humidity, l_extendedprice AS Light, CAST(100 AS DOUBLE) * l_tax AS CO2,
    l_returnflag AS Fruit, CASE WHEN l_linestatus = 'O' THEN 'Bad' ELSE 'Good' END AS "Class" FROM lineitem)"""

RAW = f"""{SENSORS}, raw AS (
  SELECT Fruit, CAST(floor(Temp / 10) AS DOUBLE) AS Temp, CAST(floor(Humidity / 10) AS BIGINT) AS Humidity, CAST(floor(Light / 50) AS BIGINT) AS Light,
    CAST(floor(CO2 / 360) AS BIGINT) AS CO2, CASE id % 4 WHEN 0 THEN 'BAD' WHEN 1 THEN ' Bad ' WHEN 2 THEN 'good' ELSE 'Good' END AS label FROM sensors),
named AS (SELECT * EXCLUDE (label), concat(upper(substr(trim(label), 1, 1)), lower(substr(trim(label), 2))) AS "Class" FROM raw)"""


def scored(source: str = "sensors", name: str = "scored") -> str:
    """SQL of the fixed scorers over a frame with the sensor columns."""
    parts = [
        ("S1", "Humidity / 99.0", True),
        ("S2", "CO2 / 1440.0", True),
        ("S3", "1.0 - least(Temp / 100.0, 1.0)", True),
        ("S4", "CASE WHEN id % 7 = 0 THEN CAST(1 AS DOUBLE) - y ELSE CAST(y AS DOUBLE) END", True),
        ("S5", "round(Humidity / 99.0, 1)", True),
        ("S6", "(Temp - 30.0) / 50.0 + (Humidity - 50.0) / 50.0", False),
    ]
    rows = []
    for model, score, proba in parts:
        cut = "0.5" if proba else "0.0"
        rows.append(
            f"SELECT *, '{model}' AS model, CASE WHEN s >= {cut} THEN 1 ELSE 0 END AS y_pred, {'s' if proba else 'CAST(NULL AS DOUBLE)'} AS y_proba, s AS y_score FROM (SELECT *, CAST({score} AS DOUBLE) AS s FROM {source})"
        )
    return f"{name} AS ({' UNION ALL '.join(rows)})"


def unpivoted(source: str, keep: str, name: str = "long", features: tuple[str, ...] = ("Temp", "Humidity", "Light", "CO2")) -> str:
    lead = f"{keep}, " if keep else ""
    return f"{name} AS ({' UNION ALL '.join(f'SELECT {lead}{chr(39)}{f}{chr(39)} AS feature, {f} AS value FROM {source}' for f in features)})"
