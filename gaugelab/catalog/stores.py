"""Round trips through the sources and sinks, each in a folder of its own run."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugelab.catalog.audit import VALUES
from gaugelab.catalog.base import RAW, SENSORS, query, scored
from gaugelab.catalog.modelling import _parts
from gaugelab.catalog.scoring import _SPLIT
from gaugelab.models import zoo
from gaugelab.models.fitted import load_model
from gaugelab.operators import cleaning
from gaugelab.plans.bindings import raw_readings, score_all, sensors
from gaugelab.sources import tables
from gaugelab.storage import run_folder


@query("raw_csv_round_trip", f'WITH {RAW} SELECT Fruit, Temp, CAST(Humidity AS DOUBLE) AS Humidity, CAST(Light AS DOUBLE) AS Light, CAST(CO2 AS DOUBLE) AS CO2, label AS "Class", count(*) AS n FROM raw GROUP BY ALL', "Temp Humidity Light CO2")
def _(spark, sf):
    """Raw rows written as CSV with their malformed headers, read with the fixed schema."""
    path = run_folder(spark, "raw") + ".csv"
    # Blanks around a label are part of the raw data.
    raw_readings(spark, sf).write.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path, header=True)
    named = cleaning.repair_headers(tables.read_raw(spark, path))
    return named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias("n"))


@query("clean_or_stored", f"WITH {RAW} SELECT DISTINCT {VALUES} FROM named", "Temp")
def _(spark, sf):
    """Clean rows stored on the first call and read from the store on the second."""
    raw, stored = run_folder(spark, "raw") + ".parquet", run_folder(spark, "clean")
    raw_readings(spark, sf).write.parquet(raw)
    tables.read_clean(spark, raw, stored)
    return tables.read_clean(spark, raw + "-gone.parquet", stored)


@query("clean_csv_round_trip", f"WITH {RAW} SELECT \"Class\", count(*) AS n FROM (SELECT DISTINCT {VALUES} FROM named) GROUP BY 1")
def _(spark, sf):
    path = run_folder(spark, "clean") + ".csv"
    tables.write_clean(cleaning.clean(raw_readings(spark, sf)), path, "csv")
    return tables.read_result(spark, path).groupBy("Class").agg(F.count(F.lit(1)).alias("n"))


_BY_FRUIT = f"WITH {SENSORS} SELECT Fruit, count(*) AS n, max(Temp) AS hottest FROM sensors GROUP BY 1"


def _by_fruit(spark, sf):
    return sensors(spark, sf).groupBy("Fruit").agg(F.count(F.lit(1)).alias("n"), F.max("Temp").alias("hottest"))


@query("result_csv_round_trip", _BY_FRUIT, "hottest")
def _(spark, sf):
    path = run_folder(spark, "result") + ".csv"
    tables.write_result(_by_fruit(spark, sf), path)
    return tables.read_result(spark, path).select("Fruit", F.col("n").cast("long").alias("n"), "hottest")


@query("json_round_trip", _BY_FRUIT, "hottest")
def _(spark, sf):
    path = run_folder(spark, "lines")
    tables.write_json(_by_fruit(spark, sf), path)
    return spark.read.json(path)


@query("json_text", f"WITH {SENSORS} SELECT '{{\"Fruit\":\"' || Fruit || '\",\"n\":' || count(*) || '}}' AS value FROM sensors GROUP BY Fruit")
def _(spark, sf):
    return tables.as_json(sensors(spark, sf).groupBy("Fruit").agg(F.count(F.lit(1)).alias("n")))


@query(
    "best_params_round_trip",
    f"""WITH {SENSORS}, g AS (SELECT Fruit AS model, count(*) AS n_trials, avg(y) AS best_value FROM sensors GROUP BY 1)
    SELECT model, '{{"depth":' || n_trials || '}}' AS best_params, best_value, n_trials FROM g""",
    "best_value",
)
def _(spark, sf):
    path = run_folder(spark, "best")
    best = sensors(spark, sf).groupBy(F.col("Fruit").alias("model")).agg(F.count(F.lit(1)).alias("n_trials"), F.avg("y").alias("best_value"))
    tables.write_best_params(best.select("model", F.to_json(F.struct(F.col("n_trials").alias("depth"))).alias("best_params"), "best_value", "n_trials"), path)
    return tables.read_best_params(spark, path)


@query("predictions_round_trip", f"WITH {SENSORS}, {scored()} SELECT model, count(*) AS n, CAST(sum(y_pred) AS BIGINT) AS positives FROM scored GROUP BY 1")
def _(spark, sf):
    path = run_folder(spark, "predictions")
    tables.write_predictions(score_all(sensors(spark, sf)).select("id", "y", "model", "y_pred", "y_proba", "y_score"), path)
    return tables.read_predictions(spark, path).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("y_pred").alias("positives"))


@query("saved_model_round_trip", f"WITH {_SPLIT} SELECT id, true AS same FROM parts WHERE split = 'test'")
def _(spark, sf):
    """A saved and reloaded model scores every test row as before."""
    train, test = _parts(spark, sf)
    fitted = zoo.fit_model("GaussianNB", train)
    folder = run_folder(spark, "models")
    fitted.save(folder)
    before = fitted.transform(test).select("id", F.col("y_proba").alias("before"))
    after = load_model(folder, "GaussianNB").transform(test).select("id", F.col("y_proba").alias("after"))
    return before.join(after, "id").select("id", (F.col("before") == F.col("after")).alias("same"))

