"""Feature preparation learnt on training rows and applied as plain projections."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from gaugelab.operators.profile import quantile_lookup
from gaugelab.plans.join import settled
from gaugelab.plans.order import row_positions

# A one-hot category with more levels than this is an identifier, not a feature. Codes have no such limit.
LEVEL_LIMIT = 10_000


def detect_feature_types(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[list[str], list[str]]:
    """Column names split into (numeric incl. boolean, categorical) by schema."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    if columns is not None:
        fields.sort(key=lambda f: list(columns).index(f.name))
    numeric = [f.name for f in fields if isinstance(f.dataType, (NumericType, BooleanType))]
    return numeric, [f.name for f in fields if isinstance(f.dataType, StringType)]


def category_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[tuple[str, int]]]:
    """Levels with counts per categorical column, sorted by level; the number of levels of each column is checked."""
    if not columns:
        return {}
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "feature", "level")
    counts = long.where(F.col("level").isNotNull()).groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n"))
    counts = settled(counts)
    wide = [r.feature for r in counts.groupBy("feature").count().where(F.col("count") > LEVEL_LIMIT).collect()]
    if wide:
        raise ValueError(f"categorical columns {wide} hold more than {LEVEL_LIMIT} levels")
    rows = counts.collect()
    found: dict[str, list[tuple[str, int]]] = {c: [] for c in columns}
    for r in sorted(rows, key=lambda r: (r.feature, r.level)):
        found[r.feature].append((r.level, r.n))
    return found


def most_frequent(levels: Sequence[tuple[str, int]]) -> str | None:
    """Most frequent level; the smallest one among equals."""
    return min(levels, key=lambda item: (-item[1], item[0]))[0] if levels else None


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """Add ``column_code``: position of the level in sorted order, -1 for a missing one."""
    levels = df.select(F.col(column).alias("_level")).where(F.col("_level").isNotNull()).distinct()
    ranked = settled(row_positions(levels.withColumn("_place", _text_place("_level")), [], "_place", ["_level"]).select("_level", F.col("position").alias("_position")))
    joined = df.join(ranked, F.col(column) == F.col("_level"), "left")
    return joined.select(*df.columns, F.coalesce("_position", F.lit(-1)).cast("int").alias(f"{column}_code"))


def _text_place(column: str) -> Column:
    """A number in the order of texts, by their first six bytes; equal for texts that begin alike."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(column), "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_number(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def vector_stages(expressions: Sequence[str]) -> list:
    """Stages that compute expressions in one projection and assemble them."""
    names = [f"_f{i}" for i in range(len(expressions))]
    listed = ", ".join(f"{e} AS {n}" for e, n in zip(expressions, names))
    return [SQLTransformer(statement=f"SELECT *, {listed} FROM __THIS__"), VectorAssembler(inputCols=names, outputCol="features")]


@dataclass
class Preparation:
    """Learnt preparation: medians, means and scales of numeric columns, levels of categories."""

    numeric: list[str]
    categorical: list[str]
    scale: bool
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str | None] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)
    rows: int = 0

    @property
    def outputs(self) -> list[str]:
        """Output names: numeric block first, then one column per level."""
        return [f"num__{c}" for c in self.numeric] + [f"cat__{c}_{v}" for c in self.categorical for v in self.levels[c]]

    def sources(self) -> dict[str, str]:
        """Output name -> the raw column it came from."""
        return {f"num__{c}": c for c in self.numeric} | {f"cat__{c}_{v}": c for c in self.categorical for v in self.levels[c]}

    def expressions(self) -> list[str]:
        """SQL expression per output, in the order of ``outputs``."""
        made = []
        for c in self.numeric:
            raw = f"CAST(`{c}` AS DOUBLE)"
            filled = f"(CASE WHEN `{c}` IS NULL OR isnan({raw}) THEN {sql_number(self.medians[c])} ELSE {raw} END)"
            made.append(f"(({filled} - {sql_number(self.means[c])}) / {sql_number(self.scales[c])})" if self.scale else filled)
        for c in self.categorical:
            filled = f"coalesce(CAST(`{c}` AS STRING), {_sql_text(self.modes[c])})" if self.modes[c] is not None else f"CAST(`{c}` AS STRING)"
            made += [f"(CASE WHEN {filled} = {_sql_text(v)} THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END)" for v in self.levels[c]]
        return made

    def columns(self) -> list[Column]:
        return [F.expr(e).alias(name) for name, e in zip(self.outputs, self.expressions())]

    def apply(self, df: DataFrame) -> DataFrame:
        """The input plus one column per output; unseen levels give all zeros."""
        return df.select("*", *self.columns())

    def named_expressions(self, keep: Sequence[str] | None = None) -> dict[str, str]:
        """Output name -> SQL expression, for all outputs or those in ``keep``."""
        return {n: e for n, e in zip(self.outputs, self.expressions()) if keep is None or n in keep}

    def stages(self, keep: Sequence[str] | None = None) -> list:
        """Spark ML stages that add the vector column ``features``."""
        return vector_stages(list(self.named_expressions(keep).values()))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "Preparation":
        return Preparation(**json.loads(text))


def fit_preparation(train: DataFrame, columns: Sequence[str], scale: bool = True, one_hot: bool = True) -> Preparation:
    """Learn medians, means, population scales, modes and levels from training rows only."""
    numeric, categorical = detect_feature_types(train, columns)
    made = Preparation(numeric, categorical if one_hot else [], scale)
    if numeric:
        as_double = train.select(*[F.col(c).cast("double").alias(c) for c in numeric])
        made.medians = {c: q[0] for c, q in quantile_lookup(as_double, numeric, [0.5]).items()}
        filled = {c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(made.medians[c])) for c in numeric}
        row = as_double.agg(
            F.count(F.lit(1)).alias("rows"), *[F.avg(v).alias(f"mean_{c}") for c, v in filled.items()], *[F.stddev_pop(v).alias(f"scale_{c}") for c, v in filled.items()]
        ).first()
        made.rows = row["rows"]
        made.means = {c: row[f"mean_{c}"] for c in numeric}
        made.scales = {c: row[f"scale_{c}"] or 1.0 for c in numeric}
    found = category_levels(train, made.categorical)
    made.modes = {c: most_frequent(found[c]) for c in made.categorical}
    made.levels = {c: [level for level, _ in found[c]] for c in made.categorical}
    return made


def scaler_report(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, train_mean, train_scale) with the population scale."""
    row = train.agg(
        *[F.avg(F.col(f).cast("double")).alias(f"train_mean_{f}") for f in features],
        *[F.stddev_pop(F.col(f).cast("double")).alias(f"train_scale_{f}") for f in features],
    )
    parts = ["train_mean", "train_scale"]
    return row.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), *[F.col(f"{p}_{f}").alias(p) for p in parts]) for f in features])))
