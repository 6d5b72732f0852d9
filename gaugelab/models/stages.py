"""A custom pipeline stage: random Fourier features for the RBF kernel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Map x to sqrt(2/D) cos(Wx + b); inner products approximate exp(-gamma |x-z|^2) (Rahimi and Recht, 2007)."""

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "number of random features", TypeConverters.toInt)
    width = Param(Params._dummy(), "width", "length of the input vector", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, gamma=1.0, size=200, width=1, seed=42):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size, width = self.getOrDefault(self.size), self.getOrDefault(self.width)
        draw = np.random.RandomState(self.getOrDefault(self.seed) % 2**32)
        weights = draw.normal(0.0, np.sqrt(2.0 * self.getOrDefault(self.gamma)), (width, size))
        shift = draw.uniform(0.0, 2.0 * np.pi, size)
        scale = np.sqrt(2.0 / size)

        @F.pandas_udf("array<double>")
        def lift(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                if len(batch) == 0:
                    yield pd.Series([], dtype=object)
                    continue
                yield pd.Series(list(scale * np.cos(np.vstack(batch.to_numpy()) @ weights + shift)))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(lift(vector_to_array(self.getInputCol()))))
