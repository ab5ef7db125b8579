"""Pipeline stages of our own (IO8): what they were fitted to is a JSON parameter, so a
``PipelineModel`` with them saves, loads, and scores batches and streams as one object.

The fitted state is bounded (statistics, category lists, trees) and travels in the stage's
metadata; ``transform`` is row-local in every stage.
"""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from flowlens import config as C
from flowlens.operators.features import FeatureEngineer, FeatureModel
from flowlens.operators.preprocess import Preprocessor, PreprocessorModel

SETTINGS = "what the stage was told or fitted to, as JSON"


class _Stateful(Params):
    """One JSON parameter with everything a stage needs."""

    state = Param(Params._dummy(), "state", SETTINGS, typeConverter=TypeConverters.toString)

    def _remember(self, value: dict):
        return self._set(state=json.dumps(value, sort_keys=True))

    def _recall(self) -> dict:
        return json.loads(self.getOrDefault(self.state))


class FeatureStageModel(Model, _Stateful, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted features added to the rows; no percentile ranks, which are no row's own."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return FeatureModel(self._recall()).transform(df, with_percentile=False)


class FeatureStage(Estimator, _Stateful, DefaultParamsReadable, DefaultParamsWritable):
    """FE1-FE13 as a stage; ``options`` are those of ``FeatureEngineer``."""

    def __init__(self, **options):
        super().__init__()
        self._remember(options)

    def _fit(self, df: DataFrame) -> FeatureStageModel:
        return FeatureStageModel()._remember(FeatureEngineer(**self._recall()).fit(df).state)


class PreprocessStageModel(Model, _Stateful, DefaultParamsReadable, DefaultParamsWritable):
    """Imputed, encoded and scaled features beside the columns that pass through."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return PreprocessorModel(self._recall()).transform(df)

    @property
    def feature_order(self) -> list[str]:
        return PreprocessorModel(self._recall()).feature_order


class PreprocessStage(Estimator, _Stateful, DefaultParamsReadable, DefaultParamsWritable):
    """PP1-PP7 as a stage: ``passthrough`` columns are kept as they are and are no features."""

    def __init__(self, passthrough: list[str] = (), high_cardinality: int = C.HIGH_CARDINALITY):
        super().__init__()
        self._remember({"passthrough": list(passthrough), "high_cardinality": high_cardinality})

    def _fit(self, df: DataFrame) -> PreprocessStageModel:
        return PreprocessStageModel()._remember(Preprocessor(**self._recall()).fit(df).state)


class AssembleStage(Transformer, _Stateful, DefaultParamsReadable, DefaultParamsWritable):
    """``features``, the vector of all numeric columns but ``passthrough``; missing values are 0.

    The columns are those of the rows that arrive, in order, so the stage needs no list of
    what the stages before it will make.
    """

    def __init__(self, passthrough: list[str] = ()):
        super().__init__()
        self._remember({"passthrough": list(passthrough)})

    def _transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector
        from pyspark.sql import functions as F

        from flowlens.functions.exprs import numeric_columns, quote

        cols = numeric_columns(df, self._recall()["passthrough"])
        values = [F.coalesce(F.nanvl(F.col(quote(c)).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in cols]
        return df.withColumn("features", array_to_vector(F.array(*values)))
