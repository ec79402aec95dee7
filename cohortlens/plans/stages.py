"""The preparation as stages of `pyspark.ml`: an imputer, an encoder and a scaler that fit, and a stage for derived features.

They work in a `Pipeline`, a `CrossValidator` and a parameter grid, so every fold is filled, encoded and scaled with the
statistics of its own training rows. Stages replace their columns in place and keep all others; they can be saved and loaded.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLWritable,
)
from pyspark.sql import DataFrame, SparkSession

from cohortlens import constants as C
from cohortlens.functions.text import literal, number, ordinal_code, quoted
from cohortlens.operators import encode, features, impute, scale
from cohortlens.spec import Feature


def _json(params: Params, name: str, doc: str) -> Param:
    """A parameter that holds JSON text, so that it is written and copied like any other."""
    return Param(params, name, doc, TypeConverters.toString)


class _Imputing(HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    strategy = Param(Params._dummy(), "strategy", f"one of {sorted(impute.FITS)}", TypeConverters.toString)

    def getStrategy(self) -> str:
        return self.getOrDefault(self.strategy)


class PanelImputer(Estimator, _Imputing):
    """Fits a fill value per column: median, approx_median or mean of numbers, mode of texts."""

    @keyword_only
    def __init__(self, *, inputCols=None, strategy="median"):
        super().__init__()
        self._setDefault(strategy="median")
        self.setParams(**self._input_kwargs)

    @keyword_only
    def setParams(self, *, inputCols=None, strategy="median"):
        return self._set(**self._input_kwargs)

    def setStrategy(self, value: str) -> "PanelImputer":
        return self._set(strategy=value)

    def _fit(self, dataset: DataFrame) -> "PanelImputerModel":
        found = impute.fit(dataset, self.getInputCols(), self.getStrategy()).collect()
        model = self._copyValues(PanelImputerModel())
        return model._set(fills=json.dumps({r["column"]: r["fill"] for r in found}, ensure_ascii=False))


class PanelImputerModel(Model, _Imputing):
    """Fills nulls and NaN; a column without any fitted value stays as it is. Numbers become doubles."""

    fills = _json(Params._dummy(), "fills", "fill value by column")

    def __init__(self):
        super().__init__()
        self._setDefault(strategy="median", fills="{}")

    def fill_values(self) -> dict:
        return json.loads(self.getOrDefault(self.fills))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fills, own, kinds = self.fill_values(), set(self.getInputCols()), {f.name: f.dataType for f in dataset.schema.fields}
        if missing := sorted(own - set(kinds)):
            raise ValueError(f"columns to fill are missing: {missing}")

        def value(c):
            if c not in own:
                return quoted(c)
            now = quoted(c) if self.getStrategy() == "mode" else f"cast({number(c, kinds[c])} AS double)"
            return f"coalesce({now}, {literal(fills[c])}) AS {quoted(c)}" if c in fills else f"{now} AS {quoted(c)}"

        return dataset.selectExpr(*[value(c) for c in dataset.columns])


class _Encoding(HasInputCols):
    ordinalCols = Param(Params._dummy(), "ordinalCols", "text columns with known levels", TypeConverters.toListString)
    levels = _json(Params._dummy(), "levels", "number by level")

    def getOrdinalCols(self) -> list[str]:
        return self.getOrDefault(self.ordinalCols)


class PanelEncoder(Estimator, _Encoding, DefaultParamsReadable, DefaultParamsWritable):
    """Numbers the texts of `inputCols` in code point order, and takes the numbers of `ordinalCols` from their levels."""

    @keyword_only
    def __init__(self, *, inputCols=None, ordinalCols=None, levels=None):
        super().__init__()
        self._setDefault(inputCols=[], ordinalCols=[], levels=json.dumps(dict(C.ORDINAL_LEVELS), ensure_ascii=False))
        self.setParams(**self._input_kwargs)

    @keyword_only
    def setParams(self, *, inputCols=None, ordinalCols=None, levels=None):
        given = dict(self._input_kwargs)
        if isinstance(given.get("levels"), dict):
            given["levels"] = json.dumps(given["levels"], ensure_ascii=False)
        return self._set(**given)

    def _fit(self, dataset: DataFrame) -> "PanelEncoderModel":
        own = self.getInputCols()
        classes = encode.catalog(dataset, own) if own else dataset.sparkSession.createDataFrame([], PanelEncoderModel.CLASSES)
        return self._copyValues(PanelEncoderModel(classes))


class PanelEncoderModel(Model, _Encoding, MLWritable, MLReadable):
    """Codes as doubles; null and unseen texts become -1. The classes are a table, so a column may have any number of them."""

    CLASSES = "column string, value string, index bigint"

    def __init__(self, classes: DataFrame | None = None):
        super().__init__()
        self._setDefault(inputCols=[], ordinalCols=[], levels="{}")
        self.classes = classes

    def copy(self, extra=None) -> "PanelEncoderModel":
        made = super().copy(extra)
        made.classes = self.classes
        return made

    def _transform(self, dataset: DataFrame) -> DataFrame:
        own, ordinal, levels = self.getInputCols(), self.getOrdinalCols(), json.loads(self.getOrDefault(self.levels))
        coded = encode.apply(dataset, self.classes, own)
        return coded.selectExpr(*[
            f"cast({ordinal_code(c, levels) if c in ordinal else quoted(c)} AS double) AS {quoted(c)}" if c in own or c in ordinal else quoted(c)
            for c in coded.columns
        ])

    def write(self) -> "_EncoderWriter":
        return _EncoderWriter(self)

    @classmethod
    def read(cls) -> "_EncoderReader":
        return _EncoderReader(cls)


class _EncoderWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.classes.write.mode("overwrite").parquet(f"{path}/classes")


class _EncoderReader(DefaultParamsReader):
    def load(self, path: str) -> PanelEncoderModel:
        model = super().load(path)
        model.classes = SparkSession.active().read.schema(PanelEncoderModel.CLASSES).parquet(f"{path}/classes")
        return model


class PanelScaler(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Fits mean and population deviation per column."""

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self.setParams(**self._input_kwargs)

    @keyword_only
    def setParams(self, *, inputCols=None):
        return self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "PanelScalerModel":
        found = scale.fit(dataset, self.getInputCols()).collect()
        return self._copyValues(PanelScalerModel())._set(moments=json.dumps({r["column"]: [r["mean"], r["std"]] for r in found}))


class PanelScalerModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """(x - mean) / deviation; a constant column is only centred, one without fitted values and every gap become 0."""

    moments = _json(Params._dummy(), "moments", "mean and deviation by column")

    def __init__(self):
        super().__init__()
        self._setDefault(moments="{}")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        moments, own = json.loads(self.getOrDefault(self.moments)), set(self.getInputCols())

        def value(c):
            if c not in own:
                return quoted(c)
            mean, std = moments.get(c, (None, None))
            return "0D AS " + quoted(c) if mean is None else f"coalesce(({quoted(c)} - ({literal(mean)})) / {literal(std or 1.0)}, 0D) AS {quoted(c)}"

        return dataset.selectExpr(*[value(c) for c in dataset.columns])


class FeatureBuilder(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds derived features (see `operators.features`) to the frame."""

    declared = _json(Params._dummy(), "declared", "the features")

    def __init__(self, declared: list[Feature] = ()):
        super().__init__()
        self._setDefault(declared="[]")
        if declared:
            self._set(declared=json.dumps([asdict(f) for f in declared], ensure_ascii=False))

    def features(self) -> list[Feature]:
        return [Feature(f["name"], f["kind"], tuple(f["inputs"]), tuple(f["params"])) for f in json.loads(self.getOrDefault(self.declared))]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return features.build(dataset, self.features())


def stages(df: DataFrame, spec, exclude: list[str], missing: str = "median", engineered: bool = True) -> tuple[list, list[str]]:
    """(stages, names of the model columns) that prepare every column of `df` but those of `exclude`, as `prepare.prepare` does."""
    kinds = dict(df.dtypes)
    own = [c for c in df.columns if c not in exclude]
    texts = [c for c in own if kinds[c] == "string"]
    ordinal = [c for c in texts if spec.ordinal_stem in c.upper()]
    nominal = [c for c in texts if c not in ordinal]
    numeric = [c for c in own if c not in texts]
    derived = features.default_features(numeric, spec) if engineered else []
    columns = [*numeric, *ordinal, *nominal, *[f.name for f in derived]]
    made = [PanelImputer(inputCols=numeric, strategy=missing)]
    if texts:
        made.append(PanelImputer(inputCols=texts, strategy="mode"))
    if derived:
        made.append(FeatureBuilder(derived))
    if texts:
        made.append(PanelEncoder(inputCols=nominal, ordinalCols=ordinal, levels=dict(spec.ordinal_levels)))
    return [*made, PanelScaler(inputCols=columns)], columns
