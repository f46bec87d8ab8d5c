"""Base classes for steps that are fitted on one table and applied to any.

A fitted step keeps its state as plain values in a parameter, so it is saved and loaded
with the pipeline it belongs to.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from waymark.operators.columns import Roles


class _HasState(Params):
    state = Param(Params._dummy(), "state", "plain values that define the step")

    def __init__(self, **state):
        super().__init__()
        self._set(state=state)

    @property
    def values(self) -> dict:
        return self.getOrDefault(self.state)


class Step(_HasState, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """An unfitted step. ``columns`` fixes its columns, otherwise its roles choose them."""

    def __init__(self, columns=None, ids=("id",), label="country_destination", **settings):
        super().__init__(columns=list(columns) if columns is not None else None, ids=list(ids), label=label, **settings)

    @property
    def roles(self) -> Roles:
        return Roles(tuple(self.values["ids"]), self.values["label"])

    def numeric(self, df: DataFrame) -> list[str]:
        return self.values["columns"] if self.values["columns"] is not None else self.roles.numeric(df)

    def nominal(self, df: DataFrame) -> list[str]:
        return self.values["columns"] if self.values["columns"] is not None else self.roles.nominal(df)

    def predictors(self, df: DataFrame) -> list[str]:
        return self.values["columns"] if self.values["columns"] is not None else self.roles.predictors(df)


class FittedStep(_HasState, Model, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted step."""


class FixedStep(_HasState, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A step with nothing to fit."""
