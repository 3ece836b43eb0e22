"""What can be plugged in: estimators, readers of intents, and sources."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame

from lotscope.operators.ranking import Intent


@runtime_checkable
class Estimator(Protocol):
    """Learns from listings, then adds price quantiles q1.. to others."""

    def fit(self, train: DataFrame) -> Estimator: ...

    def predict(self, df: DataFrame) -> DataFrame: ...


@runtime_checkable
class IntentParser(Protocol):
    """Reads a buyer's sentence."""

    def parse(self, text: str) -> Intent: ...


@runtime_checkable
class SourceAdapter(Protocol):
    """Gives the listings of a source, as fetched."""

    name: str

    def read(self) -> DataFrame: ...


def collected(adapters: list[SourceAdapter]) -> tuple[DataFrame | None, dict[str, str]]:
    """All adapters' listings, and why those that fail do."""
    from lotscope.operators.reports import union_isolated

    return union_isolated({a.name: a.read for a in adapters})


def benchmarked(estimator: Estimator, train: DataFrame, test: DataFrame, key: str = "model_key") -> DataFrame:
    """Fit, predict, and the metrics of every slice, as estimators.benchmark gives them."""
    from lotscope.operators.estimators import benchmark

    return benchmark(estimator.fit(train).predict(test), key)
