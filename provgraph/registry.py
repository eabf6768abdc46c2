"""Named extensions: data sources, embedders and detectors, with settings by keyword."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import detect, embed, quantiles, snapshots
from .sources import cdm, dot


class Source(Protocol):
    """Loads an edge table and cuts it into snapshots."""

    def load(self, spark: SparkSession, base: str) -> DataFrame: ...

    def snapshots(self, edges: DataFrame) -> DataFrame: ...


@dataclass
class CdmSource:
    """CDM18 logs; snapshots by five-minute bins."""

    width_us: int = snapshots.FIVE_MINUTES
    per_subgraph: Callable[[DataFrame], DataFrame] | None = None

    def load(self, spark: SparkSession, base: str) -> DataFrame:
        return cdm.load_edges(spark, base)

    def snapshots(self, edges: DataFrame) -> DataFrame:
        found = snapshots.time_snapshots(edges, self.width_us, ["scene", "category"])
        return self.per_subgraph(found) if self.per_subgraph else found


@dataclass
class DotSource:
    """DOT graphs; snapshots by node budget."""

    budget: int = 300
    rate: float = 0.3

    def load(self, spark: SparkSession, base: str) -> DataFrame:
        return dot.load_edges(spark, base)

    def snapshots(self, edges: DataFrame) -> DataFrame:
        return snapshots.node_budget_snapshots(edges, self.budget, self.rate)


@dataclass
class Factors:
    """Snapshot vectors by implicit factors."""

    dim: int = 32
    rounds: int = 5

    def train(self, counts: DataFrame) -> DataFrame:
        return embed.snapshot_vectors(embed.snapshot_factors(counts, self.dim, self.rounds))


@dataclass
class Words:
    """Word vectors of triples."""

    dim: int = 30
    window: int = 5
    rounds: int = 100

    def train(self, triples: DataFrame) -> DataFrame:
        return embed.word_vectors(triples, self.dim, self.window, self.rounds)


@dataclass
class Translations:
    """Entity and relation vectors of triples."""

    dim: int = 30
    epochs: int = 100

    def train(self, triples: DataFrame) -> DataFrame:
        return embed.translation_vectors(triples, self.dim, self.epochs)


SETTINGS = "lags int, ridge double, threshold double, quantile double"


@dataclass
class Autoregression:
    """Forecasts snapshot vectors from their predecessors; ``train`` gives the weights, ``predict`` scores.

    With ``quantile`` the threshold is that quantile of the training errors, of the benign ones where the sequence has a ``truth``.
    """

    lags: int = detect.LAGS
    ridge: float = 1.0
    threshold: float = detect.THRESHOLD
    quantile: float | None = None
    weights: DataFrame | None = field(default=None, repr=False)

    def train(self, seq: DataFrame) -> DataFrame:
        if (n := seq.count()) <= self.lags:
            raise ValueError(f"{n} snapshots do not make a sequence of {self.lags}")
        windows = detect.lag_windows(seq, self.lags)
        self.weights = detect.fit_autoregression(detect.gram(detect.lagged_values(windows), self.lags), self.ridge, self.lags)
        if self.quantile is not None:
            scored = detect.scores(detect.autoregression_forecast(windows, self.weights), self.threshold)
            benign = scored if "truth" in scored.columns else scored.withColumn("truth", F.lit(0))
            found = quantiles.benign_threshold(benign, [], self.quantile).first()
            if found is None:
                raise ValueError("no benign snapshots to take a quantile of")
            self.threshold = found.threshold
        return self.weights

    def predict(self, seq: DataFrame) -> DataFrame:
        if self.weights is None:
            raise ValueError("train or load first")
        return detect.scores(detect.autoregression_forecast(detect.lag_windows(seq, self.lags), self.weights), self.threshold)

    def save(self, path: str) -> None:
        """Weights and settings as Parquet."""
        if self.weights is None:
            raise ValueError("train or load first")
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        settings = [(self.lags, self.ridge, self.threshold, self.quantile)]
        self.weights.sparkSession.createDataFrame(settings, SETTINGS).write.mode("overwrite").parquet(f"{path}/settings")

    def load(self, spark: SparkSession, path: str) -> None:
        self.weights = spark.read.parquet(f"{path}/weights")
        for name, value in spark.read.parquet(f"{path}/settings").first().asDict().items():
            setattr(self, name, value)


#: Names of the public data sets and their formats.
SOURCES = {"theia": CdmSource, "cadets": CdmSource, "clearscope": CdmSource, "trace": CdmSource, "atlas": DotSource}
EMBEDDERS = {"factors": Factors, "word2vec": Words, "transe": Translations}
DETECTORS = {"autoregression": Autoregression}


def create(registry: dict[str, type], name: str, **settings):
    """An extension by name, in any case; settings that it does not know are left out."""
    try:
        made = registry[name.lower()]()
    except KeyError:
        raise ValueError(f"unknown name {name!r}; known: {', '.join(sorted(registry))}") from None
    known = {f.name for f in fields(made)}
    return replace(made, **{k: v for k, v in settings.items() if k in known})
