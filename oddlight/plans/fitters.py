"""Fit objects with the life of a session: create, add_batch, progress, checkpoint, cancel, finalize.

State is a table in the shared folder (features for the bank, moments for the Gaussians), one version for each batch, so
a driver that restarts goes on from the last checkpoint. A cancelled fit stays cancelled; a complete one takes no more.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AnomalyError, Cancelled, InvalidArgument, NotInitialized
from ..operators import stats
from .algorithms import Grid, PaDiM, PatchCore

READY, EXTRACTING, FINALIZING, COMPLETE, CANCELLED = "ready", "extracting", "finalizing", "complete", "cancelled"


@dataclass
class Progress:
    stage: str
    processed_samples: int
    collected_vectors: int


class Fitter:
    """Base: subclasses say how a batch becomes state and how state becomes a model."""

    def __init__(self, spark: SparkSession, grid: Grid, folder: str) -> None:
        self.spark, self.grid = spark, grid
        self.folder = f"{folder.rstrip('/')}/fit-{uuid.uuid4().hex}"
        self.stage, self.samples, self.vectors = READY, 0, 0
        self.parts: list[str] = []

    def _open(self) -> None:
        if self.stage == CANCELLED:
            raise Cancelled("the fit was cancelled")
        if self.stage == COMPLETE:
            raise InvalidArgument("the fit is complete")

    def add_batch(self, patches: DataFrame) -> Progress:
        self._open()
        self.stage = EXTRACTING
        path = f"{self.folder}/part-{len(self.parts)}"
        try:
            self._reduce(patches).write.parquet(path)
            n = patches.agg(F.count_distinct("image_id"), F.count(F.lit(1))).first()
        finally:
            if self.stage != CANCELLED:
                self.stage = READY
        self.parts.append(path)
        self.samples, self.vectors = self.samples + n[0], self.vectors + n[1]
        return self.progress()

    def progress(self) -> Progress:
        return Progress(self.stage, self.samples, self.vectors)

    def cancel(self) -> None:
        if self.stage != COMPLETE:
            self.stage = CANCELLED

    def state(self) -> DataFrame:
        if not self.parts:
            raise NotInitialized("no batch was added")
        return self.spark.read.parquet(*self.parts)

    def save_checkpoint(self, path: str) -> None:
        self._open()
        counted = self.state().withColumn("_samples", F.lit(self.samples)).withColumn("_vectors", F.lit(self.vectors))
        counted.write.parquet(path)

    def load_checkpoint(self, path: str) -> None:
        self._open()
        if self.parts:
            raise InvalidArgument("a checkpoint must be loaded before the first batch")
        saved = self.spark.read.parquet(path)
        row = saved.select("_samples", "_vectors").first()
        if row is None:
            raise NotInitialized("the checkpoint is empty")
        part = f"{self.folder}/part-restored"
        saved.drop("_samples", "_vectors").write.parquet(part)
        self.parts, self.samples, self.vectors = [part], row["_samples"], row["_vectors"]

    def finalize(self):
        self._open()
        if not self.samples:
            raise NotInitialized("no batch was added")
        self.stage = FINALIZING
        try:
            model = self._finish(self.state())
        except AnomalyError:
            self.stage = READY
            raise
        self.stage = COMPLETE
        return model

    def _reduce(self, patches: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _finish(self, state: DataFrame):
        raise NotImplementedError


class PatchCoreFitter(Fitter):
    """State: the features themselves; an existing bank may seed an original-variant fit."""

    def __init__(self, spark: SparkSession, grid: Grid, folder: str, **options) -> None:
        super().__init__(spark, grid, folder)
        self.options = options

    def import_bank(self, bank: DataFrame) -> None:
        if self.options.get("variant", "original") != "original":
            raise InvalidArgument("only an original-variant fit takes a bank")
        self.add_batch(bank.select((-1 - F.col("bank_id")).alias("image_id"), F.lit(0).alias("loc"), "feat"))

    def _reduce(self, patches: DataFrame) -> DataFrame:
        return patches.select("image_id", F.col("loc").cast("int").alias("loc"), F.col("feat").cast("array<double>").alias("feat"))

    def _finish(self, state: DataFrame) -> PatchCore:
        return PatchCore.fit(state, self.grid, **self.options)


class PaDimFitter(Fitter):
    """State: moments by location, which add up."""

    def __init__(self, spark: SparkSession, grid: Grid, folder: str, channels: list[int], regularisation: float = 0.01) -> None:
        super().__init__(spark, grid, folder)
        self.channels, self.regularisation = channels, regularisation

    def _reduce(self, patches: DataFrame) -> DataFrame:
        return PaDiM.moments(patches, self.channels)

    def state(self) -> DataFrame:
        """Moments over all batches: element-wise sums by location, in one shuffle of small rows."""
        d = len(self.channels)
        m = super().state()
        sums = [F.sum(F.col("sums")[i]) for i in range(d)]
        products = [F.sum(F.col("products")[i]) for i in range(d * (d + 1) // 2)]
        return m.groupBy("loc").agg(F.sum("n").alias("n"), F.array(*sums).alias("sums"), F.array(*products).alias("products"))

    def _finish(self, state: DataFrame) -> PaDiM:
        return PaDiM(self.grid, stats.gaussians(state, self.regularisation), self.channels, strategy="expr" if len(self.channels) <= 12 else "kernel")
