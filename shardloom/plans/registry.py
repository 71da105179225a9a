"""Named formulations of the same question, and the log of their runs."""

from __future__ import annotations

import csv
import os
import random
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Formulation:
    """One way to answer a question; infeasible says why it refuses an input of so many rows, if it does."""

    question: str
    name: str
    run: Callable[..., DataFrame]
    most_rows: int | None = None

    def infeasible(self, rows: int) -> str | None:
        return f"{self.name} is for up to {self.most_rows} rows" if self.most_rows is not None and rows > self.most_rows else None


class Registry:
    def __init__(self) -> None:
        self._known: dict[tuple[str, str], Formulation] = {}

    def add(self, f: Formulation) -> Formulation:
        if (f.question, f.name) in self._known:
            raise ValueError(f"{f.question}/{f.name} is registered already")
        self._known[f.question, f.name] = f
        return f

    def of(self, question: str) -> list[Formulation]:
        return [f for (q, _), f in sorted(self._known.items()) if q == question]

    def questions(self) -> list[str]:
        return sorted({q for q, _ in self._known})


def itinerary(formulations: Iterable[Formulation], sizes: Iterable[int], runs: int, seed: int = 0) -> list[tuple[Formulation, int, int]]:
    """Every formulation at every size, so many times, in a random order that the seed fixes."""
    steps = [(f, s, r) for f in formulations for s in sizes for r in range(runs)]
    random.Random(seed).shuffle(steps)
    return steps


RUNS = "question string, name string, size bigint, seconds double"


def log_run(path: str, question: str, name: str, size: int, seconds: float) -> None:
    """Adds a run to a CSV log of RUNS, with its header if the log is new."""
    new = not os.path.exists(path)
    with open(path, "a", newline="") as f:
        writer = csv.writer(f)
        if new:
            writer.writerow([c.split()[0] for c in RUNS.split(", ")])
        writer.writerow([question, name, size, f"{seconds:.6f}"])


def summarize_runs(spark: SparkSession, path: str) -> DataFrame:
    """question, name, size, runs, mean, std, low, high of a CSV log of RUNS; low and high bound the mean with 95 percent."""
    log = spark.read.schema(RUNS).csv(path, header=True)
    out = log.groupBy("question", "name", "size").agg(F.count("seconds").alias("runs"), F.avg("seconds").alias("mean"), F.stddev_samp("seconds").alias("std"))
    half = F.lit(1.96) * F.col("std") / F.sqrt("runs")
    return out.select("*", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))
