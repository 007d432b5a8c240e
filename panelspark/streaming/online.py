"""Streams: Gram matrices by micro-batch, event windows, per-key state, a polled queue."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelspark.operators.regression import INTERCEPT, Fit, gram
from panelspark.sources import files


class OnlineOLS:
    """Recursive least squares over micro-batches; older ones fade by `forget`.

    The state is a count, means and centred cross products, k(k+1)/2 numbers whatever
    the stream holds. With `path`, each batch commits the state after it as a file of
    its own in the shared folder, and a new object goes on from the last one. A batch
    that comes again, in this process or after a restart, counts once: its state is
    there already, or is made anew from that of the batch before.
    """

    def __init__(self, y: str, x: list[str], ridge: float = 0.0, forget: float = 1.0, path: str | None = None, keep: int = 5):
        self.y, self.x, self.ridge, self.forget, self.path, self.keep = y, list(x), ridge, forget, path, keep
        k = len(self.x) + 1
        self.cross, self.mean, self.n, self.last = np.zeros((k, k)), np.zeros(k), 0.0, -1
        self.restored = path is None

    @property
    def names(self) -> list[str]:
        return [INTERCEPT, *self.x]

    def add(self, batch: DataFrame, batch_id: int) -> None:
        self._restore(batch.sparkSession)
        if batch_id <= self.last:
            return
        columns = [*self.x, self.y]
        clean = batch.dropna(subset=columns)
        # Sums about the mean so far, or the batch's own where there is none: no large numbers cancel.
        about = self.mean if self.n else np.array([v or 0.0 for v in clean.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()])
        g, n = gram(clean.select(*[F.col(c).cast("double").alias(c) for c in columns], F.lit(1.0).alias(INTERCEPT)), [*columns, INTERCEPT], centre=dict(zip(columns, map(float, about), strict=True)))
        k, total = len(columns), self.forget * self.n + n
        if total > 0:
            shift = g[:k, k] / total
            self.cross = self.forget * self.cross + g[:k, :k] - total * np.outer(shift, shift)
            self.mean, self.n = about + shift, total
        self.last = batch_id
        self._commit(batch.sparkSession)

    def _restore(self, spark: SparkSession) -> None:
        if self.restored:
            return
        found = files.versions(spark, self.path)
        if found:
            state = json.loads(files.read_text(spark, f"{self.path}/{found[-1]}"))
            if state["columns"] != [*self.x, self.y]:
                raise ValueError("the state is of another model")
            self.cross, self.mean, self.n, self.last = np.array(state["cross"]), np.array(state["mean"]), state["n"], state["batch"]
        self.restored = True

    def _commit(self, spark: SparkSession) -> None:
        if self.path is None:
            return
        state = {"columns": [*self.x, self.y], "batch": self.last, "n": self.n, "mean": self.mean.tolist(), "cross": self.cross.tolist()}
        files.commit_text(spark, self.path, self.last, json.dumps(state))
        for old in files.versions(spark, self.path)[: -self.keep]:
            files.remove(spark, f"{self.path}/{old}")

    def fit(self) -> Fit:
        k = len(self.x)
        xx, xy = self.cross[:k, :k] + self.ridge * np.eye(k), self.cross[:k, k]
        slopes = np.linalg.solve(xx, xy)
        rss = float(self.cross[k, k] - 2 * slopes @ xy + slopes @ self.cross[:k, :k] @ slopes)
        df = self.n - k - 1
        bread = np.linalg.inv(xx)
        mean = self.mean[:k]
        inverse = np.block([[np.array([[1 / self.n + mean @ bread @ mean]]), -(mean @ bread)[None, :]], [-(bread @ mean)[:, None], bread]])
        beta = np.concatenate([[self.mean[k] - slopes @ mean], slopes])
        return Fit(self.names, beta, inverse * rss / max(df, 1), self.n, df, {"rss": rss})

    def start(self, stream: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        """Runs over a stream. Without a `path` of its own the state goes beside the stream's checkpoint, whose batch numbers it follows."""
        if self.path is None:
            self.path, self.restored = f"{checkpoint}/model", False
        writer = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str, slide: str | None = None, late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """Counts (and sums) by event-time window; rows later than `late` are dropped on a stream."""
    marked = events.withWatermark(time, late)
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return marked.groupBy(window, *by).agg(*aggs).select(*by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), *["n"] + (["total"] if value else []))


def sessions(events: DataFrame, time: str, by: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Session windows: a session ends after `gap` without an event."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def poll(take: Callable[[int], DataFrame], work: Callable[[DataFrame], None], size: int, empty_limit: int = 3, wait: Callable[[], None] = lambda: None) -> int:
    """Works through a queue in batches until it was empty `empty_limit` times in a row; returns the number of batches."""
    done = empty = 0
    while empty < empty_limit:
        batch = take(size)
        if batch.isEmpty():
            empty += 1
            wait()
            continue
        empty, done = 0, done + 1
        work(batch)
    return done


def latest(stream: DataFrame, key: str, order: Column, columns: list[str]) -> DataFrame:
    """The last state of each key so far (complete output)."""
    return stream.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("s")).select(key, "s.*")
