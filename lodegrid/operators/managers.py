"""Chunked evaluation. Spark's tasks replace thread pools and child processes; what is left is the chunked,
resumable store for results that are too large to write in one go."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodegrid.plans.coordinates import Coordinates
from lodegrid.plans.coverage import Coverage
from lodegrid.plans.node import Node, Request
from lodegrid.sources import sinks


class Parallel(Node):
    """Evaluates its source; chunks are Spark's partitions. ``chunks`` only sets how many cells a chunk of a
    stored result has along each dimension."""

    attributes = {"chunks": None, "start_i": 0}

    def build(self, request: Request) -> Coverage:
        return self.inputs["source"].compile(request)

    def requests(self, coords: Coordinates) -> list[Coordinates]:
        shape = tuple((self.attrs["chunks"] or {}).get(p.name, p.size) for p in coords.parts)
        return list(coords.iterchunks(shape))

    def write(self, coords: Coordinates, path: str, spark: SparkSession, stop_i: int | None = None) -> None:
        """Evaluate chunk by chunk from ``start_i`` on, skipping those that the store has."""
        done = {r[0] for r in sinks.written_chunks(spark, path).collect()}
        for i, part in enumerate(self.requests(coords)):
            if i < self.attrs["start_i"] or (stop_i is not None and i >= stop_i) or i in done:
                continue
            c = self.eval(part, spark)
            c.df.withColumn("chunk", F.lit(i)).write.mode("append").partitionBy("chunk").parquet(path)


class ParallelAsync(Parallel):
    """Spark's scheduler already retries and queues; the same as Parallel."""


class ParallelOutput(Parallel):
    """Writes its source's result to a store by chunk and answers with the stored cells."""

    attributes = Parallel.attributes | {"path": None}

    def build(self, request: Request) -> Coverage:
        coords = request.coords
        c = self.inputs["source"].compile(request)
        sizes = {p.name: p.size for p in coords.parts}
        indexed = c.with_df(c.df.join(request.frame(), list(coords.udims)))
        chunk = sinks.chunk_column(indexed.df, sizes, self.attrs["chunks"] or {})
        keyed = indexed.df.withColumn("__chunk", chunk).select(*c.dims, *c.outputs, "__chunk")
        sinks.write_missing_chunks(c.with_df(keyed), F.col("__chunk"), self.attrs["path"])
        stored = request.spark.read.parquet(self.attrs["path"]).select(*c.dims, *c.outputs)
        return c.with_df(request.frame().select(*c.dims).join(stored, list(c.dims), "left"))


class Process(Parallel):
    """Evaluation in another process: Spark's executors are that."""
