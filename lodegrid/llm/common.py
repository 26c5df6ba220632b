"""What the operators of this subpackage share: shared-folder tables, Arrow batches, fixed hashes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of documents in an Arrow batch are cut again so that one batch of texts stays near this size.
BATCH_BYTES = 2 << 20
#: Rows are whole texts, so batches are bounded by bytes and Parquet's column vectors are short.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": (64 << 20, 4 << 20), "spark.sql.parquet.columnarReaderBatchSize": (4096, 512)}


def small_batches(spark: SparkSession) -> None:
    """Bounds what a task holds of texts at once, where the session has Spark's own settings: (theirs, ours)."""
    for key, (theirs, ours) in BATCHES.items():
        if (spark.conf.get(key) or "").rstrip("b") == str(theirs):
            spark.conf.set(key, str(ours))


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: ``spark.checkpoint.dir``. Where that is unset, one of our own if driver and
    executors are one process, as in tests; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodegrid-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: cuts the lineage, survives lost
    executors, and gives the planner the true size (so that broadcasts are decided on it). The files
    go when the driver's JVM ends."""
    spark = df.sparkSession
    small_batches(spark)
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/lodegrid/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}


def kind(name: str) -> T.DataType:
    return T.ArrayType(kind(name[6:-1])) if name.startswith("array<") else _TYPES[name]


def fields(*columns: str) -> T.StructType:
    """A schema from "name type" strings, without a session."""
    return T.StructType([T.StructField(c.rpartition(" ")[0], kind(c.rpartition(" ")[2])) for c in columns])


def cut(batch: pa.RecordBatch, column: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` bytes at most, one row at least."""
    if batch.num_rows == 0:
        return
    texts = batch.column(column)
    if texts.nbytes <= limit or batch.num_rows == 1:
        yield batch
        return
    half = batch.num_rows // 2
    yield from cut(batch.slice(0, half), column, limit)
    yield from cut(batch.slice(half), column, limit)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, giving free memory back to the system before it starts and when it ends: workers
    live on between tasks, and what one stage held would otherwise count in all later ones."""

    def tidy() -> None:
        gc.collect()
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        yield from run(batches)
        tidy()

    return whole


def with_text(df: DataFrame, text: str, f: Callable[[list], list[pa.Array]], *new: str | T.StructField) -> DataFrame:
    """Add the columns ``new`` ("name type", or fields), which ``f`` makes from a list of texts (str or None).

    All input columns are kept in place. New names must differ from the input's (callers pick
    private names), so clashing user columns never mix with them.
    """
    small_batches(df.sparkSession)
    add = T.StructType([n if isinstance(n, T.StructField) else fields(n)[0] for n in new])
    schema = T.StructType([*df.schema.fields, *add.fields])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, at):
                made = f(batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *add.names])

    return df.mapInArrow(tidied(run), schema)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has it (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def crc32_of_id(column: str = "doc_id") -> F.Column:
    """crc32 of an id's decimal text; a null id counts as the empty text (0)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def by_group(df: DataFrame, keys: list[str], f: Callable[[pa.Table], pa.RecordBatch | None], schema: T.StructType) -> DataFrame:
    """Run ``f`` over the rows of each key, which one task reads as a stream of sorted groups.

    One group is held in memory at a time, so callers deal out groups of bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                made = f(pa.Table.from_batches(held))
                if made is not None and made.num_rows:
                    yield made
                held.clear()

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            rows = list(zip(*columns, strict=True))
            start = 0
            for at, key in enumerate(rows):
                if key != last:
                    if at > start:
                        held.append(batch.slice(start, at - start))
                    yield from flush()
                    start, last = at, key
            if start < len(rows):
                held.append(batch.slice(start))
        yield from flush()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidied(run), schema)


#: Edges that one task contracts; about 100 MB in a Python worker.
EDGES = 250_000


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """A spanning star forest of the edges of each partition: (a, b), b the smallest id that a partition
    reaches from a; b itself comes as (b, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = y
            return x

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        if up:
            yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([root(x) for x in up], pa.int64())], names=["a", "b"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b").coalesce(parts).mapInArrow(tidied(run), fields("a long", "b long"))


def components(edges: DataFrame, rows: int = EDGES) -> DataFrame:
    """Connected components of ``edges`` (a, b), a stored table: (id, component), component the smallest
    id reachable.

    Each task first contracts its own edges to a star forest. Edges that took one task are done then;
    otherwise large-star and small-star steps and contraction alternate until nothing changes. Each
    round's table is written, so a lost executor costs a retry, and joins on a hub's key keep an
    exchange on either side, which Spark can split. Only ids that have an edge come back. Nothing is
    gathered on the driver but a count and a checksum a round.
    """
    parts = max(1, -(-edges.count() // rows))
    now, seen = written(_contracted(edges, parts), "edges"), None
    while parts > 1:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if mark == seen:
            break
        seen = mark
        apart = now.where("a != b").distinct()
        both = written(apart.unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
        low = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "low")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large")
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.withColumnRenamed("m", "b"))
        now = written(_contracted(small, parts).distinct(), "edges")
    found = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found if parts == 1 else found.groupBy("id").agg(F.min("component").alias("component"))
