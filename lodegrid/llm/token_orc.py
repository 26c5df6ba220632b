"""Token ids in ORC: integer run-length encoding, row indexes, and Bloom filters on document ids.

The ids of a document are one row (array<int>). Rows are dealt out by ranges of doc_id and sorted, so
files, stripes and row groups hold disjoint id ranges: a read for some ids skips files by their
statistics, row groups by the index, and what is left by the Bloom filter, and a full read is split by
stripes. Every row also says where it starts in its file; the ids before a file come from one small
row for each file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegrid.llm.bpe import LibraryEncoder, ship, word_bpe
from lodegrid.llm.common import cut, fields, shared_path, table, tidied

#: The file format: columns in this order.
LAYOUT = fields("doc_id long", "file int", "local_start long", "n_tokens int", "ids array<int>")
#: Bytes of a stripe, and rows of a row group (an index entry and a Bloom filter each).
STRIPE, ROW_GROUP, FALSE_POSITIVES = 64 << 20, 1000, 0.01


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode each whole text (null: empty) with the tokenizers library, append ``end_id``, and write ORC.

    Rows go in ascending id order, null ids first; rows that repeat an id follow each other in the
    order of their texts. Only the two named columns are read. An empty table gives a file without rows.
    """
    shipped = ship(docs, tokenizer, LibraryEncoder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, start, end = TaskContext.get().partitionId(), 0, int(end_id).to_bytes(4, "little")
        for whole in batches:
            for batch in cut(whole, 1):
                ids = shipped.value.encoder().encode_bytes(batch.column(1).to_pylist())
                sizes = np.array([len(b) // 4 + 1 for b in ids], np.int32)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                flat = np.frombuffer(end.join([*ids, b""]), "<i4")
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(ids), file, np.int32)), pa.array(start + ends[:-1], pa.int64()), pa.array(sizes), column], names=LAYOUT.names)
                start += int(ends[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(tidied(run), LAYOUT).write.options(
        **{
            "compression": "zstd",
            "orc.stripe.size": STRIPE,
            "orc.create.index": "true",
            "orc.row.index.stride": ROW_GROUP,
            "orc.bloom.filter.columns": "doc_id",
            "orc.bloom.filter.fpp": FALSE_POSITIVES,
        }
    ).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, file, local_start, n_tokens, ids) as written; filters on doc_id reach the stripes' metadata."""
    return spark.read.schema(LAYOUT).orc(path)


def read_documents(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The rows of a few documents, by metadata and Bloom filters."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(ids))


def starts(tokens: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all documents before a row, over all files.

    The totals of files are gathered (one row for each file, so their number is the number of write
    tasks) and sent back as a table of that size.
    """
    spark = tokens.sparkSession
    totals = tokens.groupBy("file").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("n")).orderBy("file").collect()
    before = np.cumsum([0, *(r.n for r in totals)]).tolist()
    offsets = spark.createDataFrame([(r.file, b) for r, b in zip(totals, before, strict=False)], fields("file int", "before long"))
    return tokens.join(F.broadcast(offsets), "file").withColumn("start", F.col("before") + F.col("local_start")).drop("before")


def summary(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row: the checksum is of the ids as little-endian
    unsigned 32-bit integers."""
    schema = fields("doc_id long", "start long", "n_tokens long", "ids_crc32 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            flat, ends = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
            sums = [zlib.crc32(memoryview(flat[a:b]).cast("B")) if b > a else 0 for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends), pa.int64()), pa.array(sums, pa.int64())], names=schema.names)

    return starts(tokens).select("doc_id", "start", "ids").mapInArrow(tidied(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts, counts and checksums of every document's ids, read back from the files."""
    path = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, word_bpe(), end_id=2)
    return summary(read_tokens(spark, path))
