"""Token counts of documents in flat token files without an index, by scanning for the end-of-document identifier.

A flat file is a run of fixed-width little-endian ids in which each document ends with the separator; it is held as blocks
(file, block, ids), all of one size but the last, cut without regard to documents. Each block is searched with one vectorised
comparison. What crosses block boundaries is stitched by a prefix scan over blocks in two levels (blocks in runs of RUN, then
runs), so that no task holds all blocks of a large file: the ids, separators and last separator before each block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.tokens import encoder
from weftline.plans.storage import Spill, shuffle_partitions

SEPARATOR, BLOCK_TOKENS, RUN = 49407, 1 << 16, 4096
BLOCKS = "file_id long, block long, ids binary"
#: Files up to this length are read whole (Spark's bound for a binary value is 2 GB); blocks of a range of a larger file.
WHOLE_BYTES, RANGE_BLOCKS = 256 << 20, 1024


def _write(encode, separator: int, block: int, width: int):
    dtype = f"<u{width}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        names: list = []
        first = 0
        end = np.array([separator], dtype).tobytes()

        def cut(everything: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, held, size, first, names
            data = b"".join(held)
            step = block * width
            whole = len(data) if everything else len(data) // step * step
            parts = [data[i : i + step] for i in range(0, whole, step)]
            held, size = [data[whole:]], len(data) - whole
            if parts:
                rest = len(parts) - 1
                cols = [pa.array([file] * len(parts), pa.int64()), pa.array(range(number, number + len(parts)), pa.int64()), pa.array(parts, pa.binary()), pa.array([first] * len(parts), pa.int64()), pa.array([names, *[[]] * rest], pa.list_(pa.int64()))]
                yield pa.record_batch(cols, ["file_id", "block", "ids", "first_doc", "doc_ids"])
                number, first, names = number + len(parts), first + len(names), []

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                names += batch.column(1).slice(at, 256).to_pylist()
                for ids in encode([x or "" for x in batch.column(0).slice(at, 256).to_pylist()]):
                    held.append(np.frombuffer(ids, "<u4").astype(dtype).tobytes() + end)
                    size += len(held[-1])
                if size >= 16 * block * width:
                    yield from cut(False)
        yield from cut(True)

    return write


def write_token_blocks(docs: DataFrame, tokenizer: str, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS, width: int = 2, text_col: str = "text", id_col: str | None = None) -> DataFrame:
    """Flat token files of ``docs``, one for each input partition: (file_id, block, ids). Null texts are empty documents.

    Beside the file, and of no use to the scan, first_doc and doc_ids list the documents in the order they were written, some
    with each run of blocks (``id_col``; null ids without it).

    Strings of special tokens in a text are ordinary text, so the separator ends documents only. ``width`` bytes an id.
    """
    rows = docs.select(F.col(text_col).cast("string"), (F.col(id_col) if id_col else F.lit(None)).cast("long"))
    return rows.mapInArrow(_write(encoder(tokenizer, plain=True), separator, block_tokens, width), f"{BLOCKS}, first_doc long, doc_ids array<long>")


def read_token_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Blocks of raw flat files under ``path``.

    Files of up to ``whole_bytes`` come through Spark's ``binaryFile``, from any file system Spark reads. Larger ones are read in
    ranges of RANGE_BLOCKS blocks, one task's work each, through pyarrow's file systems (local, HDFS, S3, GCS). file_id is the
    XXH64 of the file's path. A file whose length is no multiple of ``width`` raises an error; an empty file has no blocks.
    """
    step = block_tokens * width

    def table(file: int, first: int, data: pa.Buffer) -> Iterator[pa.RecordBatch]:
        for i in range(0, data.size, step):
            part = data.slice(i, min(step, data.size - i)).to_pybytes()
            yield pa.record_batch([pa.array([file], pa.int64()), pa.array([first + i // step], pa.int64()), pa.array([part], pa.binary())], ["file_id", "block", "ids"])

    def check(size: int) -> None:
        if size % width:
            raise ValueError("the length of a token file is no multiple of the id width")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                check(data.as_buffer().size)
                yield from table(file, 0, data.as_buffer())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                check(row["length"])
                system, name = FileSystem.from_uri(re.sub("^file:/+", "file:///", row["path"]))
                with system.open_input_file(name) as file:
                    for first in range(row["block"], row["block"] + RANGE_BLOCKS):
                        size = min(step, row["length"] - first * step)
                        if size <= 0:
                            break
                        file.seek(first * step)
                        yield from table(row["file_id"], first, file.read_buffer(size))

    files = spark.read.format("binaryFile").load(path).withColumn("file_id", F.xxhash64("path"))
    small = files.where(F.col("length") <= whole_bytes).select("file_id", "content").mapInArrow(cut, BLOCKS)
    ranges = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / step), F.lit(RANGE_BLOCKS).cast("long")))
    large = files.where(F.col("length") > whole_bytes).select("file_id", "path", "length", ranges.alias("block"))
    return small.union(large.repartition(shuffle_partitions(spark)).mapInArrow(read, BLOCKS))


def _find(separator: int, width: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found = [], []
            for ids in batch.column(2):
                x = np.frombuffer(ids.as_buffer(), f"<u{width}") if ids.is_valid else np.empty(0, f"<u{width}")
                n.append(len(x))
                found.append(np.flatnonzero(x == separator))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["file_id", "block", "n", "ends"])

    return find


def count_tokens(blocks: DataFrame, separator: int = SEPARATOR, width: int = 2, run: int = RUN) -> DataFrame:
    """(file_id, doc_index, start_token, n_tokens, terminated): the documents of flat files; n_tokens without the separator.

    Ids after a file's last separator are a document with terminated = false; a file without ids has none. Files and
    documents may be of any length; separators next to each other bound empty documents. An empty table gives an empty table.
    """
    seen = Spill(blocks.mapInArrow(_find(separator, width), "file_id long, block long, n long, ends array<long>"), "ends")
    summary = seen.df.select("file_id", "block", "n", F.size("ends").cast("long").alias("k"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"), F.floor(F.col("block") / run).alias("run"))
    inside = Window.partitionBy("file_id", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = summary.select("file_id", "run", "block", "n", "k", "last", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("n0"), F.coalesce(F.sum("k").over(inside), F.lit(0)).alias("k0"))
    local = local.withColumn("end0", F.max(F.col("n0") + F.col("last")).over(inside))
    runs = local.groupBy("file_id", "run").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.max(F.col("n0") + F.col("last")).alias("last"))
    across = Window.partitionBy("file_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("file_id", "run", "last", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("n1"), F.coalesce(F.sum("k").over(across), F.lit(0)).alias("k1"))
    runs = runs.withColumn("end1", F.max(F.col("n1") + F.col("last")).over(across)).drop("last")
    before = local.join(runs, ["file_id", "run"]).select("file_id", "block", (F.col("n0") + F.col("n1")).alias("at"), (F.col("k0") + F.col("k1")).alias("nth"), F.coalesce(F.col("end0") + F.col("n1"), "end1", F.lit(-1)).alias("end"))
    rows = seen.df.join(before, ["file_id", "block"])
    ends = F.transform("ends", lambda e: e + F.col("at"))
    starts = F.concat(F.array(F.col("end") + 1), F.transform(F.slice(ends, 1, F.greatest(F.size("ends") - 1, F.lit(0))), lambda e: e + 1))
    docs = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x, i: F.struct((F.col("nth") + i).alias("doc_index"), x["s"].alias("start_token"), (x["e"] - x["s"]).alias("n_tokens")))
    whole = rows.where(F.size("ends") > 0).select("file_id", F.inline(docs)).withColumn("terminated", F.lit(True))
    total = before.join(seen.df.select("file_id", "block", "n", F.size("ends").alias("k"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last")), ["file_id", "block"])
    total = total.groupBy("file_id").agg(F.max(F.col("at") + F.col("n")).alias("n"), F.max(F.col("nth") + F.col("k")).alias("doc_index"), F.coalesce(F.max(F.col("at") + F.col("last")), F.lit(-1)).alias("end"))
    tail = total.where(F.col("n") > F.col("end") + 1).select("file_id", "doc_index", (F.col("end") + 1).alias("start_token"), (F.col("n") - F.col("end") - 1).alias("n_tokens"), F.lit(False).alias("terminated"))
    return whole.union(tail)


def document_token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, file_id, doc_index, start_token, n_tokens): flat token files of ``docs`` written, scanned, and named again.

    The files hold no ids of documents; a document is the doc_index-th of its file, and the list of what was written, in order,
    gives its doc_id. Null and repeated doc_ids keep their rows; null texts have 0 tokens; other columns are ignored.
    """
    blocks = Spill(write_token_blocks(docs, tokenizer, text_col=text_col, id_col=id_col), "tokens")
    names = blocks.df.select("file_id", "first_doc", F.posexplode("doc_ids").alias("k", "doc_id"))
    names = names.select("file_id", (F.col("first_doc") + F.col("k")).alias("doc_index"), "doc_id")
    counts = count_tokens(blocks.df.select("file_id", "block", "ids")).drop("terminated")
    return names.join(counts, ["file_id", "doc_index"]).select("doc_id", "file_id", "doc_index", "start_token", "n_tokens")
