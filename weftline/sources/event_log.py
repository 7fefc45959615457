"""A sink of events as a data source: JSON lines in a shared folder, of which a batch becomes visible whole, once, or not at all.

Tasks write their rows to files of names of their own; a batch is committed by one small manifest that lists the files of the tasks that
succeeded, put in place by a rename. Readers take what manifests list, so failed attempts, aborted batches and files of a batch that
was already committed (a stream that is run again) leave no trace in what is read, and their files are removed.

    df.write.format("event_log").option("path", folder).mode("append").save()
    stream.writeStream.format("event_log").option("path", folder).option("checkpointLocation", c).start()

A folder has one stream writer at most: its batches are told apart by their number.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from weftline.plans.storage import list_folder

#: Bytes of text after which a task begins another file.
FILE_BYTES = 128 << 20


def _store(path: str):
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return store, root.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Files:
    """What the batch and the stream writer share."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = _store(self.path)
        store.create_dir(f"{root}/data", recursive=True)
        files, out, size = [], None, 0
        try:
            for row in iterator:
                if out is None or size > FILE_BYTES:
                    if out is not None:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.jsonl")
                    out, size = store.open_output_stream(f"{root}/data/{files[-1]}"), 0
                line = (row[0] + "\n").encode()
                out.write(line)
                size += len(line)
        except BaseException:
            if out is not None:
                out.close()
            self._remove(files)  # of a failed attempt nobody else knows the names
            raise
        if out is not None:
            out.close()
        return Written(files)

    def _remove(self, files: list[str]) -> None:
        store, root = _store(self.path)
        for f in files:
            try:
                store.delete_file(f"{root}/data/{f}")
            except FileNotFoundError:
                pass

    def _commit(self, messages: list, name: str) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        store.create_dir(f"{root}/commits", recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        if store.get_file_info(f"{root}/commits/{name}.json").type == fs.FileType.File:
            self._remove(files)
            return
        draft = f"{root}/.{uuid.uuid4().hex}.json"
        with store.open_output_stream(draft) as out:
            out.write(json.dumps({"files": files}).encode())
        store.move(draft, f"{root}/commits/{name}.json")

    def _abort(self, messages: list) -> None:
        self._remove([f for m in messages if m is not None for f in m.files])


class BatchWriter(_Files, DataSourceWriter):
    def commit(self, messages: list) -> None:
        self._commit(messages, uuid.uuid4().hex)

    def abort(self, messages: list) -> None:
        self._abort(messages)


class StreamWriter(_Files, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self._commit(messages, f"batch-{batchId}")

    def abort(self, messages: list, batchId: int) -> None:
        self._abort(messages)


class EventLog(DataSource):
    """Rows of one text column, JSON each."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: T.StructType, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("an event log is appended to")
        return BatchWriter(self.options)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventLog)


def read_events(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The events of all committed batches, as columns of ``schema``; fields that an event lacks are null."""
    if not list_folder(spark, f"{path}/commits"):
        return spark.createDataFrame([], schema)
    manifests = spark.read.schema("files array<string>").json(f"{path}/commits")
    # Names of files, one for each task of each batch: what a driver holds of any table it reads.
    files = [f"{path}/data/{r.f}" for r in manifests.select(F.explode("files").alias("f")).distinct().collect()]
    return spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)
