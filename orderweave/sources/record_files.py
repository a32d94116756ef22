"""Order records as files that people open: a Python data source with a two-phase commit.

    spark.dataSource.register(RecordFiles)
    sinks.order_records(orders).withColumn("dt", ...).repartition("dt").write.format("record_files").mode("append").option("path", folder).save()

Each task writes a file for each day into a staging folder; only the commit puts them in their place, under names that say
day, host and batch (20260131_1a2b_7_0.csv). A batch that is written again replaces what its first try left, and does nothing if
that was committed; a failed one leaves nothing. Files are CSV with a byte-order mark and one header.
"""

from __future__ import annotations

import csv
import io
import json
import socket
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MARK = "﻿"


@dataclass
class Written(WriterCommitMessage):
    """Staged files of a task, by day."""

    files: dict[str, str]


class RecordFiles(DataSource):
    """Rows: dt (yyyyMMdd, the day) and columns that are text already. Options: path; host (its last four characters name the files); batch (an id for
    writes outside of streams, by which a repeated one is known)."""

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("records are appended")
        return _Batch(self.options, schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _Stream(self.options, schema)


class _Files:
    def __init__(self, options, schema: StructType):
        self.path, self.names = options["path"], [n for n in schema.names if n != "dt"]
        self.host = options.get("host", socket.gethostname())[-4:]
        self.batch_id, self.run = options.get("batch", uuid.uuid4().hex), uuid.uuid4().hex

    def store(self) -> tuple[fs.FileSystem, str]:
        store, folder = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        return store, folder.rstrip("/")

    def write(self, rows: Iterator[Row]) -> Written:
        store, folder = self.store()
        staging, files, writers = f"{folder}/_staging/{self.run}", {}, {}
        store.create_dir(staging)
        try:
            for row in rows:
                day = row["dt"]
                if day not in writers:
                    files[day] = f"{staging}/{uuid.uuid4().hex}"
                    writers[day] = io.TextIOWrapper(store.open_output_stream(files[day]), "utf-8", newline="")
                    writers[day].write(MARK)
                    csv.writer(writers[day]).writerow(self.names)
                csv.writer(writers[day]).writerow(["" if row[n] is None else row[n] for n in self.names])
        finally:
            for w in writers.values():
                w.close()
        return Written(files)

    def put(self, messages: list[Written | None], batch: str) -> None:
        store, folder = self.store()
        done = f"{folder}/_committed/{batch}"
        if store.get_file_info(done).type == fs.FileType.NotFound:
            for f in store.get_file_info(fs.FileSelector(folder)):  # what a commit that wasn't finished left
                if f.type == fs.FileType.File and f.base_name.split("_")[1:3] == [self.host, batch]:
                    store.delete_file(f.path)
            names, k = [], 0
            for m in messages:
                for day, staged in sorted(m.files.items()) if m else ():
                    names.append(f"{day}_{self.host}_{batch}_{k}.csv")
                    store.move(staged, f"{folder}/{names[-1]}")
                    k += 1
            store.create_dir(f"{folder}/_committed")
            with store.open_output_stream(f"{done}.{self.run}") as out:
                out.write(json.dumps(names).encode())
            store.move(f"{done}.{self.run}", done)
        self.drop(messages)

    def drop(self, messages: list[Written | None]) -> None:
        store, folder = self.store()
        for m in messages:
            for staged in m.files.values() if m else ():
                if store.get_file_info(staged).type != fs.FileType.NotFound:
                    store.delete_file(staged)
        if store.get_file_info(f"{folder}/_staging/{self.run}").type != fs.FileType.NotFound and not store.get_file_info(fs.FileSelector(f"{folder}/_staging/{self.run}")):
            store.delete_dir(f"{folder}/_staging/{self.run}")


class _Batch(_Files, DataSourceWriter):
    def commit(self, messages) -> None:
        self.put(messages, self.batch_id)

    def abort(self, messages) -> None:
        self.drop(messages)


class _Stream(_Files, DataSourceStreamWriter):
    def commit(self, messages, batchId: int) -> None:
        self.put(messages, str(batchId))

    def abort(self, messages, batchId: int) -> None:
        self.drop(messages)
