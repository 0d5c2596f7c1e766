"""A sink of files: each document's artifacts as files of its own, whole or not at all.

A task writes into a folder that is its own attempt's; what it has written counts only once the job's commit lists
that folder in a manifest. So a task that fails and is made again leaves one copy, and a job that fails leaves
none. The commit names one folder a task, however many files there are.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.text import ARTIFACT_FILE

_NAME = re.compile(ARTIFACT_FILE)
MANIFEST = "_files"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    store, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store, inside.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> Written:
        store, top = _opened(self.path)
        folder, seen = f"part-{uuid.uuid4().hex}", set()
        try:
            for doc_id, name, content in rows:
                if not _NAME.fullmatch(name or ""):
                    raise ValueError(f"not a name of an artifact: {name!r}")
                if not content:
                    raise ValueError(f"document {doc_id} has nothing in {name}")
                if (doc_id, name) in seen:
                    raise ValueError(f"document {doc_id} has {name} twice")
                seen.add((doc_id, name))
                at = f"{top}/{folder}/{int(doc_id)}"
                store.create_dir(at, recursive=True)
                with store.open_output_stream(f"{at}/{name}") as f:
                    f.write(bytes(content))
        except BaseException:
            if seen:
                store.delete_dir(f"{top}/{folder}")
            raise
        return Written(folder, len(seen))

    def commit(self, messages: list) -> None:
        store, top = _opened(self.path)
        store.create_dir(f"{top}/{MANIFEST}", recursive=True)
        lines = "".join(json.dumps({"folder": m.folder, "files": m.files}) + "\n" for m in messages if m is not None and m.files)
        name = uuid.uuid4().hex
        with store.open_output_stream(f"{top}/{MANIFEST}/.{name}") as f:
            f.write(lines.encode())
        store.move(f"{top}/{MANIFEST}/.{name}", f"{top}/{MANIFEST}/{name}.json")

    def abort(self, messages: list) -> None:
        store, top = _opened(self.path)
        for m in messages:
            if m is not None and m.files:
                store.delete_dir(f"{top}/{m.folder}")


class ArtifactSink(DataSource):
    """Format ``artifact_files``: rows of doc_id, name and content; option path is the folder all share."""

    @classmethod
    def name(cls) -> str:
        return "artifact_files"

    def schema(self) -> str:
        return "doc_id long, name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("artifact files are added to a folder; take a new one instead of overwriting")
        return _Writer(self.options["path"])


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    """Write rows of doc_id, name and content as files, a document's in one task."""
    spark = artifacts.sparkSession
    spark.dataSource.register(ArtifactSink)
    rows = artifacts.select(F.col("doc_id").cast("long").alias("doc_id"), "name", "content").repartition("doc_id", F.col("name"))
    rows.write.format("artifact_files").mode("append").option("path", path).save()


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, name, content) of what was committed; files of tasks that did not come through are not seen."""
    done = spark.read.schema("folder string, files long").json(f"{path.rstrip('/')}/{MANIFEST}").select("folder")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*").load(f"{path.rstrip('/')}/part-*")
    parts = F.split("path", "/")
    files = files.select(F.element_at(parts, -3).alias("folder"), F.element_at(parts, -2).cast("long").alias("doc_id"), F.element_at(parts, -1).alias("name"), "content")
    return files.join(done, "folder", "left_semi").select("doc_id", "name", "content")
