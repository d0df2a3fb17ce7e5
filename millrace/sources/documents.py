"""A data source that writes one file for each row: exports as documents, with a commit that shows all of them or none.

Tasks write into a folder of their own under ``_pending``; the commit moves each task's folder to its place, so the driver
moves as many folders as there are tasks and names no file. A write that is aborted leaves nothing.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "name string, kind string, body string"
#: Ends of file names by kind.
ENDS = {"json": "json", "markdown": "md", "csv": "csv", "text": "txt"}


@dataclass
class Written(WriterCommitMessage):
    folder: str | None
    files: int


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), re.sub("^file:", "", path))


def file_name(name: str | None, kind: str | None) -> str:
    """A name that any file system takes; what it must change is told apart by a digest's first signs."""
    import hashlib

    name = name or ""
    safe = re.sub(r"[^A-Za-z0-9._-]", "_", name).lstrip("._")
    if safe != name or not safe:
        safe = f"{safe[:100] or 'unnamed'}-{hashlib.sha256(name.encode()).hexdigest()[:12]}"
    return f"{safe}.{ENDS.get(kind or '', 'txt')}"


class Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        system, base = _system(f"{self.path}/_pending/{self.job}/{uuid.uuid4().hex}")
        made = 0
        for row in rows:
            if not made:
                system.create_dir(base, recursive=True)
            with system.open_output_stream(f"{base}/{file_name(row['name'], row['kind'])}") as out:
                out.write((row["body"] or "").encode())
            made += 1
        return Written(base if made else None, made)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = _system(self.path)
        done = [m for m in messages if m and m.folder]
        system.create_dir(base, recursive=True)
        for n, m in enumerate(done):
            system.move(m.folder, f"{base}/part-{n:05d}-{self.job}")
        with system.open_output_stream(f"{base}/_done-{self.job}") as out:
            out.write(json.dumps({"files": sum(m.files for m in done), "parts": len(done)}).encode())
        self._clear(system, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_system(self.path))

    def _clear(self, system, base: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{base}/_pending/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/_pending/{self.job}")


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def write_documents(rows: DataFrame, path: str) -> None:
    """``rows(name, kind, body)`` as files under ``path``; name and kind together are distinct. A null body
    makes an empty file, a null name is that of no sign, what kind is unknown is text; further columns are not written."""
    from pyspark import cloudpickle
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows.sparkSession.dataSource.register(Documents)
    rows.select("name", "kind", "body").write.format("documents").mode("append").option("path", path).save()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(file, body)`` of what has been committed; an empty file has no row."""
    from pyarrow import fs

    system, base = _system(path)
    done = [f.base_name.removeprefix("_done-") for f in system.get_file_info(fs.FileSelector(base)) if f.base_name.startswith("_done-")]
    if not done:
        return spark.createDataFrame([], "file string, body string")
    # a job that committed no file has no part
    read = spark.read.option("pathGlobFilter", "[!_]*").option("ignoreMissingFiles", "true")
    parts = [f.path for f in system.get_file_info(fs.FileSelector(base)) if f.base_name.startswith("part-") and f.base_name.rsplit("-", 1)[1] in done]
    if not parts:
        return spark.createDataFrame([], "file string, body string")
    front = path[: path.index("://") + 3] if "://" in path else "file://"
    whole = read.text([front + p for p in parts], wholetext=True)
    return whole.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("body"))
