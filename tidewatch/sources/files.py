"""A sink for files with names of their own: rows (path, content) become lines of files below a folder.

Tasks write to a pending folder beside the files; only when all have succeeded are their files moved into place. A task that
fails, and a job that fails, leave nothing. The folder may be anything that Arrow's file systems open: a local or mounted
path, file:, hdfs:, s3: and others.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tidewatch.session import ship

NAME = "tidewatch_files"
#: Files that are moved at a time.
MOVES = 32


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: pairs of a pending file and the path it goes to."""

    files: list[tuple[str, str]]


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str, header: str | None, overwrite: bool):
        self.path, self.header, self.overwrite = path.rstrip("/"), header, overwrite
        self.job = uuid.uuid4().hex

    def place(self) -> tuple[fs.FileSystem, str]:
        if ":/" in self.path:
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), self.path

    def pending(self, base: str) -> str:
        return f"{base}/_pending-{self.job}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        """Consecutive rows of one path are lines of one file, after the header; a path may not come back later."""
        store, base = self.place()
        mine = f"{self.pending(base)}/{uuid.uuid4().hex}"
        store.create_dir(mine, recursive=False)  # none below the folder of a job that has already failed
        files: list[tuple[str, str]] = []
        seen: set[str] = set()
        out = None
        try:
            for row in rows:
                if not files or row["path"] != files[-1][1]:
                    if out:
                        out.close()
                    if row["path"] in seen or any(part in ("", ".", "..") for part in row["path"].split("/")):
                        raise ValueError(f"{row['path']}: a file's lines must come together, and its path lead down")
                    seen.add(row["path"])
                    files.append((f"{mine}/{len(files)}", row["path"]))
                    out = store.open_output_stream(files[-1][0])
                    if self.header is not None:
                        out.write(f"{self.header}\n".encode())
                out.write(f"{row['content']}\n".encode())
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = self.place()
        files = [f for m in messages if m for f in m.files]
        twice = len({to for _, to in files}) < len(files)
        if twice:
            self.abort(messages)
            raise ValueError("two tasks wrote the same file")
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(base)):
                if info.path.rsplit("/", 1)[-1] != f"_pending-{self.job}":
                    (store.delete_dir if info.type == fs.FileType.Directory else store.delete_file)(info.path)
        for folder in sorted({f"{base}/{to}".rsplit("/", 1)[0] for _, to in files}):
            store.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda f: store.move(f[0], f"{base}/{f[1]}"), files))
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """What is left of the job's pending files goes."""
        store, base = self.place()
        if store.get_file_info(self.pending(base)).type == fs.FileType.Directory:
            store.delete_dir(self.pending(base))


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        made = FilesWriter(self.options["path"], self.options.get("header"), overwrite)
        store, base = made.place()
        store.create_dir(made.pending(base), recursive=True)
        return made


def write_files(rows: DataFrame, path: str, header: str | None = None, overwrite: bool = False) -> None:
    """Write rows (path, content) below path. Files of other names stay unless overwrite clears the folder. Rows of one file
    must stand together in one partition, in their order; null contents are empty lines."""
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(Files)
    lines = rows.selectExpr("path", "coalesce(content, '') AS content").write.format(NAME).mode("overwrite" if overwrite else "append")
    (lines if header is None else lines.option("header", header)).save(path)
