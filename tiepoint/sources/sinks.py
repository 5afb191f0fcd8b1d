"""Files as a sink with a commit: all rows of a job become files, or none.

Tasks write drafts into a folder of the job's own; a task that is tried again writes
other drafts. The driver learns names and draft names only. It refuses two rows of one
name and names that are there already, before anything is published, and on any
failure removes the drafts. A new folder is published by one renaming.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tiepoint.sources.store import escaped, place


@dataclass
class Drafts(WriterCommitMessage):
    """What a task has written: the files' names and the folder of its drafts."""

    folder: str
    names: list[str]


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.target, self.suffix = options["path"].rstrip("/"), options.get("suffix", "")
        self.drafts = f"{self.target}.drafts-{uuid.uuid4().hex}"
        system, base = place(self.drafts)
        system.create_dir(base, recursive=True)

    def write(self, iterator) -> Drafts:
        system, base = place(self.drafts)
        own = uuid.uuid4().hex
        system.create_dir(f"{base}/{own}", recursive=False)  # fails where the job has been given up
        names: dict[str, None] = {}
        for batch in iterator:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name is None or content is None:
                    raise ValueError("a file without a name or content")
                file = escaped(name) + self.suffix
                if file in names:
                    raise ValueError(f"two rows are named {name!r}")
                with system.open_output_stream(f"{base}/{own}/{file}") as f:
                    f.write(content)
                names[file] = None
        return Drafts(own, list(names))

    def commit(self, messages: list) -> None:
        system, base = place(self.drafts)
        _, target = place(self.target)
        seen: dict[str, str] = {}
        try:
            for m in messages:
                for name in m.names:
                    if name in seen:
                        raise ValueError(f"two rows make the file {name!r}")
                    seen[name] = f"{base}/{m.folder}/{name}"
            from pyarrow import fs

            there = system.get_file_info(fs.FileSelector(target, allow_not_found=True))
            if taken := sorted({f.base_name for f in there} & set(seen)):
                raise ValueError(f"{len(taken)} files are there already, such as {taken[0]!r}")
            if not there and len([m for m in messages if m.names]) == 1:
                only = next(m for m in messages if m.names)
                if system.get_file_info(target).type != fs.FileType.NotFound:
                    system.delete_dir(target)
                system.move(f"{base}/{only.folder}", target)
            else:
                system.create_dir(target, recursive=True)
                for name, draft in seen.items():
                    system.move(draft, f"{target}/{name}")
        finally:
            self.abort(messages)

    def abort(self, messages: list) -> None:
        system, base = place(self.drafts)
        from pyarrow import fs

        if system.get_file_info(base).type == fs.FileType.Directory:
            system.delete_dir(base)


class Files(DataSource):
    """``df.write.format("named_files").option("suffix", ".png").mode("append").save(folder)`` for rows ``name, content``."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        if overwrite:
            raise ValueError("named files are only added; write into a new folder")
        return FilesWriter(self.options)


def write(files: DataFrame, folder: str, suffix: str = "") -> None:
    """Each row ``name, content`` as a file of the folder, named by its escaped name and the suffix.

    Different names make different files. Nothing is written if two rows have one
    name, a name is there already, or a row lacks name or content. A store that pyarrow
    cannot open raises an error before any work.
    """
    place(folder)
    spark = files.sparkSession
    spark.dataSource.register(Files)
    rows = files.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content"))
    rows.write.format("named_files").option("suffix", suffix).mode("append").save(folder)
