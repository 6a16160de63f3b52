"""The run store: a data source that writes a run's documents, registers it and makes it the latest, all at once or not at all.

    rows.write.format("quarry_run").options(path=..., registry=..., run_id=...).mode("append").save()

Rows are pieces of documents (file, part, ord, glue, text). Each file's pieces lie in one task, in order, and flow through it one by one: no document is ever
whole in memory. Tasks write below a hidden folder beside the run's; the commit moves what the committed attempts wrote, renames that folder to the run's
and writes the registry's entries. A run that fails or is stopped leaves no folder and no entry.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

PIECES = "file string, part int, ord string, glue string, text string"


def _files(path: str):
    """(file system, path there) of a folder that driver and tasks share: a mounted one or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"/{path}")


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: list[str]


class RunWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.run_id = options["path"].rstrip("/"), options["run_id"]
        self.registry = options["registry"].rstrip("/")
        parent, _, name = self.path.rpartition("/")
        self.hidden = f"{parent}/.{name}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, base = _files(self.hidden)
        task = TaskContext.get()
        folder = f"part-{task.partitionId()}-{task.taskAttemptId()}"
        files: list[str] = []
        out = now = None
        try:
            for r in iterator:
                if not files or r.file != files[-1]:
                    if out is not None:
                        out.close()
                    if r.file.startswith("/") or ".." in r.file.split("/"):
                        raise ValueError(f"no name of a run's file: {r.file}")
                    files.append(r.file)
                    fs.create_dir(f"{base}/{folder}/{r.file}".rpartition("/")[0], recursive=True)
                    out, now = fs.open_output_stream(f"{base}/{folder}/{r.file}"), None
                glue = r.glue if r.glue is not None and now == r.part else ""
                out.write((glue + r.text).encode())
                now = r.part
        finally:
            if out is not None:
                out.close()
        return Written(folder, files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = _files(self.hidden)
        fs, final = _files(self.path)
        ready = f"{base}/ready"
        fs.create_dir(ready, recursive=True)
        for m in messages:
            for file in m.files if m else []:
                fs.create_dir(f"{ready}/{file}".rpartition("/")[0], recursive=True)
                fs.move(f"{base}/{m.folder}/{file}", f"{ready}/{file}")
        if fs.get_file_info(final).type.name != "NotFound":
            raise FileExistsError(self.path)
        fs.move(ready, final)
        fs.delete_dir(base)
        entry = json.dumps({"runId": self.run_id, "outputDir": self.path}, ensure_ascii=False, indent=2)
        for name in (self.run_id, "latest"):
            self._put(f"{self.registry}/{name}.json", entry)

    def _put(self, path: str, text: str) -> None:
        """Write a file whole: beside its place first, then renamed."""
        fs, place = _files(path)
        folder, _, name = place.rpartition("/")
        fs.create_dir(folder, recursive=True)
        beside = f"{folder}/.{name}-{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(beside) as out:
            out.write(text.encode())
        fs.move(beside, place)

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = _files(self.hidden)
        if fs.get_file_info(base).type.name != "NotFound":
            fs.delete_dir(base)


class RunStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quarry_run"

    def schema(self) -> str:
        return PIECES

    def writer(self, schema, overwrite: bool) -> RunWriter:
        missing = [k for k in ("path", "registry", "run_id") if not (self.options.get(k) or "").strip()]
        if missing:
            raise ValueError(f"the run store needs the options {', '.join(missing)}")
        return RunWriter(dict(self.options))


def write_pieces(pieces: DataFrame, path: str, registry: str, run_id: str) -> None:
    """Write the documents of a run (file, part, ord, glue, text) to ``path`` and register it: all or nothing."""
    spark = pieces.sparkSession
    spark.dataSource.register(RunStore)
    dealt = pieces.selectExpr("file", "part", "ord", "glue", "text").repartition("file").sortWithinPartitions("file", "part", "ord")
    dealt.write.format("quarry_run").options(path=path, registry=registry, run_id=run_id).mode("append").save()
