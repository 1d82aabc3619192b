"""A sink for reports: a file for each row (name, content), with digests and a manifest that only holds what was committed.

Each task writes to a folder of its own attempt: its files, then a list of their names and SHA-256. What it hands to the
driver is the list's own digest and length, so the driver's manifest of a run grows with the tasks, not with the reports. The
manifest is written last; a folder that it doesn't name (of a failed or a repeated attempt) is no part of the run and is
deleted. A run reads nothing of earlier ones, and doesn't write over one that has a manifest."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "pagelens_reports"
MANIFEST, LISTED = "MANIFEST.sha256.json", "files.sha256.jsonl"


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    sha256: str
    files: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, run: str):
        self.path, self.run = path.rstrip("/"), run

    def write(self, rows: Iterator[Row]) -> Written:
        system, root = _file_system(f"{self.path}/{self.run}")
        folder, listed, names = uuid.uuid4().hex, [], {}
        system.create_dir(f"{root}/{folder}", recursive=True)
        for name, content in rows:
            raw = content.encode() if isinstance(content, str) else bytes(content or b"")
            names[name] = names.get(name, 0) + 1
            if names[name] > 1:  # a task's second report of a name
                stem, dot, end = name.rpartition(".")
                name = f"{stem or end}~{names[name]}{dot if stem else ''}{end if stem else ''}"
            with system.open_output_stream(f"{root}/{folder}/{name}") as out:
                out.write(raw)
            listed.append(json.dumps({"name": name, "sha256": hashlib.sha256(raw).hexdigest()}, ensure_ascii=False))
        said = "".join(line + "\n" for line in listed).encode()
        with system.open_output_stream(f"{root}/{folder}/{LISTED}") as out:
            out.write(said)
        return Written(folder, hashlib.sha256(said).hexdigest(), len(listed))

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _file_system(f"{self.path}/{self.run}")
        parts = sorted(({"folder": m.folder, "sha256": m.sha256, "files": m.files} for m in messages if m), key=lambda p: p["folder"])
        self._drop({p["folder"] for p in parts})
        system.create_dir(root, recursive=True)
        said = {"run": self.run, "algorithm": "SHA-256", "files": sum(p["files"] for p in parts), "parts": parts}
        with system.open_output_stream(f"{root}/.{MANIFEST}") as out:
            out.write(json.dumps(said, indent=2).encode())
        system.move(f"{root}/.{MANIFEST}", f"{root}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(set())

    def _drop(self, kept: set[str]) -> None:
        """Deletes the folders of other attempts."""
        system, root = _file_system(f"{self.path}/{self.run}")
        for found in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if found.type == fs.FileType.Directory and found.base_name not in kept:
                system.delete_dir(found.path)


class ReportFiles(DataSource):
    """The sink by name, for df.write.format(FORMAT).option("run", ...).save(path)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if schema.names != ["name", "content"]:
            raise ValueError("a report has a name and a content")
        return _Writer(self.options["path"], self.options["run"])


def write_files(files: DataFrame, path: str, run: str) -> dict:
    """Writes files (name, content) as a run under path; its manifest."""
    system, manifest = _file_system(f"{path.rstrip('/')}/{run}/{MANIFEST}")
    if system.get_file_info(manifest).type != fs.FileType.NotFound:
        raise ValueError(f"run {run} is there already")
    files.sparkSession.dataSource.register(ReportFiles)
    files.select("name", "content").write.format(FORMAT).mode("append").option("run", run).option("path", path).save()
    with system.open_input_stream(manifest) as f:
        return json.loads(f.read())


def verified(path: str, run: str) -> list[str]:
    """Names of files of a run that are missing or don't have the digest that was committed; [] for an untouched run."""
    system, root = _file_system(f"{path.rstrip('/')}/{run}")
    read = lambda p: system.open_input_stream(p).read() if system.get_file_info(p).type == fs.FileType.File else None
    bad = []
    for part in json.loads(read(f"{root}/{MANIFEST}"))["parts"]:
        said = read(f"{root}/{part['folder']}/{LISTED}")
        if said is None or hashlib.sha256(said).hexdigest() != part["sha256"]:
            bad.append(f"{part['folder']}/{LISTED}")
            continue
        for one in map(json.loads, said.decode().splitlines()):
            raw = read(f"{root}/{part['folder']}/{one['name']}")
            if raw is None or hashlib.sha256(raw).hexdigest() != one["sha256"]:
                bad.append(f"{part['folder']}/{one['name']}")
    return bad
