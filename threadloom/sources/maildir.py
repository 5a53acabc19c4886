"""A Maildir folder as a streaming source whose offset is the newest (mtime, name) seen, within a generation."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

_DIRS = ("cur", "new")


class _Slice(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class MaildirReader(DataSourceStreamReader):
    """Batches of ``batch`` files in (mtime, name) order.  A folder made anew (another inode) is read again from its start; the ledger's keys absorb repeats."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.batch = int(options.get("batch", "500"))
        self.start = int(options.get("startFrom", "0"))

    def _generation(self) -> int:
        return os.stat(self.root).st_ino

    def _files(self) -> list[tuple[int, str, str]]:
        out = []
        for d in _DIRS:
            if os.path.isdir(p := os.path.join(self.root, d)):
                out += [(e.stat().st_mtime_ns, e.name, e.path) for e in os.scandir(p) if e.is_file()]
        return sorted(out)

    def initialOffset(self) -> dict:
        return {"generation": self._generation(), "mtime": self.start * 10**9, "name": ""}

    def latestOffset(self) -> dict:
        last = self._files()[-1:]
        return {"generation": self._generation(), "mtime": last[0][0], "name": last[0][1]} if last else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low = (start["mtime"], start["name"]) if start["generation"] == end["generation"] else (self.start * 10**9, "")
        files = [p for m, n, p in self._files() if low < (m, n) <= (end["mtime"], end["name"])]
        return [_Slice(files[i : i + self.batch]) for i in range(0, len(files), self.batch)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for path in partition.files:
            try:
                with open(path, "rb") as f:
                    yield path, f.read()
            except OSError:  # moved between listing and reading: the next batch sees its new name
                continue


class MaildirSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "maildir"

    def schema(self) -> str:
        return "path string, content binary"

    def streamReader(self, schema) -> MaildirReader:
        return MaildirReader(dict(self.options))
