"""Changes of a folder as a stream: a Python data source whose offsets are numbered listings.

Each trigger lists the folder (any file system that ``pyarrow.fs`` knows) and compares it with the listing before; files that were added, changed (another size or
time) or removed are the rows of the batch. A listing that differs is kept as a file of its number below ``state`` before its number is given out, so a restart
from a checkpoint goes on after the last batch, and a batch that is run again has the same rows. Register it with ``spark.dataSource.register(FolderChanges)``.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# Sources are planned in a process of their own that does not see the driver's module path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "path string, size long, modified timestamp, change string, version long"


class Between(InputPartition):
    def __init__(self, version: int):
        self.version = version


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.state = options["path"], options["state"]
        self.suffix, self.recursive = options.get("suffix", ""), options.get("recursive", "true") == "true"

    def _fs(self, uri: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{re.sub('^file:', '', uri)}")

    def _list(self) -> dict[str, list]:
        from pyarrow import fs

        files, top = self._fs(self.folder)
        found = files.get_file_info(fs.FileSelector(top, recursive=self.recursive, allow_not_found=True))
        return {f.path: [f.size, f.mtime_ns] for f in found if f.is_file and f.path.endswith(self.suffix)}

    def _kept(self) -> list[int]:
        from pyarrow import fs

        files, top = self._fs(self.state)
        names = [f.base_name for f in files.get_file_info(fs.FileSelector(top, allow_not_found=True))]
        return sorted(int(n.removesuffix(".json")) for n in names if re.fullmatch(r"\d+\.json", n))

    def _load(self, version: int) -> dict[str, list]:
        if version == 0:
            return {}
        files, top = self._fs(self.state)
        with files.open_input_stream(f"{top}/{version}.json") as f:
            return json.loads(f.read())

    def _keep(self, version: int, listing: dict[str, list]) -> None:
        files, top = self._fs(self.state)
        files.create_dir(top, recursive=True)
        with files.open_output_stream(f"{top}/.{version}.new") as f:
            f.write(json.dumps(listing, sort_keys=True).encode())
        files.move(f"{top}/.{version}.new", f"{top}/{version}.json")

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self, *unused) -> dict:
        kept = self._kept()
        last = kept[-1] if kept else 0
        now = self._list()
        if now != self._load(last):
            last += 1
            self._keep(last, now)
        return {"version": last}

    def partitions(self, start: dict, end: dict) -> list[Between]:
        return [Between(v) for v in range(start["version"] + 1, end["version"] + 1)]

    def read(self, partition: Between) -> Iterator[tuple]:
        from datetime import UTC, datetime

        old, new = self._load(partition.version - 1), self._load(partition.version)
        for path in sorted({*old, *new}):
            if old.get(path) != new.get(path):
                size, time = new.get(path) or old[path]
                change = "removed" if path not in new else "added" if path not in old else "changed"
                yield path, size, datetime.fromtimestamp(time / 1e9, UTC), change, partition.version

    def commit(self, end: dict) -> None:
        """Listings stay until ``forget``: an earlier checkpoint may still need them."""


class FolderChanges(DataSource):
    """Options: ``path``, the folder; ``state``, where listings are kept; ``suffix``, of the files that count; ``recursive`` (true)."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(dict(self.options))
