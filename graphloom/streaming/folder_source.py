"""A streaming source of file changes: an offset names a listing of a folder, a batch is the difference of two listings.

Listings are small files in a folder of their own, named by their content, so
an unchanged folder makes no batch and a query that starts again goes on from
the listing that it saw last. Files are listed on the driver by name, time and
size, and read by the tasks.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Files that one task reads.
FILES_A_TASK = 256
NAME = "folder_changes"


def _open(root: str):
    """(file system, path) of a folder in any file system that pyarrow knows; a plain path is a local one."""
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, str, int | None]]):
        self.files = files


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.listings = options["path"].rstrip("/"), options["listings"].rstrip("/")
        self.skip = set(filter(None, options.get("skip", "").split(",")))
        self.ends = tuple("." + e for e in filter(None, options.get("extensions", "").split(",")))

    def _list(self) -> dict[str, list[int]]:
        """Time and size of every file, by its path below the root; folders to be skipped are not entered."""
        from pyarrow import fs

        system, root = _open(self.root)
        found, todo = {}, [root]
        while todo:
            for info in system.get_file_info(fs.FileSelector(todo.pop(), allow_not_found=True)):
                if info.type == fs.FileType.Directory:
                    todo += [info.path] if info.base_name not in self.skip else []
                elif not self.ends or info.base_name.lower().endswith(self.ends):
                    found[info.path[len(root) :].lstrip("/")] = [info.mtime_ns or 0, info.size or 0]
        return found

    def _keep(self, listing: dict) -> str:
        text = json.dumps(listing, sort_keys=True).encode()
        name = hashlib.sha256(text).hexdigest()
        system, folder = _open(self.listings)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{name}.json") as out:
            out.write(text)
        return name

    def _load(self, name: str) -> dict[str, list[int]]:
        if not name:
            return {}
        system, folder = _open(self.listings)
        with system.open_input_stream(f"{folder}/{name}.json") as stream:
            return json.loads(stream.read())

    def initialOffset(self) -> dict:
        return {"listing": ""}

    def latestOffset(self) -> dict:
        listing = self._list()
        return {"listing": self._keep(listing) if listing else ""}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = self._load(start["listing"]), self._load(end["listing"])
        changed = [(p, "created" if p not in old else "modified", new[p][0]) for p in sorted(new) if old.get(p) != new[p]]
        changed += [(p, "deleted", None) for p in sorted(old) if p not in new]
        return [_Files(changed[i : i + FILES_A_TASK]) for i in range(0, len(changed), FILES_A_TASK)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, root = _open(self.root)
        for path, change, at in partition.files:
            content = None
            if change != "deleted":
                try:
                    with system.open_input_stream(f"{root}/{path}") as stream:
                        content = stream.read()
                except FileNotFoundError:
                    continue  # the next listing lacks it
            yield path, change, datetime.fromtimestamp(at / 1e9, timezone.utc) if at else None, content

    def commit(self, end: dict) -> None:
        """Listings are kept: a checkpoint may name any of them."""


class FolderChanges(DataSource):
    """(path, change, modified, content) of files below ``path``; ``listings``: where listings are kept; ``skip``: names of folders that are not entered; ``extensions``: of the files that count."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, change string, modified timestamp, content binary"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FolderReader(dict(self.options))
