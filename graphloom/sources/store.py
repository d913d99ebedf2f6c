"""A table store: versioned Parquet, where a write makes a version and then moves the pointer."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import memory
from .schemas import KEYS, TABLES, empty, migrate


#: Folders of a version beyond which an append writes all rows as one.
MAX_PARTS = 32


class ConflictError(RuntimeError):
    """Two writers want the same version of a table."""


class TableStore:
    """Tables under a root folder of any file system that Spark reads.

    A version is a list of folders ``v=<n>``: a write makes one of its own, an
    append adds one to those of the version before. It is whole once its note
    ``version=<n>.json`` is there, so readers take the greatest noted one, and
    no folder is written in place: a query may read the table that it writes.
    A writer claims its number first; a second writer of the same number is
    refused. ``recover`` frees the number of a writer that was lost.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 3):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def _path(self, text: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(text)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        p, fs = self._path(f"{self.root}/{name}")
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self, name: str) -> list[int]:
        return sorted(int(f[8:-5]) for f in self._names(name) if f.startswith("version=") and f.endswith(".json"))

    def _note(self, name: str, version: int) -> dict:
        p, fs = self._path(f"{self.root}/{name}/version={version}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, path: str, text: str, over: bool) -> None:
        p, fs = self._path(path)
        out = fs.create(p, over)
        out.write(text.encode())
        out.close()

    def read(self, name: str) -> DataFrame:
        have = self.versions(name)
        if not have:
            return empty(self.spark, name)
        parts = self._note(name, have[-1])["parts"]
        return migrate(name, self.spark.read.option("mergeSchema", len(parts) > 1).parquet(*[f"{self.root}/{name}/{p}" for p in parts]))

    def marks(self, name: str) -> dict[str, int]:
        """The last batch of each stream that the present version holds."""
        have = self.versions(name)
        return self._note(name, have[-1])["marks"] if have else {}

    def write(self, name: str, df: DataFrame, marks: dict[str, int] | None = None, append: bool = False) -> int:
        """A new version of ``df``, or with ``append`` of the rows before and ``df``. ``marks``: batches of streams that it holds besides those of the version before."""
        have = self.versions(name)
        version = (have[-1] if have else 0) + 1
        before = self._note(name, have[-1]) if have else {"parts": [], "marks": {}}
        claim = f"{self.root}/{name}/claim={version}"
        if self._path(claim)[1].exists(self._path(claim)[0]):
            raise ConflictError(f"version {version} of {name} is being written; recover() frees it if its writer was lost")
        try:
            self._put(claim, "", False)
        except Exception as error:
            raise ConflictError(f"version {version} of {name} is being written") from error
        try:
            parts = [*before["parts"], f"v={version}"] if append else [f"v={version}"]
            if len(parts) > MAX_PARTS:
                df, parts = self.read(name).unionByName(migrate(name, df)), [f"v={version}"]
            migrate(name, df).write.mode("overwrite").parquet(f"{self.root}/{name}/v={version}")
            self._put(f"{self.root}/{name}/version={version}.json", json.dumps({"parts": parts, "marks": {**before["marks"], **(marks or {})}}), True)
        finally:
            p, fs = self._path(claim)
            fs.delete(p, False)
        self._forget(name, [*have, version])
        return version

    def recover(self, name: str) -> None:
        """Frees numbers that lost writers claimed; not to be called while another writes."""
        for f in self._names(name):
            if f.startswith("claim="):
                p, fs = self._path(f"{self.root}/{name}/{f}")
                fs.delete(p, False)

    def _forget(self, name: str, have: list[int]) -> None:
        """Removes versions older than the kept ones, and the folders that no kept one lists."""
        old = have[: -self.keep] if self.keep else []
        if not old:
            return
        used = {p for v in have[len(old) :] for p in self._note(name, v)["parts"]}
        lost = {p for v in old for p in self._note(name, v)["parts"]} - used
        for place in [*[f"version={v}.json" for v in old], *sorted(lost)]:
            p, fs = self._path(f"{self.root}/{name}/{place}")
            fs.delete(p, True)

    def merge(self, name: str, delta: DataFrame, how: str = "replace", marks: dict[str, int] | None = None) -> int:
        """``how``: replace (upsert), ignore (insert where new: only the new rows are written) or patch (non-null values)."""
        keys = KEYS[name]
        if how == "ignore":
            fresh = memory.one_per_key(delta, keys, last=False).join(self.read(name).select(*keys), keys, "left_anti")
            return self.write(name, fresh, marks, append=True)
        act = {"replace": memory.upsert, "patch": memory.patch}[how]
        return self.write(name, act(self.read(name), delta, keys), marks)

    def delete(self, name: str, condition) -> int:
        return self.write(name, self.read(name).where(~F.coalesce(condition, F.lit(False))))

    def delete_node(self, node: str) -> None:
        """The node and its edges."""
        self.delete("edges", (F.col("from_id") == node) | (F.col("to_id") == node))
        self.delete("nodes", F.col("id") == node)


def export_json(tables: dict[str, DataFrame], path: str) -> None:
    """A folder of JSON lines for each table, with its schema's own types."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def import_json(spark: SparkSession, path: str, names: tuple[str, ...] = ("planets", "notes", "note_links", "planet_links")) -> dict[str, DataFrame]:
    return {n: migrate(n, spark.read.schema(TABLES[n]).json(f"{path}/{n}")) for n in names}


def find_projects(spark: SparkSession, *patterns: str) -> DataFrame:
    """(root, symbols, files) of the stores below the folders that fit the globs, by root; one that cannot be read has zeros."""
    jvm, found = spark._jvm, set()
    for pattern in patterns:
        p = jvm.org.apache.hadoop.fs.Path(f"{pattern.rstrip('/')}/code_symbols")
        for status in p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []:
            found.add(status.getPath().getParent().toString())
    rows = []
    for root in sorted(found):
        try:
            symbols = TableStore(spark, root).read("code_symbols")
            n = symbols.agg(F.count("*"), F.countDistinct("file_path")).first()
        except Exception:  # noqa: BLE001  a broken store must not hide the others
            n = (0, 0)
        rows.append((root, n[0], n[1]))
    return spark.createDataFrame(rows, "root string, symbols long, files long")
