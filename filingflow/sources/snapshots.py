"""Copy-on-write snapshots of a keyed table (U3-U7): only the buckets that a change touches are written again.

A table is a folder. Rows lie in buckets by the hash of their key, every write puts its buckets into a data folder of its
own, and a manifest names the live folder of each bucket; it is written last, under a name that only one writer can take.
So readers see the state before or after a write, a write that dies leaves files that no manifest names, and of two
writers that started from the same version one fails and starts again. A manifest has one line for each bucket, whatever
the table's size, and the highest id given so far, so that new rows can be numbered without reading the table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has made the next version."""


class Folder:
    """Files of a folder through Spark's own file systems (any storage), on the driver: manifests and names only."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a file as a whole under a name that is free; False if it is taken."""
        part = self.path(f"_tmp-{uuid.uuid4().hex}")
        stream = self.fs.create(part, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        target = self.path(name)
        self.fs.mkdirs(target.getParent())
        done = not self.fs.exists(target) and self.fs.rename(part, target)
        if not done:
            self.fs.delete(part, False)
        return done

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class SnapshotTable:
    """A table of rows with the key column(s) ``key``; ``id_col`` is numbered across the whole table."""

    def __init__(self, spark: SparkSession, root: str, key: list[str], buckets: int = BUCKETS, id_col: str | None = "id"):
        self.spark, self.folder, self.key, self.buckets, self.id_col = spark, Folder(spark, root), key, buckets, id_col

    # ------------------------------------------------------------------ reading

    def manifest(self, version: int | None = None) -> dict | None:
        """The newest manifest, or that of a version; None if there is none."""
        found = [n for n in self.folder.names("manifests") if version is None or n == _name(version)]
        return json.loads(self.folder.read(f"manifests/{found[-1]}")) if found else None

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if m is None:
            raise ValueError("no such version")
        return self._rows(m, list(m["live"]))

    def _rows(self, m: dict, buckets: list[str]) -> DataFrame:
        schema = StructType.fromJson(m["schema"])
        paths = [f"{self.folder.root}/data/{m['live'][b]}/__bucket={b}" for b in buckets if b in m["live"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    # ------------------------------------------------------------------ writing

    def create(self, rows: DataFrame) -> int:
        """The first version."""
        return self._commit(None, rows, [str(b) for b in range(self.buckets)])

    def apply(self, changes: DataFrame, change: Callable[[DataFrame, DataFrame, int], DataFrame]) -> int:
        """The next version: ``change(state, changes, last_id)`` gets the rows of the buckets that hold a key of ``changes`` (which
        has the key's columns) and returns what stands for them; all other buckets stay as they are."""
        m = self.manifest()
        if m is None:
            raise ValueError("create the table first")
        touched = [str(r[0]) for r in changes.select(self._bucket()).distinct().collect()]  # at most one row for each bucket
        if not touched:
            return m["version"]
        return self._commit(m, change(self._rows(m, touched), changes, m["last_id"]), touched)

    def _commit(self, m: dict | None, rows: DataFrame, touched: list[str]) -> int:
        known = [f["name"] for f in m["schema"]["fields"]] if m else []
        rows = rows.select(*[c for c in known if c in rows.columns], *[c for c in rows.columns if c not in known])
        write = uuid.uuid4().hex[:16]
        path = f"{self.folder.root}/data/{write}"
        rows.withColumn("__bucket", self._bucket()).repartition("__bucket").write.partitionBy("__bucket").parquet(path)
        made = {n.split("=", 1)[1] for n in self.folder.names(f"data/{write}") if n.startswith("__bucket=")}
        if made - set(touched):
            raise ValueError("a change may not add keys that it does not name")
        live = {b: w for b, w in (m["live"] if m else {}).items() if b not in touched} | dict.fromkeys(sorted(made), write)
        last = m["last_id"] if m else 0
        if self.id_col and made:
            last = max(last, self.spark.read.parquet(path).agg(F.max(self.id_col)).first()[0] or 0)
        new = {"version": m["version"] + 1 if m else 0, "live": live, "last_id": last, "schema": rows.schema.jsonValue()}
        if not self.folder.create(f"manifests/{_name(new['version'])}", json.dumps(new)):
            raise Conflict(f"version {new['version']} exists")
        return new["version"]

    def vacuum(self, keep: int = 1) -> None:
        """Removes manifests but the newest ``keep``, and data that none of those names. No other writer may be at work."""
        names = self.folder.names("manifests")
        for n in names[:-keep]:
            self.folder.delete(f"manifests/{n}")
        kept = [json.loads(self.folder.read(f"manifests/{n}"))["live"] for n in names[-keep:]]
        live = {f"{w}/__bucket={b}" for m in kept for b, w in m.items()}
        for write in self.folder.names("data"):
            inside = [f"{write}/{n}" for n in self.folder.names(f"data/{write}")]
            if not live.intersection(inside):
                self.folder.delete(f"data/{write}")
            for bucket in inside:
                if "/__bucket=" in bucket and bucket not in live:
                    self.folder.delete(f"data/{bucket}")


def _name(version: int) -> str:
    return f"v{version:012d}.json"
