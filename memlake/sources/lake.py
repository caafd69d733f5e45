"""Tables published together: readers see a batch only through its manifest."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memlake.operators.maintain import table_fingerprint


class Lake:
    """A folder of immutable table batches and numbered manifests.

    A commit writes every table under a new batch folder, runs the given check on what
    was written, and only then creates the next manifest file. Creating that file fails
    if another writer was first, so a batch is visible as a whole or not at all.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        if not found:
            return {"version": 0, "tables": {}, "fingerprints": {}, "verified": False}
        number = found[-1] if version is None else version
        stream = self._fs.open(self._path(f"{self.root}/manifests/{number:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None) -> DataFrame:
        where = self.manifest(version)["tables"].get(table)
        if where is None:
            raise KeyError(f"no table {table} in the lake")
        return self.spark.read.parquet(where)

    def commit(
        self, tables: dict[str, DataFrame], check: Callable[[dict[str, DataFrame]], DataFrame] | None = None,
        partition_by: dict[str, list[str]] | None = None,
    ) -> int:
        """Publish new versions of some tables; the others stay as they are.

        ``check`` gets the written tables and returns violations; any row stops the commit.
        """
        before = self.manifest()
        version = before["version"] + 1
        batch = f"{self.root}/batches/{version:012d}-{self.spark._jvm.java.util.UUID.randomUUID().toString()}"
        written = {}
        for name, df in tables.items():
            writer = df.write.mode("errorifexists")
            if partition_by and name in partition_by:
                writer = writer.partitionBy(*partition_by[name])
            writer.parquet(f"{batch}/{name}")
            written[name] = self.spark.read.schema(df.schema).parquet(f"{batch}/{name}")
        if check is not None:
            found = check(written).limit(1).collect()
            if found:
                raise ValueError(f"batch refused: {found[0].asDict()}")
        marks = {n: table_fingerprint(df).first().asDict() for n, df in written.items()}
        body = {
            "version": version,
            "tables": {**before["tables"], **{n: f"{batch}/{n}" for n in tables}},
            "fingerprints": {**before["fingerprints"], **marks},
            "verified": check is not None,
        }
        out = self._fs.create(self._path(f"{self.root}/manifests/{version:012d}.json"), False)
        try:
            out.write(bytearray(json.dumps(body).encode()))
        finally:
            out.close()
        return version

    def verify(self, table: str, version: int | None = None) -> bool:
        """The files still hold what the manifest recorded."""
        return table_fingerprint(self.read(table, version)).first().asDict() == self.manifest(version)["fingerprints"][table]
