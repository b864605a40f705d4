"""A partitioned table whose rewrites are seen whole or not at all, and whose schema may change from write to write.

``write`` puts the rows of every partition it holds into files of its own (``data/commit=<id>/date=<d>``), reads them back
into a manifest, one row a partition with its number of rows, a digest and its schema, adds the partitions that it leaves
alone from the manifest before, and last creates ``commits/<n>.json``. Creating that file is the commit: it exists or not,
and it cannot be created twice. A write that fails before, an executor that is lost or a second attempt leaves files
that no manifest names. Readers take the newest commit and read the files it names with the schemas it names, so no
footer is opened to plan a read and a rewrite under a running reader changes nothing for it.

Manifests are Parquet tables and are joined, never collected; only the commit and the different schemas, few by nature,
reach the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import SYMBOL, TS, require_columns
from ..functions.ordered import durable

MANIFEST = "date string, commit string, n_rows long, digest long, schema string"


class CommitConflict(RuntimeError):
    """Another writer has committed a partition that this write replaces."""


class NoCommit(FileNotFoundError):
    """There is no committed state at this path."""


class Store:
    """The table at ``path``, partitioned by ``date`` (a string)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    # -------------------------------------------------------------- commits

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """Numbers of the commits, oldest first."""
        fs, path = self._fs("commits")
        if not fs.exists(path):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _commit(self, number: int, what: dict) -> None:
        fs, path = self._fs(f"commits/{number:08d}.json")
        text = bytearray(json.dumps(what).encode())
        fs.mkdirs(path.getParent())
        # written beside and renamed: a name that is taken is refused, and no half of a file is ever seen
        _, made = self._fs(f"commits/.{number:08d}-{uuid.uuid4().hex}")
        out = fs.create(made, False)
        try:
            out.write(text)
        finally:
            out.close()
        if fs.exists(path) or not fs.rename(made, path):
            fs.delete(made, False)
            raise CommitConflict(f"commit {number} of {self.path} was made by another writer")

    def commit(self, version: int | None = None) -> dict:
        """What a commit says; the newest by default."""
        found = self.versions()
        if not found or (version is not None and version not in found):
            raise NoCommit(f"{self.path} has no commit {'' if version is None else version}")
        number = found[-1] if version is None else version
        fs, path = self._fs(f"commits/{number:08d}.json")
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) | {"version": number}

    def manifest(self, version: int | None = None) -> DataFrame:
        """``date, commit, n_rows, digest, schema`` of every partition."""
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{self.commit(version)['manifest']}")

    # -------------------------------------------------------------- writing

    def write(self, df: DataFrame, *, files_per_date: int = 1, replace: bool = False) -> int:
        """Replace the partitions that ``df`` has rows of (all, if ``replace``); the number of the commit.

        Rows of a date are dealt by symbol over ``files_per_date`` tasks and sorted by stamp and symbol.
        """
        require_columns(df, ("date",), "write")
        if bad := {"commit", "_commit"} & set(df.columns):
            raise ValueError(f"a stored table may not have columns {sorted(bad)}")
        found = self.versions()
        base = found[-1] if found else None
        commit = uuid.uuid4().hex
        folder = f"{self.path}/data/commit={commit}"
        df = df.withColumn("date", F.col("date").cast("string"))
        sort = [c for c in (TS, SYMBOL) if c in df.columns]
        salt = F.pmod(F.xxhash64(SYMBOL), F.lit(files_per_date)) if SYMBOL in df.columns else F.lit(0)
        df.repartition("date", salt).sortWithinPartitions("date", *sort).write.option("compression", "zstd").partitionBy("date").parquet(folder)
        # without metadata: bounds that plans are made from hold for a frame, not for a table that is written to
        fields = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields if f.name != "date"])
        # one row a partition, read twice below: staged, as the files behind it would be read for each
        written = durable(self._measure(self._files(fields, commit), fields))
        state = written
        if base is not None and not replace:
            state = self.manifest(base).join(written.select("date"), "date", "left_anti").unionByName(written)
        name = f"{(base or 0) + 1:08d}-{commit}"
        state.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism)).write.parquet(f"{self.path}/manifests/{name}")
        self._commit((base or 0) + 1, {"manifest": name, "base": base, "commit": commit})
        return (base or 0) + 1

    def _files(self, fields: T.StructType, commit: str | None = None) -> DataFrame:
        """Rows with ``commit`` and ``date``, of one commit or of all."""
        schema = T.StructType([*fields.fields, T.StructField("commit", T.StringType()), T.StructField("date", T.StringType())])
        read = self.spark.read.option("basePath", f"{self.path}/data").schema(schema)
        return read.parquet(f"{self.path}/data" + (f"/commit={commit}" if commit else ""))

    @staticmethod
    def _measure(files: DataFrame, fields: T.StructType) -> DataFrame:
        row = F.xxhash64(*[F.col(f.name) for f in fields.fields]) if fields.fields else F.lit(0).cast("long")
        return files.groupBy("date", "commit").agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(row).alias("digest")).withColumn(
            "schema", F.lit(fields.json()))

    # -------------------------------------------------------------- reading

    def _schemas(self, manifest: DataFrame) -> list[T.StructType]:
        return [T.StructType.fromJson(json.loads(r["schema"])) for r in manifest.select("schema").distinct().orderBy("schema").collect()]

    def schema(self, version: int | None = None) -> T.StructType:
        """Every column with the type of its newest partition."""
        m = self.manifest(version)
        last = m.groupBy("schema").agg(F.max("date").alias("date")).orderBy("date", "schema").collect()
        out: dict[str, T.StructField] = {}
        for r in last:
            out |= {f.name: f for f in T.StructType.fromJson(json.loads(r["schema"])).fields}
        return T.StructType(list(out.values()))

    def read(self, fields: Sequence[str] | None = None, *, start: str | None = None, end: str | None = None,
             version: int | None = None) -> DataFrame:
        """The committed rows with ``date``; a column that a partition lacks is NULL, other types are cast to the newest."""
        m = self.manifest(version)
        whole = self.schema(version)
        names = list(fields) if fields is not None else whole.names
        if missing := set(names) - set(whole.names):
            raise KeyError(f"{sorted(missing)} are in no partition; there are {sorted(whole.names)}")
        day = F.col("date")
        m = m.where(day >= start) if start is not None else m
        m = m.where(day <= end) if end is not None else m
        parts = []
        for s in self._schemas(m):
            files = self._files(s)
            files = files.where(day >= start) if start is not None else files
            files = files.where(day <= end) if end is not None else files
            named = m.where(F.col("schema") == s.json()).select("date", "commit")
            cols = [(F.col(n) if n in s.names else F.lit(None)).cast(whole[n].dataType).alias(n) for n in names]
            parts.append(files.join(named, ["date", "commit"], "left_semi").select("date", *cols))
        if not parts:
            empty = T.StructType([T.StructField("date", T.StringType()), *[whole[n] for n in names]])
            return self.spark.createDataFrame([], empty)
        return reduce(DataFrame.unionAll, parts)

    def damaged(self, version: int | None = None) -> DataFrame:
        """Partitions whose files no longer hold what was committed: ``date``, rows then and rows now."""
        m = self.manifest(version)
        now = reduce(DataFrame.unionAll, [self._measure(
            self._files(s).join(m.where(F.col("schema") == s.json()).select("date", "commit"), ["date", "commit"], "left_semi"), s)
            for s in self._schemas(m)])
        now = now.select("date", "commit", F.col("n_rows").alias("now"), F.col("digest").alias("digest_now"))
        return m.join(now, ["date", "commit"], "left").where(~F.col("digest").eqNullSafe(F.col("digest_now")) | ~F.col("n_rows").eqNullSafe(F.col("now"))).select(
            "date", "n_rows", F.coalesce("now", F.lit(0)).alias("now"))

    def drift(self, version: int | None = None) -> DataFrame:
        """``date, column, change, before, after``: columns ``added``, ``removed`` or ``retyped`` against the date before."""
        m = self.manifest(version)
        kinds = {s.json(): [(f.name, f.dataType.simpleString()) for f in s.fields] for s in self._schemas(m)}
        table = self.spark.createDataFrame([(k, n, t) for k, v in kinds.items() for n, t in v], "schema string, column string, kind string")
        dates = m.select("date", "schema")
        # only where the schema changes can a column change: one row a date is ordered, not one a date and column
        steps = dates.withColumn("_all", F.lit(0)).withColumn("was", F.lag("schema").over(W.partitionBy("_all").orderBy("date")))
        steps = steps.where(F.col("was").isNotNull() & (F.col("was") != F.col("schema"))).select("date", "was", "schema")
        new = steps.join(F.broadcast(table), "schema").select("date", "column", F.col("kind").alias("after"))
        old = steps.join(F.broadcast(table.withColumnRenamed("schema", "was")), "was").select("date", "column", F.col("kind").alias("before"))
        both = old.join(new, ["date", "column"], "full").where(~F.col("before").eqNullSafe(F.col("after")))
        change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("retyped")
        return both.select("date", "column", change.alias("change"), "before", "after")
