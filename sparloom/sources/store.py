"""A keyed store of Parquet buckets: upserts rewrite the touched buckets only.

    root/data/version=N/bucket=K/    rows of one bucket, as of version N
    root/manifest/version=N/         bucket, folder: the live folders after version N

An upsert deals its rows to buckets by key, reads the live folders of these buckets,
keeps each key's last row and writes them under the new version; all other buckets
keep their files.  The manifest is written last, and readers take the greatest one
that was written to its end, so an upsert that fails leaves nothing that is read, and
is done again under the same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import ready

LIVE = "bucket int, folder string"


class KeyedStore:
    """Rows of one schema, one a key; of several the one of the greatest `order`, of equal ones the later upsert's."""

    def __init__(self, spark: SparkSession, root: str, key: str, order: str, buckets: int = 64) -> None:
        self.spark, self.root, self.key, self.order, self.buckets = spark, root.rstrip("/"), key, order, buckets

    def _folders(self, path: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        system = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in system.listStatus(at)] if system.exists(at) else []

    def version(self) -> int:
        """The last version that was written to its end; -1 without any."""
        found = [int(n.removeprefix("version=")) for n in self._folders(f"{self.root}/manifest") if n.startswith("version=")]
        return max((v for v in found if ready(self.spark, f"{self.root}/manifest/version={v}")), default=-1)

    def live(self, version: int | None = None) -> dict[int, str]:
        """The live folder of each bucket that has rows; at most one row a bucket reaches the driver."""
        at = self.version() if version is None else version
        if at < 0:
            return {}
        return {b: f for b, f in self.spark.read.schema(LIVE).parquet(f"{self.root}/manifest/version={at}").collect()}

    def read(self, schema, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows as of a version (the last one); only: of these buckets."""
        folders = [f for b, f in sorted(self.live(version).items()) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def upsert(self, rows: DataFrame) -> int:
        """Adds rows or replaces those of their keys; the new version.  Rows without key are one key.

        Equal keys are brought down to one row before they are shuffled, so a key may
        hold any share of the rows.
        """
        version, schema = self.version() + 1, rows.schema
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        touched = {r[0] for r in rows.select(bucket.alias("b")).distinct().collect()}  # buckets
        if not touched:
            return version - 1
        stored = self.read(schema, version - 1, touched).withColumn("_late", F.lit(0))
        both = stored.unionByName(rows.withColumn("_late", F.lit(1)))
        cells = F.struct(*[F.col(c) for c in schema.names if c != self.key])
        last = both.groupBy(self.key).agg(F.max_by(cells, F.struct(self.order, "_late")).alias("_r")).select(self.key, "_r.*")
        data = f"{self.root}/data/version={version}"
        last.select(*schema.names, bucket.alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
        live = self.live(version - 1) | {b: f"{data}/bucket={b}" for b in touched}
        made = self.spark.createDataFrame(sorted(live.items()), LIVE)
        made.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/version={version}")
        return version

    def vacuum(self) -> list[str]:
        """Deletes bucket folders that the last version does not read, and older manifests; their names."""
        last, kept, gone = self.version(), set(self.live().values()), []
        path, conf = self.spark._jvm.org.apache.hadoop.fs.Path, self.spark._jsc.hadoopConfiguration()
        for folder in self._folders(f"{self.root}/data"):
            if int(folder.removeprefix("version=")) <= last:  # a later one is being written
                for name in self._folders(f"{self.root}/data/{folder}"):
                    at = f"{self.root}/data/{folder}/{name}"
                    if name.startswith("bucket=") and at not in kept:
                        path(at).getFileSystem(conf).delete(path(at), True)
                        gone.append(at)
        for name in self._folders(f"{self.root}/manifest"):
            if int(name.removeprefix("version=")) < last:
                path(f"{self.root}/manifest/{name}").getFileSystem(conf).delete(path(f"{self.root}/manifest/{name}"), True)
        return gone
