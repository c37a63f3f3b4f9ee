"""The orphan state as the sink of a stream: every micro-batch advances the state kept in a folder.

The state is cut into buckets by key. A batch reads and writes only the buckets that its rows touch, so what
it writes follows the batch and not the history; a small manifest per batch (one row per bucket and kind)
names the version of each bucket. A batch that runs again after a failure starts from the manifest
before it and writes the same versions again; versions that neither of the last two manifests names are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.operators.orphans import DELIVERY, KEY, REF, OrphanState, advance

REF_SCHEMA = "src string, owner_key string, doc_id string, article_ref string, eid string, ref_time timestamp_ntz"
DELIVERY_SCHEMA = "doc_id string, eid string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
KEPT = {"refs": f"{REF_SCHEMA}, ref_state string, is_open boolean", "known": DELIVERY_SCHEMA}
#: Buckets of the state; a manifest has twice as many rows at most.
BUCKETS = 256


class OrphanSink:
    """foreachBatch function over rows kind (`ref` or `delivery`) + the columns of both."""

    def __init__(self, folder: str, buckets: int = BUCKETS):
        """`buckets` must stay the same for the life of a folder."""
        self.folder = folder
        self.buckets = buckets

    def bucket_of(self) -> Column:
        """A null part of a key is a value of its own, so every row has a bucket."""
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")

    def manifest(self, spark: SparkSession, batch: int) -> list[tuple[str, int, int]]:
        """(kind, bucket, version) after a batch; empty before the first."""
        if batch < 0:
            return []
        return sorted(tuple(r) for r in spark.read.parquet(f"{self.folder}/{batch}/manifest").select("kind", "bucket", "version").collect())

    def load(self, spark: SparkSession, batch: int, buckets: set[int] | None = None) -> OrphanState:
        """State after a batch, of all buckets or of those given."""
        named = self.manifest(spark, batch)

        def kept(kind: str) -> DataFrame:
            paths = [f"{self.folder}/{v}/{k}/bucket={b}" for k, b, v in named if k == kind and (buckets is None or b in buckets)]
            return spark.read.schema(KEPT[kind]).parquet(*paths) if paths else spark.createDataFrame([], KEPT[kind])

        return OrphanState(kept("known"), kept("refs"))

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        refs, came = rows.filter("kind = 'ref'").select(*REF).distinct(), rows.filter("kind = 'delivery'").select(*DELIVERY).distinct()
        touched = {r[0] for r in rows.select(self.bucket_of()).distinct().collect()}
        state = advance(self.load(spark, batch - 1, touched), refs, came)
        before = self.manifest(spark, batch - 1)
        now = {(kind, b): v for kind, b, v in before}
        for kind, part in (("refs", state.refs), ("known", state.known)):
            path = f"{self.folder}/{batch}/{kind}"
            part.withColumn("bucket", self.bucket_of()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
            written = spark.read.schema(f"{KEPT[kind]}, bucket int").parquet(path).select("bucket").distinct().collect()
            now |= {(kind, r[0]): batch for r in written}
        new = [(k, b, v) for (k, b), v in sorted(now.items())]
        spark.createDataFrame(new, "kind string, bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{batch}/manifest")
        # what the manifest before the last named and the last replaced
        self._delete(spark, set(self.manifest(spark, batch - 2)) - set(before))

    def _delete(self, spark: SparkSession, versions: set[tuple[str, int, int]]) -> None:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for kind, b, v in versions:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{v}/{kind}/bucket={b}")
            path.getFileSystem(conf).delete(path, True)


def start(events: DataFrame, folder: str, checkpoint: str):
    """Runs a stream of events into the sink until its input is used up."""
    return events.writeStream.foreachBatch(OrphanSink(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
