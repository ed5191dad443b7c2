"""Realtime messages as a stream: the newest message of each entity, upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farandole.operators.disruptions import upserted
from farandole.scratch import scratch_path

#: Parts of the state.
PARTS = 64
STATE = "id long, ts timestamp_ntz, entity_id long, kind string, value double"
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def messages(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("entity_id"), F.col("event_type").alias("kind"), "value")


def upserted_newest(state: DataFrame, batch: DataFrame) -> DataFrame:
    """State and batch together, the newest message of each entity: late messages change nothing."""
    return upserted(state.limit(0), state.unionByName(batch))


class LatestState:
    """The table of newest messages in a folder, in parts by hash of the entity.

    A batch reads and writes the parts that its entities fall into, as files of its own epoch; a part's
    state is in the newest epoch that wrote it. A replayed batch starts from the epochs before it and
    writes the same again, so results don't change. Epochs that no part needs any more, and that no
    replay can need, are removed.
    """

    def __init__(self, spark: SparkSession, folder: str, parts: int = PARTS):
        self.spark, self.folder, self.parts = spark, folder, parts

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def newest(self, before: int | None = None) -> dict[int, int]:
        """The newest epoch (below `before`) of each part."""
        path, files = self._files()
        found: dict[int, int] = {}
        for told in files.listStatus(path) if files.exists(path) else []:
            name = told.getPath().getName()
            if name.startswith("epoch=") and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")):
                epoch = int(name[6:])
                for part in files.listStatus(told.getPath()):
                    if part.getPath().getName().startswith("part_=") and (before is None or epoch < before):
                        n = int(part.getPath().getName()[6:])
                        found[n] = max(found.get(n, -1), epoch)
        return found

    def _read(self, at: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/epoch={epoch}/part_={n}" for n, epoch in sorted(at.items())]
        return self.spark.read.schema(STATE).parquet(*paths) if paths else self.spark.createDataFrame([], STATE)

    def table(self) -> DataFrame:
        return self._read(self.newest())

    def apply(self, batch: DataFrame, epoch: int) -> None:
        part = F.pmod(F.xxhash64("entity_id"), F.lit(self.parts)).cast("int")
        touched = {r[0] for r in batch.select(part).distinct().collect()}  # at most `parts` numbers
        before = self.newest(epoch)
        state = self._read({n: e for n, e in before.items() if n in touched})
        rows = upserted_newest(state, batch.select(*state.columns)).withColumn("part_", part)
        rows.write.mode("overwrite").partitionBy("part_").parquet(f"{self.folder}/epoch={epoch}")
        self._prune(before, epoch)

    def _prune(self, before: dict[int, int], epoch: int) -> None:
        """Removes epochs that neither the state before this batch nor a replay of it needs."""
        path, files = self._files()
        needed = set(before.values()) | {epoch, epoch - 1}
        for told in files.listStatus(path):
            name = told.getPath().getName()
            if name.startswith("epoch=") and int(name[6:]) < epoch and int(name[6:]) not in needed:
                files.delete(told.getPath(), True)


def latest_by_stream(spark: SparkSession, path: str, folder: str | None = None, files_per_batch: int = 1) -> DataFrame:
    """Runs the stream over all messages that are there, and returns the state. With a folder of
    the caller's, state and checkpoint stay in it and a later run goes on from there."""
    folder = folder or scratch_path(spark, "stream")
    state = LatestState(spark, f"{folder}/state")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    run = messages(stream).writeStream.foreachBatch(state.apply).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return state.table()
