"""Incremental import of workout files into stored ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest
from ..store import Store

ACTIVITY_KEYS = ["start_time", "sport_type"]
_STARTS = "start_time timestamp_ntz, sport_type string"


def read_files(spark: SparkSession, folder: str, files_per_batch: int = 1000, name: str = r"([^/]+)$") -> DataFrame:
    """New files below a folder as a stream of (path, kind, content); `name` picks a file's name from its full path."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    path = F.regexp_extract("path", name, 1)
    return raw.select(path.alias("path"), F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1)).alias("kind"), F.decode("content", "UTF-8").alias("content"))


class Importer:
    """Stores of one import: activities, their samples, and what became of each file.

    A batch is worked out against the activities as they were before it, whether it is new or given again after a failure, and each
    store takes it once; so however often a run breaks off between the three writes, they end up as if it had not. A file whose
    start and sport are stored is a duplicate, in the batch it came with or any later one. Bad files are rows of `results` with their reason,
    never a failed batch."""

    def __init__(self, spark: SparkSession, folder: str, writer: str = "files", n_parts: int = 16, **profile):
        self.writer, self.profile = writer, profile
        self.activities = Store(spark, f"{folder}/activities", ACTIVITY_KEYS, n_parts)
        self.samples = Store(spark, f"{folder}/samples", ["activity_id"], n_parts)
        self.results = Store(spark, f"{folder}/results", ["path"], n_parts)

    def apply(self, files: DataFrame, batch: int) -> None:
        stores = (self.samples, self.results, self.activities)
        if all((v := s.version()) and v.applied.get(self.writer, -1) >= batch for s in stores):
            return
        before = self.activities.read_before(self.writer, batch, _STARTS)
        acts, samples, results = ingest.ingest(files, before, **self.profile)
        self.samples.append(samples, self.writer, batch)
        # of a file that came before under this path the newest result counts
        self.results.merge(results.withColumn("batch", F.lit(batch).cast("long")), _newest, self.writer, batch)
        self.activities.append(acts, self.writer, batch)

    def run(self, files: DataFrame, checkpoint: str) -> None:
        """Imports all that is there now; the checkpoint remembers files that are in."""
        q = files.writeStream.foreachBatch(lambda rows, batch: self.apply(rows, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()


def _newest(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("path").distinct(), "path", "left_anti").unionByName(new)
