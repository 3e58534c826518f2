"""Tables that are written: ledgers whose versions are committed at once, merged by key and changed idempotently by streams.

A table is a folder of Parquet data, dealt to parts by its keys, and a log with a small JSON file a version that names the folder of each
part. A version comes to be when its log file is created, which only one writer can do; data that no log file names is never read.
So a failed write leaves the last version, a table can be read while it is rewritten, and a change rewrites only the parts its
keys fall in. The file system's rename must fail where the name is taken, as HDFS's does; on a local disk two writers in the same
millisecond could both succeed."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .operators.ledger import upsert
from .storage import keep

PART = "_part"


class Conflict(RuntimeError):
    """Another writer has committed the version this one was about to commit."""


@dataclass
class Version:
    number: int
    schema: StructType
    #: part -> {"folder", "columns"}: where its rows are and the columns that were written there
    parts: dict[str, dict] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)
    #: writer -> the last of its batches that is in
    applied: dict[str, int] = field(default_factory=dict)

    def dump(self) -> str:
        return json.dumps({"number": self.number, "schema": self.schema.jsonValue(), "parts": self.parts, "defaults": self.defaults, "applied": self.applied})

    @classmethod
    def load(cls, text: str) -> Version:
        d = json.loads(text)
        return cls(d["number"], StructType.fromJson(d["schema"]), d["parts"], d["defaults"], d["applied"])


class Store:
    """A table at `path`, its rows dealt to `n_parts` parts by hash of `keys`. A new table has no version; read() is then an error and
    merge() starts it. Rows with null keys go to parts like others; upserts never match them. Keep old versions for as long as
    batches may be given again (vacuum())."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], n_parts: int = 16):
        self.spark, self.path, self.keys, self.n_parts = spark, path.rstrip("/"), list(keys), n_parts
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    # --- log -----------------------------------------------------------------------------------------------------------------

    def _at(self, name: str):
        p = self._hadoop.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[int]:
        fs, p = self._at("_log")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))

    def version(self, number: int | None = None) -> Version | None:
        """The given version, or the last; None where there is none."""
        if number is None:
            all_of = self._versions()
            if not all_of:
                return None
            number = all_of[-1]
        fs, p = self._at(f"_log/{number:020d}.json")
        stream = fs.open(p)
        try:
            return Version.load(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, v: Version) -> None:
        """Writes the log file aside and renames it to its name, which fails if that is taken."""
        fs, done = self._at(f"_log/{v.number:020d}.json")
        _, aside = self._at(f"_log/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        try:
            out.write(bytearray(v.dump().encode()))
        finally:
            out.close()
        if fs.exists(done) or not fs.rename(aside, done):
            fs.delete(aside, False)
            raise Conflict(f"version {v.number} of {self.path} is there already")

    # --- rows ----------------------------------------------------------------------------------------------------------------

    def _part(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n_parts)).cast("string")

    def _rows(self, v: Version, parts: Sequence[str] | None = None) -> DataFrame:
        """Rows of a version, of the given parts only; columns that came after a part was written have their defaults there."""
        chosen = [x for k, x in v.parts.items() if parts is None or k in parts]
        out = self.spark.createDataFrame([], v.schema)
        by_columns: dict[tuple, list[str]] = {}
        for x in chosen:
            by_columns.setdefault(tuple(x["columns"]), []).append(f"{self.path}/{x['folder']}")
        for columns, folders in by_columns.items():
            rows = self.spark.read.schema(StructType([v.schema[c] for c in columns])).parquet(*folders)
            later = {f.name: F.lit(v.defaults.get(f.name)).cast(f.dataType) for f in v.schema if f.name not in columns}
            out = out.unionByName(rows.withColumns(later))
        return out

    def read(self, number: int | None = None) -> DataFrame:
        v = self.version(number)
        if v is None:
            raise FileNotFoundError(f"no table at {self.path}")
        return self._rows(v)

    def read_before(self, writer: str, batch: int, empty: StructType | str) -> DataFrame:
        """The table as it was before a writer's batch, whether that is in or not; where there was none an empty one. A batch
        that is run again sees what it saw the first time."""
        for n in reversed(self._versions()):
            v = self.version(n)
            if v.applied.get(writer, -1) < batch:
                return self._rows(v)
        return self.spark.createDataFrame([], empty)

    def replace(self, rows: DataFrame, writer: str = "", batch: int | None = None) -> bool:
        """All rows anew."""
        return self._change(lambda _: (rows, None, rows.schema), writer, batch)

    def merge(self, changes: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None, writer: str = "", batch: int | None = None) -> bool:
        """Rows of the parts that the changes' keys fall in become combine(old rows, changes); by default upsert() by key, which
        lets nulls keep what is known. Columns that the table lacks are added (old rows have nulls). False if the batch is in already.

        changes are written once before, so a combination may read them often."""
        combine = combine or (lambda old, new: upsert(old, new, self.keys))

        def change(v: Version | None):
            new = keep(changes, "merge")
            touched = [r[0] for r in new.select(self._part()).distinct().collect()]  # n_parts at most
            schema = v.schema if v else new.schema
            schema = StructType([*schema, *[f for f in new.schema if f.name not in schema.names]])
            old = self._rows(v, touched) if v else self.spark.createDataFrame([], new.schema)
            old = old.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in old.columns})
            return combine(old, new).select(*schema.names), touched, schema

        return self._change(change, writer, batch)

    def append(self, rows: DataFrame, writer: str = "", batch: int | None = None) -> bool:
        return self.merge(rows, lambda old, new: old.unionByName(new, allowMissingColumns=True), writer, batch)

    def add_columns(self, columns: Mapping[str, tuple[str, object]]) -> None:
        """Additive migration: name -> (type, default). Columns that are there stay as they are; no data is rewritten."""
        v = self.version()
        new = {c: x for c, x in columns.items() if c not in v.schema.names}
        if new:
            schema = v.schema
            for c, (kind, _) in new.items():
                schema = StructType([*schema, *StructType.fromDDL(f"{c} {kind}")])
            self._commit(Version(v.number + 1, schema, v.parts, v.defaults | {c: d for c, (_, d) in new.items()}, v.applied))

    def _change(self, make, writer: str, batch: int | None) -> bool:
        v = self.version()
        if v and batch is not None and v.applied.get(writer, -1) >= batch:
            return False
        rows, touched, schema = make(v)
        folder = f"data-{uuid.uuid4().hex}"
        # as many tasks as cores write, so a part is a few files and no single task's work
        tasks = max(1, -(-self.spark.sparkContext.defaultParallelism // self.n_parts))
        dealt = rows.withColumn(PART, self._part())
        dealt = dealt.repartition(self.n_parts * tasks, PART, F.pmod(F.hash(*self.keys), F.lit(tasks)))
        dealt.write.partitionBy(PART).parquet(f"{self.path}/{folder}")
        fs, p = self._at(folder)
        written = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
        parts = {} if touched is None or v is None else {k: x for k, x in v.parts.items() if k not in touched}
        parts |= {name.partition("=")[2]: {"folder": f"{folder}/{name}", "columns": schema.names} for name in written}
        applied = dict(v.applied) if v else {}
        if batch is not None:
            applied[writer] = batch
        self._commit(Version(v.number + 1 if v else 0, schema, parts, v.defaults if v else {}, applied))
        return True

    def vacuum(self, keep_versions: int = 2) -> None:
        """Deletes log files but the last few, and data that none of those names. Not while another writer is at work."""
        gone, stay = (x := self._versions())[:-keep_versions], x[-keep_versions:]
        used = {p["folder"].partition("/")[0] for n in stay for p in self.version(n).parts.values()}
        fs, top = self._at("")
        for s in fs.listStatus(top):
            name = s.getPath().getName()
            if name.startswith("data-") and name not in used:
                fs.delete(s.getPath(), True)
        for n in gone:
            fs.delete(self._at(f"_log/{n:020d}.json")[1], False)


def sink(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs apply(rows, batch id) for each batch of what is there now. A batch that failed is given again under its id."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
