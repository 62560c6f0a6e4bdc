"""A keyed vector store as Parquet tables: append, newest row wins, tombstones, compaction, recovery.

Writes are appended as versions and never rewrite what is there, so a batch is atomic and a failed one leaves nothing
visible.  Reads take the newest version of each id with one aggregation.  ``compact`` writes that state as a new
generation ``g<n>`` and publishes it with one marker file ``current-<n>``; every read and write looks for the newest
marker on the path, so all handles see the same generation, and one that is not complete is never seen."""

from __future__ import annotations

import struct
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quernel.functions.vectors import has_dim

SCHEMA = "vec_id long, embedding array<float>, seq long, place long, deleted boolean, batch string"


class StoreClosed(RuntimeError):
    """The store was closed."""


@dataclass(frozen=True)
class StoreConfig:
    """``compression`` is Parquet's: none, lz4, zstd or snappy; ``files`` are written by a compaction."""

    compression: str = "lz4"
    files: int = 256

    @classmethod
    def durable(cls) -> StoreConfig:
        return cls("zstd")

    @classmethod
    def fast(cls) -> StoreConfig:
        return cls("none", 512)


def newest(rows: DataFrame, id_col: str = "vec_id", seq: str | Column = "seq") -> DataFrame:
    """One row an id: that of the highest ``seq`` (a null is the least).  A partial aggregate runs before the shuffle."""
    others = [c for c in rows.columns if c != id_col]
    order = F.col(seq) if isinstance(seq, str) else seq
    return rows.groupBy(id_col).agg(F.max_by(F.struct(*others), F.struct(order.isNotNull(), order)).alias("_r")).select(id_col, *(F.col("_r")[c].alias(c) for c in others))


def contained(rows: DataFrame, wanted: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """``(id_col, there)`` of each wanted id: whether ``rows`` has it."""
    return wanted.select(id_col).distinct().join(rows.select(id_col).distinct().withColumn("_hit", F.lit(True)), id_col, "left").select(id_col, F.coalesce("_hit", F.lit(False)).alias("there"))


def looked_up(rows: DataFrame, wanted: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """The rows whose id is wanted."""
    return rows.join(wanted.select(id_col).distinct(), id_col, "left_semi")


def recovered(rows: DataFrame, dim: int, vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The rows that can be used at startup, and the quarantined others."""
    ok = has_dim(vec_col, dim)
    return rows.where(ok), rows.where(~ok)


def summary(rows: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """One row ``(vectors, dim)``: how many vectors there are and how long the shortest is."""
    return rows.agg(F.count("*").alias("vectors"), F.min(F.size(vec_col)).alias("dim"))


def upsert(base: DataFrame, change: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """``base`` with the rows of ``change`` in place of those with their ids."""
    return base.join(change.select(id_col).distinct(), id_col, "left_anti").select(*change.columns).unionByName(change)


def without(base: DataFrame, ids: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """``base`` without the rows whose id is in ``ids``."""
    return base.join(ids.select(id_col).distinct(), id_col, "left_anti")


def encode_key(key: int) -> bytes:
    """Eight bytes, big-endian, so that keys sort as numbers."""
    return struct.pack(">Q", key)


def decode_key(raw: bytes) -> int:
    if len(raw) != 8:
        raise ValueError("a key has eight bytes")
    return struct.unpack(">Q", raw)[0]


def encode_value(v) -> bytes:
    """Little-endian 32-bit floats."""
    return struct.pack(f"<{len(v)}f", *v)


def decode_value(raw: bytes) -> list[float]:
    if len(raw) % 4:
        raise ValueError("a value has four bytes a number")
    return list(struct.unpack(f"<{len(raw) // 4}f", raw))


class VectorStore:
    """The store at a path."""

    def __init__(self, spark: SparkSession, path: str, config: StoreConfig = StoreConfig()):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config
        self.reads = self.writes = self.deletes = 0
        self._closed = False

    def clone(self) -> VectorStore:
        """Another handle on the path, with the counts so far."""
        other = VectorStore(self.spark, self.path, self.config)
        other.reads, other.writes, other.deletes = self.reads, self.writes, self.deletes
        return other

    def _open(self) -> None:
        if self._closed:
            raise StoreClosed(self.path)

    def _fs(self, path: str):
        jvm = self.spark._jvm  # noqa: SLF001
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p  # noqa: SLF001

    def _files(self, path: str) -> list[tuple[str, int]]:
        """Names and sizes of what lies in a folder; none if there is no such folder."""
        fs, p = self._fs(path)
        return [(x.getPath().getName(), x.getLen()) for x in fs.listStatus(p)] if fs.exists(p) else []

    def generation(self) -> int:
        """The newest that was published; 0 before the first compaction."""
        return max((int(n[8:]) for n, _ in self._files(self.path) if n.startswith("current-")), default=0)

    def _raw(self, generation: int | None = None) -> DataFrame:
        """All versions.  Only a folder that is not there reads as empty; every other failure is raised."""
        folder = f"{self.path}/g{self.generation() if generation is None else generation}"
        if not any(n.endswith(".parquet") for n, _ in self._files(folder)):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(folder)

    @staticmethod
    def _newest(raw: DataFrame) -> DataFrame:
        return newest(raw, seq=F.struct("seq", "place")).where(~F.col("deleted"))

    def rows(self) -> DataFrame:
        """``(vec_id, embedding)`` of all live rows."""
        self._open()
        return self._newest(self._raw()).select("vec_id", "embedding")

    def ordered(self) -> DataFrame:
        return self.rows().orderBy("vec_id")

    def _append(self, df: DataFrame, generation: int | None = None) -> None:
        g = self.generation() if generation is None else generation
        df.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"), "seq", "place", "deleted", "batch").write.mode("append").option("compression", self.config.compression).parquet(f"{self.path}/g{g}")

    def _next(self) -> int:
        """A number above all that were written, and, for writers at the same time, above any clock reading before."""
        last = self._raw().agg(F.max("seq").alias("m")).first().m or 0
        return max(last + 1, time.time_ns() // 1000)

    def put_batch(self, df: DataFrame, order_col: str | None = None, batch: str | None = None) -> int:
        """Write ``(vec_id, embedding)`` as one batch; of rows with one id the last by ``order_col`` is kept, a null
        order being before all others, and rows without an id are left out.  A ``batch`` that was written before is not
        written again, so what is replayed does not undo later writes.  Returns the rows taken from ``df``."""
        self._open()
        if batch is not None and not self._raw().where(F.col("batch") == batch).isEmpty():
            return 0
        place = F.col(order_col).cast("long") if order_col else F.monotonically_increasing_id()
        seen = Observation()
        rows = df.select("vec_id", "embedding", F.lit(self._next()).alias("seq"), place.alias("place"), F.lit(False).alias("deleted"), F.lit(batch).cast("string").alias("batch")).where("vec_id is not null")
        self._append(newest(rows.observe(seen, F.count(F.lit(1)).alias("n")), seq="place"))
        self.writes += seen.get["n"]
        return seen.get["n"]

    def put(self, vec_id: int, embedding: list[float]) -> None:
        self.put_batch(self.spark.createDataFrame([(vec_id, embedding)], "vec_id long, embedding array<float>"))

    def get(self, vec_id: int) -> list[float] | None:
        """The vector of an id; the filter reaches the files' statistics.  Counts a read even if there is none."""
        self._open()
        self.reads += 1
        r = self._newest(self._raw().where(F.col("vec_id") == vec_id)).first()
        return r.embedding if r else None

    def contains(self, vec_id: int) -> bool:
        self._open()
        return not self._newest(self._raw().where(F.col("vec_id") == vec_id)).isEmpty()

    def delete(self, vec_id: int) -> bool:
        """Whether the id was there."""
        there = self.contains(vec_id)
        if there:
            self._append(self.spark.createDataFrame([(vec_id, None, self._next(), 0, True, None)], SCHEMA))
            self.deletes += 1
        return there

    def delete_batch(self, ids: DataFrame) -> None:
        """Delete all of ``(vec_id)``; those that are not there leave a tombstone that does no harm."""
        self._open()
        self._append(ids.select("vec_id", F.lit(None).alias("embedding"), F.lit(self._next()).alias("seq"), F.lit(0).cast("long").alias("place"), F.lit(True).alias("deleted"), F.lit(None).cast("string").alias("batch")).where("vec_id is not null").distinct())

    def clear(self) -> None:
        """Delete everything."""
        self.delete_batch(self.rows().select("vec_id"))

    def count(self) -> int:
        return self.rows().count()

    def is_empty(self) -> bool:
        return self.rows().isEmpty()

    def flush(self) -> None:
        """Every write is complete when it returns: there is nothing to do."""
        self._open()

    def disk_size(self) -> int:
        """Bytes of the files of the newest generation."""
        return sum(n for _, n in self._files(f"{self.path}/g{self.generation()}"))

    def compact(self) -> None:
        """Rewrite the live rows as a new generation and publish it.  Readers of the old one are not disturbed.  What
        other handles appended to the old one meanwhile is carried over; only one compaction may run at a time."""
        self._open()
        old = self.generation()
        new, before = old + 1, {n for n, _ in self._files(f"{self.path}/g{old}")}
        fs, target = self._fs(f"{self.path}/g{new}")
        fs.delete(target, True)  # of a compaction that failed
        parts = max(1, min(self.config.files, self.disk_size() // (128 << 20)))
        raw = self._raw(old)
        # batches stay known by a tombstone without id
        known = raw.where("batch is not null").groupBy("batch").agg(F.max("seq").alias("seq")).select(F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<float>").alias("embedding"), "seq", F.lit(0).cast("long").alias("place"), F.lit(True).alias("deleted"), "batch")
        live = self._newest(raw.where("vec_id is not null")).select("vec_id", "embedding", "seq", "place", "deleted", "batch")
        self._append(live.repartition(parts, "vec_id").sortWithinPartitions("vec_id").unionByName(known), new)
        fs, marker = self._fs(f"{self.path}/current-{new}")
        fs.create(marker, False).close()
        late = [f"{self.path}/g{old}/{n}" for n, _ in self._files(f"{self.path}/g{old}") if n.endswith(".parquet") and n not in before]
        if late:
            self._append(self.spark.read.schema(SCHEMA).parquet(*late), new)

    def recover(self, dim: int) -> tuple[DataFrame, DataFrame]:
        """The live rows of the dimension, and the quarantined others."""
        return recovered(self.rows(), dim)

    def stats(self) -> dict:
        return {"vectors": self.count(), "reads": self.reads, "writes": self.writes, "deletes": self.deletes, "bytes": self.disk_size()}

    def close(self) -> None:
        self._closed = True


class MetadataTable:
    """A table with an ``id`` at a path, inserted or replaced by id: versions are appended, the newest counts."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), f"{schema}, seq long, deleted boolean"
        self.columns = [c.split()[0] for c in schema.split(", ")]

    def _raw(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)  # noqa: SLF001
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):  # noqa: SLF001
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def rows(self) -> DataFrame:
        return newest(self._raw(), "id").where(~F.col("deleted")).select(*self.columns)

    def write(self, df: DataFrame) -> None:
        """Insert or replace; of rows with one id any is taken."""
        df.select(*self.columns).where("id is not null").dropDuplicates(["id"]).withColumn("seq", F.lit(time.time_ns())).withColumn("deleted", F.lit(False)).write.mode("append").parquet(self.path)

    def delete(self, ids: DataFrame) -> None:
        """Delete the ids of ``(id)``."""
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (x.split()[:2] for x in self.schema.split(", ")) if c in self.columns and c != "id"]
        ids.select("id", *nothing, F.lit(time.time_ns()).alias("seq"), F.lit(True).alias("deleted")).distinct().write.mode("append").parquet(self.path)


# ---- files --------------------------------------------------------------------------------------------------------


def read_embedding_json(spark: SparkSession, path: str) -> DataFrame:
    """``(id, source, text, vector)`` of a file ``{model, dimension, count, embeddings: [...]}``."""
    e = "array<struct<id: long, source: string, text: string, vector: array<float>>>"
    return spark.read.schema(f"model string, dimension int, count int, embeddings {e}").json(path, multiLine=True).select(F.explode("embeddings").alias("e")).select("e.*")


def read_positional_json(spark: SparkSession, path: str, vectors: str = "embeddings", texts: str = "chunks") -> DataFrame:
    """``(id, vector, text)`` of a file with two parallel arrays; the position is the id."""
    df = spark.read.schema(f"{vectors} array<array<float>>, {texts} array<string>").json(path, multiLine=True)
    return df.select(F.posexplode(F.arrays_zip(F.col(vectors).alias("vector"), F.col(texts).alias("text"))).alias("id", "r")).select("id", "r.vector", "r.text")


def read_texts(spark: SparkSession, path: str, recursive: bool = False, suffixes: tuple[str, ...] = ("txt", "md", "json", "csv")) -> DataFrame:
    """``(path, content)`` of whole text files; empty ones are left out."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}")
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")).where(F.length(F.trim("content")) > 0)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_metadata(base: DataFrame, change: DataFrame, id_col: str = "id", order_col: str | None = None) -> DataFrame:
    """A metadata table with ``change`` inserted or put in place of the rows of its ids; of rows of one id in
    ``change`` the last by ``order_col`` counts (without one any, as they are taken for repetitions)."""
    last = newest(change, id_col, order_col or F.lit(0)) if order_col else change.dropDuplicates([id_col])
    return upsert(base, last.select(*base.columns), id_col)
