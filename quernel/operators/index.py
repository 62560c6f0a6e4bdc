"""Indexes that are built once, kept in files and changed: one contract, four kinds.

An index keeps its rows below a folder of its own as append-only tables (``_Log``): a batch is one write, a removed or
replaced id is a row in the small table of the dead until ``compact``.  Searches read the files, pruned to the
partitions they probe; nothing is trained or built again for a query."""

from __future__ import annotations

import time
import uuid
from abc import ABC, abstractmethod
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators import search
from quernel.plans.lineage import own_folder


class _Log:
    """Rows with an id in a folder, appended under rising numbers; the newest of an id counts, unless it is dead."""

    def __init__(self, spark: SparkSession, schema: str, by: str | None = None):
        self.spark, self.schema, self.by, self.path = spark, f"{schema}, seq long", by, own_folder(spark)
        self.batches = self.kills = 0

    def _number(self) -> int:
        return time.time_ns()

    def add(self, df: DataFrame, replace: bool = True) -> None:
        """Append rows; where an id is there already, its older rows are dead (``replace`` says that one may be)."""
        seq = self._number()
        if replace and self.batches:
            self._kill(df.select("vec_id"), seq)
        writer = df.withColumn("seq", F.lit(seq)).write.mode("append")
        (writer.partitionBy(self.by) if self.by else writer).parquet(f"{self.path}/rows")
        self.batches += 1

    def _kill(self, ids: DataFrame, seq: int) -> None:
        ids.select("vec_id", F.lit(seq).alias("until")).distinct().write.mode("append").parquet(f"{self.path}/dead")
        self.kills += 1

    def remove(self, ids: DataFrame) -> None:
        self._kill(ids, self._number())

    def live(self) -> DataFrame:
        """The rows that count.  A filter on the partition column reaches the files."""
        if not self.batches:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        if not self.kills:
            return rows
        dead = self.spark.read.schema("vec_id long, until long").parquet(f"{self.path}/dead").groupBy("vec_id").agg(F.max("until").alias("until"))
        return rows.join(dead, "vec_id", "left").where(F.col("until").isNull() | (F.col("seq") >= F.col("until"))).drop("until")


class VectorIndex(ABC):
    """What every index does.  Tables have ``vec_id`` and ``embedding``; ids are upserted."""

    def __init__(self, spark: SparkSession, dim: int, metric: str = search.COSINE):
        self.spark, self.dim, self.metric = spark, dim, metric
        self._rows = _Log(spark, "vec_id long, embedding array<float>")

    def _good(self, df: DataFrame) -> DataFrame:
        """One row an id; a vector of another length raises."""
        good, bad = search.reject_wrong(df, self.dim)
        if not bad.isEmpty():
            raise search.DimensionMismatch(f"vectors must have {self.dim} values")
        return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).dropDuplicates(["vec_id"])

    def insert(self, df: DataFrame) -> None:
        self._rows.add(self._good(df))

    def remove(self, ids: DataFrame) -> None:
        """Remove the ids of ``(vec_id)``; those that are not there change nothing."""
        self._rows.remove(ids)

    def rows(self) -> DataFrame:
        return self._rows.live().select("vec_id", "embedding")

    def get(self, vec_id: int) -> list[float] | None:
        r = self.rows().where(F.col("vec_id") == vec_id).first()
        return r.embedding if r else None

    def __len__(self) -> int:
        return self.rows().count()

    def is_empty(self) -> bool:
        return self.rows().isEmpty()

    @abstractmethod
    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """``(query_id, rank, vec_id, score)``: about the k nearest of each query."""


class FlatIndex(VectorIndex):
    """The exact search."""

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return search.knn(queries, self.rows(), k, self.metric, self.dim)


@dataclass(frozen=True)
class IvfConfig:
    dim: int = 1536
    partitions: int = 256
    nprobe: int = 16
    rounds: int = 20
    metric: str = search.COSINE

    @classmethod
    def of(cls, dim: int, partitions: int) -> IvfConfig:
        return cls(dim, partitions, max(partitions // 16, 1))


class IvfIndex(VectorIndex):
    """Inverted lists: postings in files by partition.  Until ``train`` the search is exact."""

    def __init__(self, spark: SparkSession, config: IvfConfig):
        super().__init__(spark, config.dim, config.metric)
        self.config, self.nprobe, self.centroids = config, min(config.nprobe, config.partitions), None
        self._postings = _Log(spark, "vec_id long, v array<float>, part int", "part")

    @property
    def is_trained(self) -> bool:
        return self.centroids is not None

    @property
    def num_partitions(self) -> int:
        return len(self.centroids) if self.is_trained else 0

    def set_nprobe(self, n: int) -> None:
        self.nprobe = max(1, min(n, self.config.partitions))

    def train(self) -> None:
        self.centroids = search.kmeans(self.rows(), self.config.partitions, self.config.rounds, self.metric)
        self._postings = _Log(self.spark, "vec_id long, v array<float>, part int", "part")
        self._post(self.rows())

    def _post(self, df: DataFrame) -> None:
        self._postings.add(search.assigned(df, self.centroids, self.metric).repartition("part").select("vec_id", "v", "part"))

    def insert(self, df: DataFrame) -> None:
        good = self._good(df)
        self._rows.add(good)
        if self.is_trained:
            self._post(good)

    def remove(self, ids: DataFrame) -> None:
        super().remove(ids)
        if self.is_trained:
            self._postings.remove(ids)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        if not self.is_trained:
            return search.knn(queries, self.rows(), k, self.metric, self.dim)
        return search.ivf_search(queries, self._postings.live(), self.centroids, k, self.nprobe, self.metric)


@dataclass(frozen=True)
class PqConfig:
    dim: int = 1536
    subspaces: int = 96
    clusters: int = 256
    rounds: int = 25

    def __post_init__(self):
        if self.dim % self.subspaces:
            raise ValueError("the dimension must be a multiple of the subspaces")

    @property
    def subvector_dim(self) -> int:
        return self.dim // self.subspaces


class PqIndex(VectorIndex):
    """Product quantization: codes in files, look-up tables in the tasks.  Needs ``train`` before a search."""

    def __init__(self, spark: SparkSession, config: PqConfig):
        super().__init__(spark, config.dim, search.EUCLIDEAN)
        self.config, self.books = config, None
        self._codes = _Log(spark, "vec_id long, code array<int>")

    @property
    def is_trained(self) -> bool:
        return self.books is not None

    @property
    def compression_ratio(self) -> float:
        return self.dim * 4 / self.config.subspaces

    def train(self) -> None:
        c = self.config
        self.books = search.pq_train(self.rows(), c.subspaces, c.clusters, c.rounds)
        self._codes = _Log(self.spark, "vec_id long, code array<int>")
        self._codes.add(search.pq_encode(self.rows(), self.books))

    def insert(self, df: DataFrame) -> None:
        good = self._good(df)
        self._rows.add(good)
        if self.is_trained:
            self._codes.add(search.pq_encode(good, self.books))

    def remove(self, ids: DataFrame) -> None:
        super().remove(ids)
        if self.is_trained:
            self._codes.remove(ids)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        if not self.is_trained:
            raise search.NotTrained("the codebooks are not trained")
        return search.pq_search(queries, self._codes.live(), self.books, k)


class HnswIndex(VectorIndex):
    """Proximity graphs, one a shard and one row of a file each.  A change marks the shards it falls into, and the next
    search builds those anew; others stay as they are."""

    def __init__(self, spark: SparkSession, config: search.IndexConfig, shards: int = 1):
        super().__init__(spark, config.dim, config.metric)
        self.config, self.shards = config, shards
        self._graphs = own_folder(spark)
        self._built: dict[int, str] = {}  # the file set of each shard
        self._stale = True
        self._changed: list[DataFrame] = []

    def insert(self, df: DataFrame) -> None:
        good = self._good(df)
        self._rows.add(good)
        self._changed.append(good.select("vec_id"))

    def remove(self, ids: DataFrame) -> None:
        super().remove(ids)
        self._changed.append(ids.select("vec_id"))

    def build(self) -> None:
        """Build the graphs of the shards that changed."""
        touched: set[int] = set()
        for ids in self._changed:
            touched |= {r.shard for r in ids.select(search.shard_of("vec_id", self.shards).alias("shard")).distinct().collect()}
        if touched:
            name = f"{self._graphs}/{uuid.uuid4().hex}"
            rows = self.rows().where(search.shard_of("vec_id", self.shards).isin(sorted(touched)))
            search.hnsw_build(rows, self.config, self.shards).repartition(len(touched), "shard").write.parquet(name)
            self._built |= dict.fromkeys(touched, name)
        self._changed = []

    def graphs(self) -> DataFrame:
        """``(shard, graph)`` of every shard, from the newest files that have it."""
        out = self.spark.createDataFrame([], "shard int, graph binary")
        for name in sorted(set(self._built.values())):
            mine = [s for s, n in self._built.items() if n == name]
            out = out.unionByName(self.spark.read.schema("shard int, graph binary").parquet(name).where(F.col("shard").isin(mine)))
        return out

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        if self._changed:
            self.build()
        return search.hnsw_query(queries, self.graphs(), k, self.config)


def ivf_of(df: DataFrame, config: IvfConfig) -> IvfIndex:
    """A trained index of a table."""
    index = IvfIndex(df.sparkSession, config)
    index.insert(df)
    index.train()
    return index


def hnsw_of(df: DataFrame, config: search.IndexConfig, shard_rows: int = 2000) -> HnswIndex:
    """A built index of a table, with about ``shard_rows`` rows a shard."""
    index = HnswIndex(df.sparkSession, config, max(1, -(-df.count() // shard_rows)))
    index.insert(df)
    index.build()
    return index


def mean_recall(index: VectorIndex, queries: DataFrame, k: int) -> float:
    """Mean share of the exact neighbours that the index finds."""
    truth = search.knn(queries, index.rows(), k, index.metric, index.dim)
    return float(np.mean([r.recall for r in search.recall(index.search(queries, k), truth).collect()] or [1.0]))
