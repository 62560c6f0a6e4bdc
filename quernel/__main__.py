"""The command line: ingest, query, list, stats, delete and clear over a store and its metadata table.

``python -m quernel DIR ingest PATH`` reads text files, ``query TEXT`` searches them, ``list``, ``stats``,
``delete FILENAME`` and ``clear`` manage them.  Texts are embedded by the stand-in of ``operators.ingest``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators import ingest, search
from quernel.sources import store as st

META = "id long, filename string, content string, chunk_index int, created_at timestamp"
DIM = 64


class Library:
    """A folder with a vector store and a metadata table, kept in step."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.vectors, self.meta = spark, st.VectorStore(spark, f"{path}/vectors"), st.MetadataTable(spark, f"{path}/meta", META)

    def ingest(self, path: str, recursive: bool = True) -> int:
        """Read, chunk, embed and write the text files of a folder; returns the chunks written."""
        texts = st.read_texts(self.spark, path, recursive).withColumn("filename", F.element_at(F.split("path", "/"), -1))
        chunks = ingest.chunked(texts, "filename", "content", lambda t: ingest.sentences(t, 500, 100))
        rows = chunks.select(ingest.doc_id("filename", "chunk_index").alias("id"), "filename", F.col("chunk").alias("content"), "chunk_index", F.current_timestamp().alias("created_at"))
        embed = F.udf(lambda t: ingest.hashed_embedding(t, DIM), "array<float>")  # a stand-in for a hosted model
        self.meta.write(rows)
        return self.vectors.put_batch(self.meta.rows().select(F.col("id").alias("vec_id"), embed("content").alias("embedding")))

    def query(self, text: str, k: int = 5) -> DataFrame:
        """``(rank, vec_id, score, filename, content)`` of the k chunks nearest to a text."""
        q = self.spark.createDataFrame([(0, ingest.hashed_embedding(text, DIM))], "vec_id long, embedding array<float>")
        return ingest.with_metadata(search.knn(q, self.vectors.rows(), k, search.COSINE, DIM), self.meta.rows()).drop("query_id").orderBy("rank")

    def list(self) -> DataFrame:
        return ingest.list_documents(self.meta.rows())

    def stats(self) -> DataFrame:
        return ingest.stats(self.meta.rows())

    def delete(self, filename: str) -> int:
        """Remove a document's rows and vectors; returns how many chunks it had."""
        _, _, gone = ingest.delete_document(self.meta.rows(), self.vectors.rows(), filename)
        gone = gone.persist()
        n = gone.count()
        self.vectors.delete_batch(gone)
        self.meta.delete(gone.select(F.col("vec_id").alias("id")))
        gone.unpersist()
        return n

    def clear(self) -> None:
        self.vectors.clear()
        self.meta.delete(self.meta.rows().select("id"))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quernel", description=__doc__)
    p.add_argument("dir")
    sub = p.add_subparsers(dest="verb", required=True)
    sub.add_parser("ingest").add_argument("path")
    q = sub.add_parser("query")
    q.add_argument("text")
    q.add_argument("-k", type=int, default=5)
    for verb in ("list", "stats", "clear"):
        sub.add_parser(verb)
    sub.add_parser("delete").add_argument("filename")
    a = p.parse_args(argv)
    lib = Library(SparkSession.builder.appName("quernel").getOrCreate(), a.dir)
    if a.verb == "ingest":
        print(lib.ingest(a.path), "chunks")
    elif a.verb == "query":
        lib.query(a.text, a.k).show(a.k, truncate=80)
    elif a.verb == "delete":
        print(lib.delete(a.filename), "chunks")
    elif a.verb == "clear":
        lib.clear()
    else:
        getattr(lib, a.verb)().show(truncate=False)


if __name__ == "__main__":
    main()
