"""A lexical index and a vector store kept as tables: built once, grown by what is new, searched without reading texts.

Postings lie in folders by a hash of the term, so a search reads only those of its terms. Documents are a table of their own, with
their lengths; statistics are sums over it. Growing skips documents that the table has, so an interrupted build goes on
where it stopped: documents are added after their postings, and postings of documents that aren't in the table don't count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import B, K1, postings

PARTS = 64


class LexicalIndex:
    """Postings (part, batch, doc_id, term, tf, dl) and documents (doc_id, dl, batch) below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, parts: int = PARTS):
        self.spark, self.parts = spark, parts
        self.postings, self.docs = f"{folder}/postings", f"{folder}/docs"

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except Exception as e:  # the table isn't there yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def documents(self) -> DataFrame:
        return self._read(self.docs, "doc_id bigint, dl int, batch bigint")

    def grow(self, docs: DataFrame) -> None:
        """Add the documents (doc_id, text) that the index doesn't have."""
        have = self.documents()
        new = docs.select("doc_id", "text").join(have.select("doc_id"), "doc_id", "left_anti")
        batch = have.agg(F.coalesce(F.max("batch") + 1, F.lit(0))).first()[0]
        made = postings(new).withColumns({"part": F.pmod(F.xxhash64("term"), F.lit(self.parts)), "batch": F.lit(batch).cast("bigint")})
        # A batch that was cut short is written over.
        made.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("batch", "part").parquet(self.postings)
        of_batch = self._postings().where(F.col("batch") == batch).groupBy("doc_id").agg(F.first("dl").cast("int").alias("dl"))
        rows = new.select("doc_id").distinct().join(of_batch, "doc_id", "left").select("doc_id", F.coalesce("dl", F.lit(0)).alias("dl"), F.lit(batch).cast("bigint").alias("batch"))
        rows.write.mode("append").parquet(self.docs)

    def _postings(self) -> DataFrame:
        return self._read(self.postings, "doc_id bigint, term string, tf bigint, dl int, batch bigint, part bigint")

    def search(self, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
        """(query_id, doc_id, score) by BM25 for queries (query_id, terms); only the folders of the terms are read."""
        asked = queries.select("query_id", F.explode("terms").alias("term")).distinct()
        terms = [r["term"] for r in asked.select("term").distinct().collect()]  # the words of the queries asked at once
        parts = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(self.parts))).distinct().collect()]
        docs = self.documents()
        last = docs.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]
        hits = self._postings().where(F.col("part").isin(parts) & F.col("term").isin(terms) & (F.col("batch") <= last))
        n, avgdl = docs.agg(F.count(F.lit(1)).cast("double"), F.avg("dl")).first()
        df = F.broadcast(hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")))  # one row per term asked
        idf = F.greatest(F.ln((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))
        found = hits.join(df, "term").select("term", "doc_id", part.alias("part"))
        return found.join(F.broadcast(asked), "term").groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))

    def reset(self) -> None:
        """Empty the index."""
        for path in (self.postings, self.docs):
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def grow_vectors(vectors: DataFrame, folder: str, key: str = "vec_id") -> int:
    """Append the vectors that the store below ``folder`` doesn't have; returns how many it had to add."""
    spark = vectors.sparkSession
    try:
        have = spark.read.schema(vectors.select(key).schema).parquet(folder)
        vectors = vectors.join(have, key, "left_anti")
    except Exception as e:  # no store yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    n = vectors.count()
    vectors.write.mode("append").parquet(folder)
    return n
