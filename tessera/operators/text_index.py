"""Ranked keyword search: BM25 over an inverted index on Parquet.

Postings (term, id, tf, length) lie in folders by a hash of the term, sorted by term in each, with the document's length
beside them, so a search reads the rows of its terms in their folders and joins nothing but the few document frequencies.
What is added later lies in folders of its own; frequencies and sizes add up when they are read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.knn import MAX_K

#: Runs of letters and digits, in lower case, are terms.
WORD = r"[\p{L}\p{N}]+"
K1, B = 1.2, 0.75
#: Folders of terms, terms of one search at most, and what ranks are added to before they are fused.
BUCKETS, MAX_TERMS, FUSION = 64, 1024, 60


def terms(content: Column) -> Column:
    return F.regexp_extract_all(F.lower(content), F.lit(f"({WORD})"), F.lit(1))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def counted(words: Column) -> Column:
    """The distinct words of an array and how often each is in it: (term, tf), by runs of the sorted array, within the row."""
    def runs(row: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(row) - 1), lambda i: (i == 0) | (F.get(row, i) != F.get(row, i - 1)))
        pair = lambda b: F.transform(b.starts, lambda p, j: F.struct(F.get(row, p).alias("term"), (F.coalesce(F.get(b.starts, j + 1), F.size(row)) - p).alias("tf")))
        return F.transform(F.array(F.struct(starts.alias("starts"))), pair)[0]

    return F.transform(F.array(F.sort_array(words)), runs)[0]


def postings(docs: DataFrame, id: str = "id", content: str = "content") -> DataFrame:  # noqa: A002
    """(term, id, tf, length): how often each term is in each row of docs, and the row's number of terms. A row's terms are
    counted within the row, so nothing is shuffled; only rows of an id that several have are added up, where as long."""
    def each(some: DataFrame) -> DataFrame:
        words = some.select(F.col(id).alias("id"), terms(F.col(content)).alias("words")).where(F.size("words") > 0)
        return words.select("id", F.size("words").alias("length"), F.inline(counted(F.col("words")))).select("term", "id", "tf", "length")

    again = docs.groupBy(F.col(id).alias("_again")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_again")
    if again.head() is None:
        return each(docs)
    same = F.col(id).eqNullSafe(F.col("_again"))
    added = each(docs.join(again, same, "left_semi")).groupBy("term", "id", "length").agg(F.sum("tf").cast("int").alias("tf"))
    return each(docs.join(again, same, "left_anti")).unionByName(added)


def weight(tf: Column, df: Column, length: Column, docs: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    """The BM25 weight of a term in a document."""
    idf = F.log(1 + (docs - df + 0.5) / (df + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


class TextIndex:
    """An inverted index in a folder. A row is found by terms of its content; ids should be unique. Rows without terms count
    as documents of no length. One writer at a time; what a failed write leaves is never read, as the list of parts
    (one row a part, appended last) doesn't have it."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    @classmethod
    def build(cls, docs: DataFrame, path: str, id: str = "id", content: str = "content", buckets: int = BUCKETS) -> TextIndex:  # noqa: A002
        self = cls(docs.sparkSession, path, buckets)
        self.add(docs, id, content)
        return self

    def add(self, docs: DataFrame, id: str = "id", content: str = "content") -> None:  # noqa: A002
        """Index more rows, whose ids should be new."""
        part, kind = uuid.uuid4().hex, docs.schema[id].dataType.simpleString()
        # a folder's rows go to one task unless they are many: then Spark deals them to several
        rows = postings(docs, id, content).withColumn("bucket", bucket_of(F.col("term"), self.buckets))
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{self.path}/postings/part={part}")
        have = self._read("postings", [part], kind)
        have.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df")).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.path}/terms/part={part}")
        size = docs.agg(F.count(F.lit(1)).alias("docs")).join(have.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words")))
        size.select(F.lit(part).alias("part"), F.lit(kind).alias("id_type"), "docs", "words").coalesce(1).write.mode("append").json(f"{self.path}/parts")

    def _read(self, name: str, parts: list[str], kind: str) -> DataFrame:
        columns = {"postings": f"term string, id {kind}, tf int, length int", "terms": "term string, df long"}[name]
        out = self.spark.read.schema(f"{columns}, part string, bucket int").option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/part={p}" for p in parts])
        return out.drop("part")

    def sizes(self) -> tuple[list[str], str, int, float]:
        """(parts, type of ids, documents, terms of a document on average)."""
        rows = self.spark.read.schema("part string, id_type string, docs long, words long").json(f"{self.path}/parts").collect()  # a row per build or add
        docs = sum(r["docs"] for r in rows)
        return sorted(r["part"] for r in rows), rows[0]["id_type"], docs, sum(r["words"] for r in rows) / docs if docs else 0.0

    def _scored(self, wanted: DataFrame | list[str], k1: float, b: float) -> DataFrame:
        """(term, id, score[, columns of wanted]) of every posting of the wanted terms."""
        parts, kind, docs, average = self.sizes()
        rows, counts = self._read("postings", parts, kind), self._read("terms", parts, kind)
        if isinstance(wanted, list):
            folders = F.col("bucket").isin(*[bucket_of(F.lit(t), self.buckets) for t in wanted]) if wanted else F.lit(False)
            rows, counts = (df.where(folders & F.col("term").isin(wanted)) for df in (rows, counts))
            counts = F.broadcast(counts.groupBy("term").agg(F.sum("df").alias("df")))  # at most MAX_TERMS rows
            rows = rows.join(counts, "term")
        else:
            wanted = wanted.withColumn("bucket", bucket_of(F.col("term"), self.buckets))
            own = counts.join(wanted.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi").groupBy("bucket", "term").agg(F.sum("df").alias("df"))
            rows = rows.join(own, ["bucket", "term"])
        score = weight(F.col("tf"), F.col("df"), F.col("length"), F.lit(float(docs)), F.lit(average or 1.0), k1, b)
        rows = rows.withColumn("score", score)
        if isinstance(wanted, list):
            return rows
        # a posting goes to its document's task once, not once for each query that has the term; the sums are made there
        return rows.select("term", "id", "score").repartition("id").join(wanted.drop("bucket"), "term")

    def search(self, query: str, k: int, *, k1: float = K1, b: float = B) -> DataFrame:
        """(id, score): the k best rows that have a term of the query, by score, then id. A term counts once in the query."""
        if not 0 <= k <= MAX_K:
            raise ValueError(f"k must be from 0 to {MAX_K}, not {k}")
        asked = self.spark.createDataFrame([(query,)], "q string").select(F.array_distinct(terms(F.col("q")))).head()[0]
        if len(asked) > MAX_TERMS:
            raise ValueError(f"more than {MAX_TERMS} terms")
        total = self._scored(asked, k1, b).groupBy("id").agg(F.round(F.sum("score"), 9).alias("score"))
        return total.orderBy(F.desc("score"), "id").limit(k)

    def search_join(self, queries: DataFrame, k: int, *, query_id: str = "query_id", text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
        """(query_id, id, score, rank): the k best rows for each query; queries without a known term have none."""
        if not 1 <= k <= MAX_K:
            raise ValueError(f"k must be from 1 to {MAX_K}, not {k}")
        wanted = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(terms(F.col(text)))).alias("term"))
        total = self._scored(wanted, k1, b).groupBy("query_id", "id").agg(F.round(F.sum("score"), 9).alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return total.withColumn("rank", rank).where(F.col("rank") <= k)


def fused(near: DataFrame, ranked: DataFrame, k: int, constant: int = FUSION) -> DataFrame:
    """(id, distance, bm25, score): the k best of both lists by the sum of 1 / (constant + rank). near has (id, distance),
    ranked (id, score), each at most MAX_K rows, as searches give them."""
    place = lambda df, *order: df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    one = place(near.select("id", "distance"), "distance", "id").select("id", "distance", (1 / (F.lit(constant) + F.col("rank"))).alias("a"))
    two = place(ranked.select("id", F.col("score").alias("bm25")), F.desc("bm25"), "id").select("id", "bm25", (1 / (F.lit(constant) + F.col("rank"))).alias("b"))
    both = one.join(two, "id", "full").withColumn("score", F.round(F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)), 9))
    return both.select("id", "distance", "bm25", "score").orderBy(F.desc("score"), "id").limit(k)
