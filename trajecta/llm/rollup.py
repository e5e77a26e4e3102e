"""Token counts as delta-maintained rollups.

Changes are signed: an insert adds a document's tokens, a delete takes them away, a revision adds the
difference. A batch is summed by source, language and tokenizer version before it is written, so its
size is that of its groups and a hot source costs no more than a partial sum in each task. A batch is
committed once under its name: the writer's success marker makes it visible, a batch of a name
already committed is ignored, and one that was left half-written is written anew. Totals are sums
over committed batches.

Defined cases: null source or language is a group of its own; null counts add nothing; an empty
batch commits and changes nothing; groups whose documents and tokens are all back at zero are left
out; repeated rows in a batch each count; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import fresh_path, materialise

KEYS = ("source", "lang", "tokenizer")
_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

#: Counting rules by tokenizer version; SQL expressions over ``text``.
WORDS_1 = r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')"
WORDS_2 = r"regexp_count(text, '[^\\x20\\x09-\\x0D]*[0-9A-Za-z\\x{80}-\\x{10FFFF}][^\\x20\\x09-\\x0D]*')"
PIECES_1 = r"regexp_count(text, '[A-Za-z]+|[0-9]+|[^\\x20\\x09-\\x0D0-9A-Za-z]')"


class TokenRollup:
    """Totals by source, language and tokenizer version in a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._path_type, self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _batch(self, name: str) -> str:
        if not name or not name.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not a batch name: {name!r}")
        return f"{self.path}/batch={name}"

    def is_committed(self, name: str) -> bool:
        return self._fs.exists(self._path_type(f"{self._batch(name)}/_SUCCESS"))

    def commit(self, name: str, changes: DataFrame) -> bool:
        """Add a batch of (source, lang, tokenizer, n_docs, n_tokens) with signed numbers; False if it was committed before."""
        if self.is_committed(name):
            return False
        deltas = changes.groupBy(*KEYS).agg(F.coalesce(F.sum("n_docs"), F.lit(0)).cast("long").alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("long").alias("n_tokens"))
        deltas.write.mode("overwrite").parquet(self._batch(name))
        return True

    def totals(self) -> DataFrame:
        names = [x.getPath().toString() for x in self._fs.globStatus(self._path_type(f"{self.path}/batch=*/_SUCCESS")) or []]
        if not names:
            return self.spark.createDataFrame([], _SCHEMA)
        deltas = self.spark.read.schema(_SCHEMA).parquet(*[x.rsplit("/", 1)[0] for x in names])
        sums = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")


def signed(docs: DataFrame, tokenizer: str, tokens: Column, sign: int = 1, documents: int = 1) -> DataFrame:
    """Changes of one kind: +1 inserts, -1 deletes; revisions count no documents (``documents=0``)."""
    return docs.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign * documents).cast("long").alias("n_docs"), (tokens * sign).cast("long").alias("n_tokens"))


def lifecycle(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A corpus's token totals through load, tokenizer upgrade, removal of exact copies and a recount.

    Load inserts every document under ``words-1`` (and is replayed, which must change nothing); the
    upgrade inserts all under ``pieces-1``; the removal deletes from both all but the first document
    of each text; the recount revises ``words-1`` to words with a letter or digit. The first document is
    that of the smallest doc_id; a row without one is never it, so the removal takes all of these.
    Rows of equal text and doc_id are one document that is there several times: all of them stay.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    counted = materialise(
        own.select("doc_id", "source", "lang", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("h2"), F.expr(WORDS_1).alias("words"), F.expr(WORDS_2).alias("words2"), F.expr(PIECES_1).alias("pieces")),
        "counted",
    )
    first = counted.groupBy("h", "h2").agg(F.min("doc_id").alias("first"))
    kept = counted.join(first, ["h", "h2"])
    again = kept.where("NOT (doc_id <=> first) OR doc_id IS NULL")
    rollup = TokenRollup(docs.sparkSession, path or fresh_path(docs.sparkSession, "rollup"))
    rollup.commit("load", signed(counted, "words-1", F.col("words")))
    rollup.commit("load", signed(counted, "words-1", F.col("words")))
    rollup.commit("upgrade", signed(counted, "pieces-1", F.col("pieces")))
    rollup.commit("copies", signed(again, "words-1", F.col("words"), -1).unionByName(signed(again, "pieces-1", F.col("pieces"), -1)))
    rollup.commit("recount", signed(kept.where("doc_id = first"), "words-1", F.col("words2") - F.col("words"), documents=0))
    return rollup.totals()


SQL = r"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
k AS (SELECT source, lang, len(regexp_extract_all(t, '[^\x20\x09-\x0D]*[0-9A-Za-z\x{80}-\x{10FFFF}][^\x20\x09-\x0D]*')) AS w,
  len(regexp_extract_all(t, '[A-Za-z]+|[0-9]+|[^\x20\x09-\x0D0-9A-Za-z]')) AS p FROM d WHERE doc_id = first)
SELECT source, lang, 'words-1' AS tokenizer, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(w) AS BIGINT) AS n_tokens FROM k GROUP BY source, lang
UNION ALL
SELECT source, lang, 'pieces-1', CAST(count(*) AS BIGINT), CAST(sum(p) AS BIGINT) FROM k GROUP BY source, lang
"""
