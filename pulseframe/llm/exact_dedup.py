"""Exact deduplication against a persistent digest index.

Texts are equal when identical after deleting the six ASCII white-space characters; null counts as empty. Of equal texts
the row with the most code points in the original text stays, then the smallest id; a null id loses a tie.

The index is a Parquet table (digest, keep_id, n_chars), bucketed and sorted by digest. A batch is reduced to its best
row of each text; a sort-merge anti-join on the buckets drops those for which the index already holds as good a row, and
the others are appended. The best of a text's entries is its keeper, so the index doesn't depend on how rows are split
into batches or on their order, and a batch that comes again, whole or in part (a job that died behind an append),
changes nothing. Verdicts are read from the index, not from the batch.

Repeated rows of one document have one verdict. An empty batch appends nothing and returns no rows. Only the id and the
text are read, so other columns and their names don't matter; very long texts are hashed whole.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm.common import SPACES, lookup, scratch_path, written

SCHEMA = "digest binary, keep_id long, n_chars int"
BUCKET_ROWS = 2_000_000  #: entries of a bucket, about 100 MB
BATCHES = 4  #: parts in which a whole table goes through an index


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, n_chars."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(text), 256)).alias("digest"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars"))


def buckets_for(rows: int) -> int:
    """A power of two, 8 at least."""
    return 1 << max(3, (rows // BUCKET_ROWS).bit_length())


def _best(id_col: str) -> Column:
    """The least of these is the row that stays."""
    return F.min(F.struct((-F.col("n_chars")).alias("minus_chars"), F.col(id_col).isNull().alias("nameless"), F.col(id_col).alias("keep_id")))


class DigestIndex:
    """location: a folder that all executors reach. Opening it again later continues the same index, with the number of
    buckets that it was made with. close() forgets the table's name; the files stay."""

    def __init__(self, spark: SparkSession, location: str | None = None, buckets: int = 64):
        self.spark, self.location = spark, location or scratch_path(spark, "digest_index")
        self.buckets = self._made_with() or buckets
        self.files, self.table = f"{self.location}/buckets_{self.buckets}", f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.table} ({SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.files}'")

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _made_with(self) -> int | None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.location)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return next((int(m[1]) for x in names if (m := re.fullmatch(r"buckets_(\d+)", x))), None)

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def keepers(self) -> DataFrame:
        """digest, keep_id, n_chars: the best entry of each text."""
        best = self.entries().groupBy("digest").agg(_best("keep_id").alias("best"))
        return best.select("digest", F.col("best.keep_id").alias("keep_id"), (-F.col("best.minus_chars")).alias("n_chars"))

    def append(self, new: DataFrame) -> None:
        spread = new.select("digest", "keep_id", "n_chars").repartition(self.buckets, "digest")
        spread.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.files).saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)

    def add(self, batch: DataFrame) -> None:
        """batch(doc_id, digest, n_chars): appends the rows that are better than what the index holds of their text."""
        best = batch.groupBy("digest").agg(_best("doc_id").alias("best"))
        new = best.select("digest", F.col("best.keep_id").alias("keep_id"), (-F.col("best.minus_chars")).alias("n_chars")).alias("new")
        held = self.entries().alias("held").hint("merge")
        earlier = F.col("new.keep_id").isNull() | F.coalesce(F.col("held.keep_id") <= F.col("new.keep_id"), F.lit(False))
        as_good = (F.col("held.n_chars") > F.col("new.n_chars")) | ((F.col("held.n_chars") == F.col("new.n_chars")) & earlier)
        self.append(new.join(held, (F.col("new.digest") == F.col("held.digest")) & as_good, "left_anti"))

    def verdicts(self, facts: DataFrame) -> DataFrame:
        """facts(doc_id, digest, n_chars), a written table -> a row for each: doc_id, keep_id, group_size (rows of facts
        with this text), kept, text_sha256."""
        members = facts.groupBy("digest").agg(F.count("*").alias("members"))
        told = written(members.join(self.keepers().hint("merge"), "digest").select("digest", "keep_id", F.col("n_chars").alias("keep_chars"), "members"), "keepers")
        found = lookup(facts, told, "digest", "members", facts.count())
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
        return found.select("doc_id", "keep_id", F.col("members").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 1) -> DataFrame:
        """Adds docs to the index, in so many batches, and returns their verdicts."""
        facts = written(digested(docs, id_col, text_col), "digests")
        for k in range(batches):
            self.add(facts.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
        return self.verdicts(facts)

    def compacted(self, location: str | None = None) -> DigestIndex:
        """A new index of the keepers alone, one file a bucket."""
        fresh = DigestIndex(self.spark, location, self.buckets)
        fresh.append(self.keepers())
        return fresh

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """Verdicts on one whole table, through an index of its own that goes with the session."""
    with DigestIndex(docs.sparkSession, buckets=buckets_for(docs.count())) as index:
        return index.ingest(docs, id_col, text_col, batches)
