"""Documents and articles as they come in: each batch is compared with what is known, changed ones are chunked and embedded, and written by key.

The store has two tables below its path: `chunks`, and `documents` with the hash of every
document that was taken in, also of those without chunks. Chunks are written first, so a batch
that failed between the two is taken as changed again and writes the same files; a document is
replaced whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import changes, models, structure
from vellum.session import checkpointed, exists


def points(docs: DataFrame, model=None) -> DataFrame:
    """Chunks of docs (doc_id, text, file_hash) with vectors; ids follow from document, place and content."""
    c = structure.chunks(docs).join(docs.select("doc_id", "file_hash"), "doc_id")
    e = models.embed(c, "content", model)
    return e.withColumn("id", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("chunk").cast("string"), "content"), 256))


def held(spark: SparkSession, path: str, schema) -> DataFrame:
    """What a table holds, no rows where it isn't there yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def known(spark: SparkSession, path: str, like: str) -> DataFrame:
    """(doc_id, file_hash) of the documents that were taken in."""
    return held(spark, f"{path}/documents", f"doc_id {like}, file_hash string, bucket int").select("doc_id", "file_hash")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of the store."""
    return spark.read.parquet(f"{path}/chunks")


def merge(docs: DataFrame, path: str, model=None, buckets: int = 64, complete: bool = False) -> DataFrame:
    """Writes new and changed documents below path, partitioned by bucket of the id; (doc_id, action) of all that came in.

    A bucket with a change is written anew from what it held and what came in, so other buckets
    aren't touched and nothing is stored twice. A document whose text is null, empty or blank
    keeps no chunks and is known by its hash. With `complete`, docs are all there are, and the
    known ones that aren't among them are deleted. Of rows with one id the last `seen` counts.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    docs = docs.groupBy("doc_id").agg(F.max_by(F.struct("text"), F.col("seen") if "seen" in docs.columns else F.coalesce("text", F.lit(""))).alias("x")).select("doc_id", "x.text").withColumn("file_hash", changes.content_hash(F.coalesce("text", F.lit(""))))
    acts = changes.actions(docs, known(spark, path, kind))
    acts = checkpointed(acts if complete else acts.where("action <> 'delete'"))  # decided before anything is written
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket")
    todo = acts.where("action <> 'skip'").select("doc_id", bucket)
    touched = todo.select("bucket").distinct()
    changed = docs.join(todo, "doc_id")
    fresh = points(changed.drop("bucket"), model).withColumn("bucket", bucket)
    for name, new in (("chunks", fresh), ("documents", changed.select("doc_id", "file_hash", "bucket"))):
        old = held(spark, f"{path}/{name}", new.schema).join(touched, "bucket", "left_semi").join(todo.select("doc_id"), "doc_id", "left_anti")
        changes.rewrite(checkpointed(new.unionByName(old.select(*new.columns))), f"{path}/{name}", "bucket", touched)
    return acts


def run(stream: DataFrame, path: str, state: str, model=None, **trigger):
    """A query that merges each batch of a stream of documents; trigger() arguments such as availableNow or processingTime."""
    return stream.writeStream.foreachBatch(lambda b, _: merge(b, path, model)).option("checkpointLocation", state).queryName("ingest").trigger(**(trigger or {"availableNow": True})).start()
