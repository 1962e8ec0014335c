"""Collections of points as tables: created with their dimension, checked on writes, dropped, copied aside.

A collection is a folder of parquet partitioned by bucket of the document, so a document's points
are found and replaced without reading the rest; the dimension of its vectors is kept beside it.
Writes go through keyed overwrites: a repeated write gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import changes
from vellum.session import checkpointed, exists, remove

POINT = "id string, doc_id string, doc_name string, chunk int, content string, pages array<int>, is_table boolean, vector array<float>"
BUCKETS = 64


def create(spark: SparkSession, path: str, dim: int) -> bool:
    """An empty collection for vectors of a dimension, unless it is there; whether it was made. A collection of another dimension is an error."""
    held = dimension(spark, path)
    if held is not None:
        if held != dim:
            raise ValueError(f"{path} holds vectors of {held} numbers, not {dim}")
        return False
    spark.createDataFrame([(dim,)], "dim int").coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    return True


def recreate(spark: SparkSession, path: str, dim: int) -> None:
    drop(spark, path)
    create(spark, path, dim)


def drop(spark: SparkSession, path: str) -> bool:
    """Deletes a collection; whether it was there."""
    there = exists(spark, path)
    if there:
        remove(spark, path)
    return there


def dimension(spark: SparkSession, path: str) -> int | None:
    """The dimension of a collection; None where there is none."""
    return spark.read.schema("dim int").json(f"{path}/meta").first().dim if exists(spark, f"{path}/meta") else None


def read(spark: SparkSession, path: str) -> DataFrame:
    """The points of a collection."""
    schema = f"{POINT}, bucket int"
    p = spark.read.schema(schema).parquet(f"{path}/points") if exists(spark, f"{path}/points") else spark.createDataFrame([], schema)
    return p


def _bucket():
    return F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")


def upsert(points: DataFrame, path: str) -> int:
    """Puts points in by id and returns how many; of several with one id one stays. Vectors of another dimension are an error, null ones are kept for sparse search."""
    spark = points.sparkSession
    dim = dimension(spark, path)
    if dim is None:
        raise ValueError(f"{path} is no collection")
    cols = [c.split()[0] for c in POINT.split(", ")]
    new = checkpointed(points.where("id is not null").select(*cols).groupBy("id").agg(F.max_by(F.struct(*cols), F.struct("doc_id", "chunk", "content")).alias("x")).select("x.*").withColumn("bucket", _bucket()))
    if new.where(F.col("vector").isNotNull() & (F.size("vector") != dim)).limit(1).count():
        raise ValueError(f"{path} takes vectors of {dim} numbers")
    _replace(path, new, new.select("id"), "id", new.select("bucket").distinct())
    return new.count()


def delete_documents(gone: DataFrame, path: str) -> None:
    """Takes out all points of documents (doc_id)."""
    g = gone.select("doc_id").distinct()
    _replace(path, read(gone.sparkSession, path).limit(0), g, "doc_id", g.select(_bucket().alias("bucket")).distinct())


def _replace(path: str, new: DataFrame, out: DataFrame, key: str, touched: DataFrame) -> None:
    old = read(new.sparkSession, path).join(touched, "bucket", "left_semi").join(out, key, "left_anti")
    changes.rewrite(checkpointed(new.unionByName(old.select(*new.columns))), f"{path}/points", "bucket", touched)


def payloads(texts: DataFrame, tables: DataFrame) -> DataFrame:
    """Chunks of texts and tables (doc_id, doc_name, chunk, content, pages) as one list of points without vectors: tables flagged and numbered behind the texts of their document, what is embedded led by the document's name."""
    n = texts.groupBy("doc_id").agg((F.max("chunk") + 1).alias("_n"))
    t = tables.join(n, "doc_id", "left").withColumn("chunk", F.col("chunk") + F.coalesce("_n", F.lit(0))).drop("_n")
    both = texts.withColumn("is_table", F.lit(False)).unionByName(t.withColumn("is_table", F.lit(True)))
    lead = F.concat(F.when(F.col("is_table"), "Table of ").otherwise(""), F.coalesce("doc_name", F.lit("")), F.lit("\n"), "content")
    return both.withColumn("embed_text", lead).withColumn("id", F.sha2(F.concat_ws("|", "doc_id", F.col("chunk").cast("string"), "content"), 256))


def backup(spark: SparkSession, tables: dict[str, DataFrame], root: str, stamp: str, keep: int = 7) -> list[str]:
    """Copies tables below root/stamp and deletes the oldest copies beyond `keep`; stamps sort by time. The stamps that are left."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{stamp}/{name}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(root)
    stamps = sorted(s.getPath().getName() for s in p.getFileSystem(conf).listStatus(p))
    for old in stamps[:-keep]:
        remove(spark, f"{root}/{old}")
    return stamps[-keep:]


def with_columns(df: DataFrame, schema: str) -> DataFrame:
    """df with the columns of a newer schema: missing ones are null, others are cast; columns of its own stay behind them."""
    from pyspark.sql.types import StructType

    want = StructType.fromDDL(schema)
    named = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want]
    return df.select(*named, *(c for c in df.columns if c not in want.names))
