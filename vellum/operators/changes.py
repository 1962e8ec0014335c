"""Change capture and keyed writes.

Files and articles are compared with what is known by key and content hash; tables are written
by key, so that a repeated run changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T


# Signs of errors that may pass.
TRANSIENT = ["429", "500", "502", "503", "504", "timeout", "timed out", "rate limit", "overloaded", "unavailable", "connection"]


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def actions(incoming: DataFrame, known: DataFrame, key: str = "doc_id", digest: str = "file_hash") -> DataFrame:
    """(key, action): new, skip or update for what comes in, delete for what is gone. One full join; both sides reduced to one row a key."""
    a = incoming.groupBy(key).agg(F.max(digest).alias("a"))
    b = known.groupBy(key).agg(F.max(digest).alias("b"))
    act = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "delete").when(F.col("a") == F.col("b"), "skip").otherwise("update")
    return a.join(b, key, "full").select(key, act.alias("action"))


def article_actions(incoming: DataFrame, known: DataFrame, least: int = 50) -> DataFrame:
    """(post_id, action) of articles (post_id, modified, content, attachments) against (post_id, modified, status): skipped when too short without attachments or unchanged, else new or updated."""
    j = incoming.join(known.select("post_id", F.col("modified").alias("before"), "status"), "post_id", "left")
    short = (F.length(F.coalesce("content", F.lit(""))) < least) & (F.coalesce(F.size("attachments"), F.lit(0)) < 1)
    same = (F.col("status") == "ok") & (F.col("modified") == F.col("before"))
    return j.select("post_id", F.when(short | F.coalesce(same, F.lit(False)), "skipped").when(F.col("status").isNull(), "new").otherwise("updated").alias("action"))


def missing_in_catalog(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files (name) that no catalog entry (filename) names, whole or by stem: two anti-joins on equal keys instead of one with OR."""
    c = catalog.where("filename is not null")
    names, stems = c.select(F.lower("filename").alias("_n")).distinct(), c.select(F.lower(T.file_stem(F.col("filename"))).alias("_s")).distinct()
    f = files.withColumn("_n", F.lower("name")).withColumn("_s", F.lower(T.file_stem(F.col("name"))))
    return f.join(names, "_n", "left_anti").join(stems, "_s", "left_anti").drop("_n", "_s")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """current with changes merged in by key; of several rows of a key the one with the largest `order` stays."""
    both = current.unionByName(changes, allowMissingColumns=True)
    cols = both.columns
    g = both.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_x"))
    return g.select(*(F.col("_x")[c].alias(c) for c in cols))


def delete(current: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return current.join(gone.select(*keys).distinct(), keys, "left_anti")


def resolve(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """(name, id, tier): the catalog entry a name means: by file name (1), original name (2) or stem (3); on a tie the newest. Each tier is an equi-join."""
    c = catalog.select("id", "filename", "original_name", "created_at")
    n = names.select("name").where("name is not null").distinct().withColumn("k", T.name_key(F.col("name"))).withColumn("s", T.name_key(T.file_stem(F.col("name"))))
    one = n.join(c.withColumn("k", T.name_key(F.col("filename"))), "k").withColumn("tier", F.lit(1))
    two = n.join(c.withColumn("k", T.name_key(F.col("original_name"))), "k").withColumn("tier", F.lit(2))
    three = n.join(c.withColumn("s", T.name_key(T.file_stem(F.col("original_name")))), "s").withColumn("tier", F.lit(3))
    cols = ["name", "id", "created_at", "tier"]
    all_ = one.select(*cols).unionByName(two.select(*cols)).unionByName(three.select(*cols))
    g = all_.groupBy("name").agg(F.min_by(F.struct("id", "tier"), F.struct("tier", -F.unix_micros(F.coalesce(F.col("created_at").cast("timestamp"), F.timestamp_seconds(F.lit(0)))), "id")).alias("x"))
    return g.select("name", "x.*")


def article_file(post_id: Column, slug: Column, prefix: str = "ART") -> Column:
    """File name of an article: prefix, id and a slug without the id at its end."""
    s = F.regexp_replace(slug, r"-\d+$", "")
    return F.concat(F.lit(f"{prefix}_"), post_id.cast("string"), F.lit("_"), T.slug(s), F.lit(".md"))


def article_text(title: Column, url: Column, date: Column, modified: Column, content: Column) -> Column:
    """An article as Markdown with its origin above the text; empty lines of origin are left out."""
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n", F.concat(F.lit("# "), title), line("Source", url), line("Date", date), line("Modified", modified), F.lit(""), content)


def modified_marker(c: Column) -> Column:
    m = F.regexp_extract(c, r"(?m)^Modified: (.+)$", 1)
    return F.when(m != "", F.trim(m))


def write_keyed(df: DataFrame, path: str, partition: str) -> None:
    """Overwrites only the partitions that df has; a repeated run gives the same table."""
    df.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def rewrite(df: DataFrame, path: str, partition: str, touched: DataFrame) -> None:
    """Overwrites the partitions of `touched` (partition) with the rows df has for them; those that df has no row for are removed. There are as many partitions as the store has buckets."""
    from vellum.session import remove

    write_keyed(df, path, partition)
    for r in touched.join(df.select(partition).distinct(), partition, "left_anti").toLocalIterator():
        remove(df.sparkSession, f"{path}/{partition}={r[0]}")


def without_prefix(current: DataFrame, name: str, prefix: str) -> DataFrame:
    """Rows whose name doesn't start with a prefix; rows without a name stay."""
    return current.where(~F.coalesce(F.col(name).startswith(prefix), F.lit(False)))


def prefix_status(catalog: DataFrame, prefix: str, latest: int = 5) -> DataFrame:
    """One row: how many entries of a prefix there are, how many are ready, their chunks, and the names of the latest; a bounded list."""
    c = catalog.where(F.col("filename").startswith(prefix))
    new = c.orderBy(F.desc_nulls_last("created_at"), "id").limit(latest).agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.coalesce(F.col("created_at").cast("timestamp"), F.timestamp_seconds(F.lit(0))))).alias("t"), "id", "filename"))).alias("l"))
    g = c.agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "ready").alias("ready"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))
    return g.withColumn("newest", F.coalesce(new.select(F.transform("l", lambda x: x["filename"])).scalar(), F.array().cast("array<string>")))


def candidate_names(catalog: DataFrame) -> DataFrame:
    """(id, names): the distinct names a catalog entry goes by, in order: file name, original name, and the original name with the ending of the file."""
    with_ending = F.when(F.col("original_name").isNotNull(), F.concat(T.file_stem(F.col("original_name")), T.file_ending(F.col("filename"))))
    return catalog.select("id", F.array_distinct(F.array_compact(F.array("filename", "original_name", with_ending))).alias("names"))


def resolve_requested(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """(name, id, tier): resolve() for names as they were sent, and for what isn't found, with URL escapes read."""
    from vellum.session import checkpointed

    asked = names.select("name").where("name is not null").distinct()
    first = checkpointed(resolve(asked, catalog))
    rest = asked.join(first.select("name"), "name", "left_anti").withColumn("raw", F.col("name")).withColumn("name", F.try_url_decode("raw")).where("name <> raw")
    again = rest.join(resolve(rest.select("name"), catalog), "name").select(F.col("raw").alias("name"), "id", "tier")
    return first.unionByName(again)


def inside(path: Column, root: str) -> Column:
    """Whether a path, with its . and .. resolved, lies below root."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    step = lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    clean = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    return F.coalesce(clean.startswith(root.rstrip("/") + "/"), F.lit(False))


def todo(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is left of resumable work: rows whose keys aren't done; done rows of other keys don't matter."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def retryable(error: Column, tokens: list[str] | None = None) -> Column:
    """Whether an error may pass: its text names a limit, a time-out or a server's trouble."""
    return T.contains_any(F.lower(error), TRANSIENT if tokens is None else tokens)


def run_page(runs: DataFrame, limit: int = 20) -> DataFrame:
    """The newest runs; the limit is kept between 1 and 100."""
    return runs.orderBy(F.desc_nulls_last("finished_at"), "run_id").limit(min(max(limit, 1), 100))


def stored_article(catalog: DataFrame, wanted: DataFrame, prefix: str = "ART") -> DataFrame:
    """(post_id, id): the newest catalog entry of an article (post_id, stem), by its stem or by the id in its file name; two equi-joins instead of a pattern."""
    c = catalog.select("id", T.file_stem(F.col("filename")).alias("stem"), F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(0)).alias("t"))
    own = F.regexp_extract("stem", rf"^{prefix}_(\d+)_", 1)
    by_stem = wanted.select("post_id", "stem").join(c, "stem").select("post_id", "id", "t")
    by_id = wanted.select("post_id", F.col("post_id").cast("string").alias("own")).join(c.withColumn("own", own).where("own <> ''"), "own").select("post_id", "id", "t")
    return by_stem.unionByName(by_id).groupBy("post_id").agg(F.max_by("id", F.struct("t", "id")).alias("id"))


def located(paths: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """(path, found): where a path lies among files (name): as it is, or below root, or by its last part below root."""
    p = paths.select("path").where("path is not null").distinct()
    f = files.select("name").distinct()
    tries = [F.col("path"), F.concat(F.lit(root.rstrip("/") + "/"), "path"), F.concat(F.lit(root.rstrip("/") + "/"), T.base_name(F.col("path")))]
    t = p.select("path", F.posexplode(F.array(*tries)).alias("n", "name")).join(f, "name")
    return t.groupBy("path").agg(F.min_by("name", "n").alias("found"))
