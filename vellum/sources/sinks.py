"""Where tables are written: keyed stores, evaluation files, run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import changes
from vellum.sources import files

write_keyed = changes.write_keyed
append_new = files.append_new


def run_log(results: DataFrame, run_id: str, trigger: str, most_errors: int = 20) -> DataFrame:
    """One row of a run from its results (action, error): counts and the first errors in order."""
    n = lambda a: F.count_if(F.col("action") == a).alias(a)
    errors = results.where("error is not null").orderBy("error").limit(most_errors).agg(F.array_sort(F.collect_list("error")).alias("errors")).select("errors").scalar()
    g = results.agg(n("new"), n("updated"), n("skipped"), n("failed"))
    return g.select(F.lit(run_id).alias("run_id"), F.lit(trigger).alias("trigger"), F.current_timestamp().alias("finished_at"), "*", F.to_json(errors).alias("errors"))


def buckets(df: DataFrame, table: str, key: str, n: int = 64) -> None:
    """A bucketed table, so that later joins on the key need no shuffle."""
    df.write.mode("overwrite").bucketBy(n, key).sortBy(key).saveAsTable(table)
