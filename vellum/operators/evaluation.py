"""Evaluation: judgments, scores of items, conditional means, confidence intervals, agreement, percentiles, evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T

JUDGMENT = "claims array<struct<text:string,supported:variant>>, answer_relevance variant, context_sufficient variant, refused variant, key_facts array<struct<fact:string,status:string>>"
# Signs that an answer says the sources have nothing.
REFUSALS = ["chưa có thông tin", "không có thông tin", "chưa đề cập", "không đề cập", "không tìm thấy thông tin", "chưa tìm thấy thông tin"]
STATES = ["covered", "missing", "contradicted"]


def says_nothing_found(answer: Column) -> Column:
    return T.contains_any(F.lower(answer), REFUSALS)


def _strict_bool(v: Column) -> Column:
    """A JSON boolean; null for anything else."""
    return F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))


def judgment(raw: Column) -> Column:
    """struct of claims, answer_relevance (1 to 5), context_sufficient, refused and key_facts of a judge's JSON, fenced or not; null if it is no JSON object. Claims without a boolean and facts of unknown state are dropped, other wrong types are null."""
    v = F.try_parse_json(T.unfence(raw))
    ok = F.schema_of_variant(v).startswith("OBJECT")
    claims = F.filter(F.transform(F.coalesce(F.try_variant_get(v, "$.claims", "array<variant>"), F.array().cast("array<variant>")), lambda c: F.struct(F.coalesce(F.try_variant_get(c, "$.text", "string"), F.lit("")).alias("text"), _strict_bool(F.try_variant_get(c, "$.supported", "variant")).alias("supported"))), lambda c: c["supported"].isNotNull())
    facts = F.filter(F.transform(F.coalesce(F.try_variant_get(v, "$.key_facts", "array<variant>"), F.array().cast("array<variant>")), lambda c: F.struct(F.coalesce(F.try_variant_get(c, "$.fact", "string"), F.lit("")).alias("fact"), F.try_variant_get(c, "$.status", "string").alias("status"))), lambda c: F.coalesce(c["status"].isin(STATES), F.lit(False)))
    rel = F.least(F.lit(5), F.greatest(F.lit(1), F.try_variant_get(v, "$.answer_relevance", "int")))
    field = lambda n: _strict_bool(F.try_variant_get(v, f"$.{n}", "variant"))
    return F.when(ok, F.struct(claims.alias("claims"), rel.alias("answer_relevance"), field("context_sufficient").alias("context_sufficient"), field("refused").alias("refused"), facts.alias("key_facts")))


def item_scores(rows: DataFrame) -> DataFrame:
    """Scores of rows (id, answer, judgment, contexts array<string>, has_facts)."""
    j = F.col("judgment")
    own = T.articles(F.col("answer"))
    known = F.flatten(F.transform(F.coalesce("contexts", F.array().cast("array<string>")), lambda c: T.articles(c)))
    refused = F.coalesce(j["refused"], says_nothing_found(F.col("answer")))
    n, facts = F.size(j["claims"]), F.size(j["key_facts"])
    use = F.col("has_facts") & (facts > 0)
    return rows.select(
        "*",
        refused.alias("refused"),
        F.when(n > 0, F.size(F.filter(j["claims"], lambda c: c["supported"])) / n).alias("faithfulness"),
        ((j["answer_relevance"] - 1) / 4).alias("answer_relevance"),
        j["context_sufficient"].alias("context_sufficient"),
        F.when(use, F.size(F.filter(j["key_facts"], lambda f: f["status"] == "covered")) / facts).alias("correctness"),
        F.when(use, F.exists(j["key_facts"], lambda f: f["status"] == "contradicted")).alias("contradicted"),
        (T.cites(F.col("answer")) & ~refused).alias("has_citation"),
        (F.size(own) > 0).alias("cites_articles"),
        F.array_except(own, known).alias("wrong_articles"),
    )


def summary(scores: DataFrame, by: list[str]) -> DataFrame:
    """Nine means with their own denominators, in one pass, and each one's number of rows."""
    x = lambda c: F.col(c).cast("double")
    answerable, answered = ~F.col("expect_refusal"), ~F.col("expect_refusal") & ~F.col("refused")
    parts = {
        "faithfulness": x("faithfulness"),
        "answer_relevance": F.when(answerable, x("answer_relevance")),
        "context_relevance": F.when(answerable, x("context_sufficient")),
        "correctness": F.when(answerable, x("correctness")),
        "contradiction_rate": F.when(answerable, x("contradicted")),
        "refusal_recall": F.when(F.col("expect_refusal"), x("refused")),
        "false_refusal_rate": F.when(answerable & F.col("context_sufficient"), x("refused")),
        "citation_rate": F.when(answered, x("has_citation")),
        "wrong_citation_rate": F.when(answered & F.col("cites_articles"), (F.size("wrong_articles") > 0).cast("double")),
    }
    return scores.groupBy(*by).agg(*(f for k, c in parts.items() for f in (F.round(F.avg(c), 6).alias(k), F.count(c).alias(f"n_{k}"))))


def bootstrap(values: DataFrame, value: str = "value", by: list[str] | None = None, rounds: int = 2000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(by, mean, low, high, n): percentile bootstrap of the mean.

    Each row draws its weight in every round from a Poisson distribution (a resample by streaming).
    Equal values are counted first: the weights of c equal ones together are a draw from Poisson(c).
    Draws are seeded by group and value, and only `rounds` sums a group and batch are shuffled.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as st

    by = by or []
    v = values.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    v = v.groupBy(*by, "_v").agg(F.count("*").alias("_c")).withColumn("_row", F.xxhash64(*by, "_v", F.lit(seed)))

    def draw(frames):
        for f in frames:
            for key, g in f.groupby(by, dropna=False, sort=False) if by else [((), f)]:
                w, t = np.zeros(rounds), np.zeros(rounds)
                for x, c, row in zip(g["_v"], g["_c"], g["_row"], strict=True):
                    k = np.random.Generator(np.random.PCG64(row & (2**64 - 1))).poisson(c, rounds)
                    w += k
                    t += k * x
                yield pd.DataFrame({**{b: g[b].iloc[[0] * rounds].array for b in by}, "round": np.arange(rounds, dtype=np.int32), "w": w, "t": t})

    kinds = st.StructType([*(v.schema[b] for b in by), *st.StructType.fromDDL("round int, w double, t double")])
    r = v.mapInPandas(draw, kinds).groupBy(*by, "round").agg(F.try_divide(F.sum("t"), F.sum("w")).alias("m"))
    at = lambda q: F.element_at(F.array_sort(F.collect_list("m")), F.least(F.floor(F.count("m") * q) + 1, F.count("m")).cast("int"))
    ci = r.where("m is not null").groupBy(*by).agg(at(alpha / 2).alias("low"), at(1 - alpha / 2).alias("high"))
    mean = values.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return mean.join(ci, by) if by else mean.withColumn("_k", F.lit(1)).join(ci.withColumn("_k", F.lit(1)), "_k").drop("_k")


def agreement(pairs: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """(by, n, agreement, kappa) of two boolean columns; kappa is 1 or 0 where chance would always agree."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    g = pairs.where(x.isNotNull() & y.isNotNull()).groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg((x == y).cast("double")).alias("po"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    k = F.when(F.col("n") == 0, F.lit(None).cast("double")).when(pe == 1, F.when(F.col("po") == 1, 1.0).otherwise(0.0)).otherwise((F.col("po") - pe) / (1 - pe))
    return g.select(*(by or []), "n", F.round("po", 6).alias("agreement"), F.round(k, 6).alias("kappa"))


def percentiles(values: DataFrame, by: list[str], value: str, ranks: dict[str, float]) -> DataFrame:
    """(by, n, max, each percentile): the value at index round(p * (n - 1)), half to even, of the sorted values.

    Equal values are counted first; the ranks run over counts, so a group of any size is reduced
    to its distinct values, which are spread over buckets.
    """
    c, _ = _runs(values, by, value)
    at = lambda p: F.bround(F.lit(p) * (F.col("n") - 1))
    return c.groupBy(*by).agg(F.first("n").alias("n"), F.first("max").alias("max"), *(F.min(F.when(F.col("_to") > at(p), F.col("_v"))).alias(k) for k, p in ranks.items()))


def _runs(values: DataFrame, by: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(by, _v, _c, n, max, _to): the distinct values of each group with how often they occur and how many rows are not above them.

    The sum over the order runs in buckets. Buckets are cut at quantiles that a sketch of the
    group gives, not at equal widths, so a long tail doesn't put all values into one; any cuts
    give the same sums.
    """
    from vellum.session import checkpointed

    c = checkpointed(values.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c")))
    k = [F.lit(1).alias("_k")] if not by else []
    on = by or ["_k"]
    c = c.select("*", *k)
    n = c.groupBy(*on).agg(F.sum("_c").alias("n"), F.max("_v").alias("max"), F.approx_percentile("_v", [i / 128 for i in range(1, 128)], 512).alias("_cuts"))
    c = c.join(n, on).withColumn("_b", F.size(F.filter("_cuts", lambda x: x < F.col("_v")))).drop("_cuts")
    keys = [*on, "_b"]
    base = c.groupBy(*keys).agg(F.sum("_c").alias("_t")).withColumn("_base", F.sum("_t").over(Window.partitionBy(*on).orderBy("_b")) - F.col("_t"))
    run = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v"))
    return c.withColumn("_run", run).join(base.drop("_t"), keys).withColumn("_to", F.col("_run") + F.col("_base")), n


def before_after(rows: DataFrame, group: str, before: str, after: str) -> DataFrame:
    """(group, n, before, after): means per group and in all, the latter under a null group."""
    return rows.rollup(group).agg(F.count("*").alias("n"), F.round(F.avg(F.col(before).cast("double")), 6).alias("before"), F.round(F.avg(F.col(after).cast("double")), 6).alias("after"))


def question_key(c: Column) -> Column:
    """Questions for comparison: lower case, single blanks, no question mark at the end."""
    return F.lower(F.regexp_replace(T.squeeze(c), r"\s*\?+$", ""))


def clean_set(items: DataFrame) -> DataFrame:
    """(id, question, truths): items (id, question, truth array<string>) grouped by question; the smallest id stands, labels are united."""
    g = items.withColumn("k", question_key(F.col("question"))).where("k <> ''")
    t = g.select("k", F.explode_outer("truth").alias("t")).groupBy("k").agg(F.array_sort(F.collect_set("t")).alias("truths"))
    return g.groupBy("k").agg(F.min_by(F.struct("id", "question"), "id").alias("x")).join(t, "k").select("x.*", "truths")


def worst(scores: DataFrame, k: int = 10) -> DataFrame:
    """The k items of the lowest faithfulness, then relevance; missing values count 1."""
    return scores.orderBy(F.coalesce("faithfulness", F.lit(1.0)), F.coalesce("answer_relevance", F.lit(1.0)), "id").limit(k)


def with_facts(items: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items (…, key_facts), orphans): items (id, …) with the facts (id, fact) known of them, in order, none as an empty list; and the ids of facts that belong to no item."""
    g = facts.groupBy("id").agg(F.array_sort(F.collect_set("fact")).alias("key_facts"))
    j = items.join(g, "id", "left").withColumn("key_facts", F.coalesce("key_facts", F.array().cast("array<string>")))
    return j, g.join(items.select("id"), "id", "left_anti").select("id")


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only a or only b has; no rows when both decide about the same."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, key, "full").where("_a is null or _b is null")
    return j.select(key, F.when(F.col("_b").isNull(), "left").otherwise("right").alias("side"))


def united(answerable: DataFrame, unanswerable: DataFrame) -> DataFrame:
    """Both sets as one with expect_refusal; columns that one lacks are null there."""
    return answerable.withColumn("expect_refusal", F.lit(False)).unionByName(unanswerable.withColumn("expect_refusal", F.lit(True)), allowMissingColumns=True)


def score_table(items: DataFrame, answers: DataFrame, judgments: DataFrame, contexts: DataFrame) -> DataFrame:
    """item_scores() of items (id, expect_refusal, has_facts), answers (id, config, answer), judgments (id, config, raw) and contexts (id, contexts): items without an answer of a configuration have no row, ones without a judgment have nulls."""
    a = items.join(answers.select("id", "config", "answer"), "id").join(judgments.select("id", "config", judgment(F.col("raw")).alias("judgment")), ["id", "config"], "left").join(contexts, "id", "left")
    return item_scores(a)


def overlap_at(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """One row: the mean share of the k best of b that are among the k best of a, over b's queries; ranked lists (query_id, doc_id, rank)."""
    x, y = (d.where(F.col("rank") <= k).select("query_id", "doc_id").distinct() for d in (a, b))
    hit = x.join(y, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("hit"))
    g = y.groupBy("query_id").agg(F.count("*").alias("size")).join(hit, "query_id", "left")
    return g.agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce("hit", F.lit(0)) / F.col("size")), 6).alias("overlap"))


def median_and_floor(values: DataFrame, by: list[str], value: str, p: float = 0.95) -> DataFrame:
    """(by, n, median, floor_rank): the median, between the middle two of an even number, and the value at index floor(p * (n - 1))."""
    c, n = _runs(values, by, value)
    at = lambda i: F.min(F.when(F.col("_to") > i, F.col("_v")))
    low, high = at(F.floor((F.col("n") - 1) / 2)), at(F.floor(F.col("n") / 2))
    return c.groupBy(*by).agg(F.first("n").alias("n"), ((low + high) / 2).alias("median"), at(F.floor(F.lit(p) * (F.col("n") - 1))).alias("floor_rank"))


def calibration_sample(rows: DataFrame, key: str, n: int = 30, seed: int = 42) -> DataFrame:
    """n rows for people to judge, the first by a seeded hash of their key; the same on every run."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def shown_mean(mean: Column, low: Column, high: Column, n: Column, percent: bool = False) -> Column:
    """A mean with its interval and number as text; a dash where there is none."""
    f = (lambda c: F.format_string("%.1f%%", c * 100)) if percent else (lambda c: F.format_string("%.2f", c))
    return F.when(mean.isNull(), "-").otherwise(F.concat(f(mean), F.lit(" ["), f(low), F.lit("-"), f(high), F.lit("] (n="), n.cast("string"), F.lit(")")))
