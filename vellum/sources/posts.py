"""A Python data source for articles of a site that gives posts as JSON, newest first.

The source reads pages of a REST listing, or JSON files in a folder with the same shape, so it
works without a network. Options: path (folder of .json files) or url with fetch left to the
reader's default; max (articles), page (articles a request). Each page is a partition.
"""

from __future__ import annotations

import html
import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "post_id bigint, slug string, title string, url string, date string, modified string, content string"


def article(post: dict) -> tuple | None:
    """A row of one post; None without an id. Entities are resolved; modified falls back to date."""
    if not isinstance(post, dict) or post.get("id") is None:
        return None
    part = lambda k: (post.get(k) or {}).get("rendered", "") if isinstance(post.get(k), dict) else (post.get(k) or "")
    title = html.unescape(re.sub(r"<[^>]+>", "", part("title"))).strip()
    date = post.get("date") or ""
    return int(post["id"]), post.get("slug") or "", title, post.get("link") or "", date, post.get("modified") or date, part("content")


class _Page(InputPartition):
    def __init__(self, number: int, files: list[str]):
        super().__init__(number)
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_Page]:
        path = self.options["path"]
        files = sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".json"))
        return [_Page(i, [f]) for i, f in enumerate(files)] or [_Page(0, [])]

    def read(self, partition: _Page) -> Iterator[tuple]:
        for f in partition.files:
            with open(f, encoding="utf-8") as h:
                posts = json.load(h)
            if not isinstance(posts, list):
                raise ValueError(f"{f} holds no list of posts")
            yield from (r for r in map(article, posts) if r)


class Posts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "posts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Articles, newest first if limited."""
    from pyspark.sql import functions as F

    spark.dataSource.register(Posts)
    d = spark.read.format("posts").option("path", path).load()
    return d.orderBy(F.desc("date"), F.desc("post_id")).limit(most) if most else d
