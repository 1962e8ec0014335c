"""Pages as Markdown, with title, date, links and attachments, on the standard HTML parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin, urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags by how they are read.
SKIPPED = {"script", "style", "noscript", "iframe", "svg", "form", "button", "nav", "footer"}
VOID = {"img", "br", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "track"}
BLOCK = {"p", "div", "section", "article", "ul", "ol", "blockquote", "figure", "figcaption", "header", "main", "aside", "dl", "dt", "dd", "pre", "hr", "center"}
ATTACHED = re.compile(r"\.(?:pdf|docx?|xlsx?|pptx?|zip|rar)$", re.IGNORECASE)
ARTICLE_LINK = re.compile(r"-\d+/?$")
BODY_CLASS = ("entry-content", "fancybox")
BODY_NAME = re.compile(r"post-content|post-body|article-body|content|detail", re.IGNORECASE)


class Node:
    """An element: tag, attributes, children that are nodes or texts."""

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def text(self) -> str:
        return " ".join("".join(c if isinstance(c, str) else f" {c.text()} " for c in self.children).split())


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        if tag in ("li", "p", "td", "th", "tr") and self.open[-1].tag == tag:
            self.open.pop()
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), None)
        if at:
            del self.open[at:]

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    r = _Reader()
    r.feed(html or "")
    r.close()
    return r.root


def _table(node: Node) -> str:
    rows = [[c.text().replace("|", "\\|") for c in tr.walk() if c.tag in ("td", "th")] for tr in node.walk() if tr.tag == "tr"]
    rows = [r for r in rows if any(r)]
    if not rows:
        return ""
    n = max(map(len, rows))
    line = lambda r: "| " + " | ".join([*r, *[""] * (n - len(r))]) + " |"
    return "\n".join([line(rows[0]), line(["---"] * n), *map(line, rows[1:])])


def tidy(text: str) -> str:
    lines = [" ".join(x.split(" ")).strip() for x in re.sub(r"\r\n?", "\n", text.replace("\xa0", " ").replace("\t", " ")).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(re.sub(r" {2,}", " ", x) for x in lines)).strip()


def to_markdown(node: Node, base: str) -> tuple[str, list[dict]]:
    """Markdown and attachments (name, url), each url once."""
    files: dict[str, str] = {}

    def link(n: Node) -> str:
        text, href = n.text(), n.attrs.get("href", "").strip()
        if not href or href.startswith(("#", "javascript:")):
            return text
        if href.startswith("mailto:"):
            return text or href[7:]
        url = urljoin(base, href)
        path = urlparse(url).path
        if ATTACHED.search(path):
            files.setdefault(url, text or unquote(path.rsplit("/", 1)[-1]))
        return f"[{text}]({url})" if text and text != url else url

    def read(n: Node) -> str:
        out = []
        for c in n.children:
            if isinstance(c, str):
                out.append(re.sub(r"\s+", " ", c))
            elif c.tag in SKIPPED or c.tag == "img":
                continue
            elif c.tag == "br":
                out.append("\n")
            elif c.tag == "table":
                out.append(f"\n\n{_table(c)}\n\n")
            elif c.tag == "a":
                out.append(link(c))
            elif re.fullmatch("h[1-6]", c.tag):
                out.append(f"\n\n{'#' * max(3, int(c.tag[1]))} {c.text()}\n\n" if c.text() else "")
            elif c.tag == "li":
                out.append(f"\n- {read(c)}\n")
            else:
                out.append(f"\n\n{read(c)}\n\n" if c.tag in BLOCK else read(c))
        return "".join(out)

    return tidy(read(node)), [{"name": v, "url": k} for k, v in files.items()]


def body_of(root: Node) -> Node:
    """The element of the article: by class, by the look of a class, article, by id; else all."""
    nodes = list(root.walk())
    classes = lambda n: n.attrs.get("class", "").split()
    for wanted in (*(lambda n, c=c: c in classes(n) for c in BODY_CLASS), lambda n: BODY_NAME.search(n.attrs.get("class", "")), lambda n: n.tag == "article", lambda n: n.tag == "div" and re.search("content", n.attrs.get("id", ""), re.IGNORECASE)):
        found = next((n for n in nodes if wanted(n)), None)
        if found is not None:
            return found
    return root


def article(html: str | None, url: str, default: str = "Notice") -> dict:
    """title, date, content and attachments of a page."""
    root = parse(html)
    nodes = list(root.walk())
    pick = lambda f: next((n for n in nodes if f(n)), None)
    title = pick(lambda n: n.tag == "h1" and re.search("title|detail|post", n.attrs.get("class", ""), re.IGNORECASE)) or pick(lambda n: n.tag == "h1") or pick(lambda n: n.tag == "h2" and re.search("title", n.attrs.get("class", ""), re.IGNORECASE))
    date = pick(lambda n: n.tag == "time") or pick(lambda n: re.search("entry-date|published|post-date|date", n.attrs.get("class", ""), re.IGNORECASE))
    content, files = to_markdown(body_of(root), url)
    return {"title": title.text() if title else default, "date": (date.attrs.get("datetime") or date.text()) if date else "", "content": content, "attachments": files}


def links(html: str | None, url: str) -> list[str]:
    """Links to articles of the same host, in order, each once: no fragment, at most two levels, no category or tag, an id at the end."""
    host, out = urlparse(url).netloc, {}
    for n in parse(html).walk():
        if n.tag == "a" and n.attrs.get("href"):
            u = urlparse(urljoin(url, n.attrs["href"].strip()))
            path = u.path
            if u.scheme in ("http", "https") and u.netloc == host and path.strip("/").count("/") <= 2 and not re.search("/(?:category|tag)/", path) and ARTICLE_LINK.search(path):
                out[u._replace(fragment="", query="").geturl()] = None
    return list(out)


ARTICLE = "title string, date string, content string, attachments array<struct<name:string,url:string>>"


def articles(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, date, content, attachments) of pages (page_id, url, html)."""

    @F.pandas_udf(ARTICLE)
    def read(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([article(h, u or "") for h, u in zip(html, url, strict=True)], columns=["title", "date", "content", "attachments"])

    return pages.withColumn("_a", read("html", "url")).select("page_id", "url", "_a.*")


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, link)."""

    @F.pandas_udf("array<string>")
    def read(html: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([links(h, u or "") for h, u in zip(html, url, strict=True)])

    return pages.select("page_id", F.posexplode(read("html", "url")).alias("pos", "link"))
