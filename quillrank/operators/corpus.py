"""Corpus building: pages to lines, lines to articles, articles to clauses and points."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

def page_links(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((page_id, name) of every link of a page, (page_id, name) that a page answers to): a link leads to pages whose heading starts with its word."""
    links = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1)))).alias("name"))
    heads = pages.select("page_id", F.split_part(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), F.lit(" "), F.lit(1)).alias("name"))
    return links.where("name <> ''"), heads.where("name <> ''")


def crawl(links: DataFrame, heads: DataFrame, seeds: DataFrame) -> DataFrame:
    """(page_id, depth) of every page that the seeds lead to, in as many steps as it takes to find no more.

    A step goes from new pages to the names that they link to and no page before them did, and from these to the
    pages that answer to them, so links and pages of a common name are not multiplied.  Every step is
    written down; the driver sees whether it found a page.
    """
    front = written(seeds.select("page_id", F.lit(0).alias("depth")).distinct(), "crawl")
    reached, called, depth = front, None, 0
    while not front.isEmpty():
        depth += 1
        names = links.join(front.select("page_id"), "page_id", "left_semi").select("name").distinct()
        names = written(names if called is None else names.join(called, "name", "left_anti"), "crawl")
        called = names if called is None else called.union(names)
        found = heads.join(names, "name", "left_semi").select("page_id").distinct().join(reached, "page_id", "left_anti")
        front = written(found.withColumn("depth", F.lit(depth)), "crawl")
        reached = reached.union(front)
    return reached


def items(pages: DataFrame) -> DataFrame:
    """(page_id, place, title): the texts of a page's list items, without tags."""
    found = F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<li>(.*?)</li>"), F.lit(1))).alias("place", "item")
    return pages.select("page_id", found).select("page_id", "place", F.trim(F.regexp_replace("item", "<[^>]*>", "")).alias("title")).where("title <> ''")


LEAVES = {"p", "li", "h1", "h2", "h3", "h4", "title"}
SKIPPED = {"script", "style", "nav", "noscript"}


class _Lines(HTMLParser):
    """Text of leaf blocks, one line each."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.parts, self.skip = [], [], 0

    def _flush(self) -> None:
        line = " ".join("".join(self.parts).split())
        if line:
            self.lines.append(line)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif tag in LEAVES or tag in ("div", "article", "br"):
            self._flush()

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in LEAVES or tag in ("div", "article"):
            self._flush()

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def html_lines(pages: DataFrame) -> DataFrame:
    """(page_id, html) become (page_id, line_no, line)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page, html in zip(frame["page_id"], frame["html"]):
                parser = _Lines()
                parser.feed(html or "")
                parser.close()
                parser._flush()
                rows += [(page, i, line) for i, line in enumerate(parser.lines)]
            yield pd.DataFrame(rows, columns=["page_id", "line_no", "line"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id bigint, line_no bigint, line string")


def _starts(pattern: str) -> Callable[[Column], Column]:
    return lambda line: line.rlike(pattern)


#: Which lines are headings of chapters and sections and first lines of articles.
HEADINGS = {"chapter": _starts(r"(?iu)^chương\s"), "section": _starts(r"(?iu)^mục\s"), "article": _starts(r"(?iu)^điều\s+\d+")}


def articles(lines: DataFrame, headings: dict[str, Callable[[Column], Column]] | None = None, first: str = "Chương I") -> DataFrame:
    """(page_id, line_no, line) become articles under carried chapter and section headings.

    Lines before the first article header belong to none; a new chapter ends the section; ``first`` is the chapter
    before the first heading.
    """
    headings = headings or HEADINGS
    order = Window.partitionBy("page_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = lambda kind: F.coalesce(headings[kind](F.col("line")), F.lit(False))
    carried = lines.withColumns({"chap": F.when(hit("chapter"), F.col("line")), "sec": F.when(hit("section"), F.col("line")), "art": F.when(hit("article"), F.col("line_no"))})
    filled = carried.withColumns({
        "chapter": F.coalesce(F.last("chap", True).over(order), F.lit(first)),
        "chap_no": F.max(F.when(F.col("chap").isNotNull(), F.col("line_no"))).over(order),
        "sec_no": F.max(F.when(F.col("sec").isNotNull(), F.col("line_no"))).over(order),
        "sec_line": F.last("sec", True).over(order),
        "article_no": F.last("art", True).over(order),
    })
    body = filled.where("article_no is not null and chap is null and sec is null")
    section = F.when(F.coalesce("sec_no", F.lit(-1)) > F.coalesce("chap_no", F.lit(-1)), F.col("sec_line")).otherwise("")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return body.withColumn("section", section).groupBy("page_id", "article_no").agg(F.min_by("chapter", "line_no").alias("chapter"), F.min_by("section", "line_no").alias("section"), text.alias("full_text"))


def as_chunks(found: DataFrame) -> DataFrame:
    """Articles as chunks of their page: node_id, canonical, chapter, section, article (its place), name (its first line), full_text."""
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("article_no"))
    page = F.col("page_id").cast("string")
    return found.select(
        F.concat(F.lit("node:"), page, F.lit("_D"), place.cast("string")).alias("node_id"), page.alias("canonical"), "chapter", "section", place.alias("article"),
        F.substring(F.trim(F.split("full_text", "\n")[0]), 1, 120).alias("name"), "full_text",
    )


def clauses(chunks: DataFrame) -> DataFrame:
    """(id, full_text) become (id, clause_id, text): numbered lines open clauses below the first line."""
    body = F.array_join(F.slice(F.split("full_text", "\n"), F.lit(2), F.size(F.split("full_text", "\n"))), "\n")
    part = F.explode(F.filter(F.split(body, r"(?m)(?=^\d+\.\s)"), lambda p: p.rlike(r"^\d+\.\s"))).alias("part")
    return chunks.select("id", part).select("id", F.regexp_extract("part", r"^(\d+)\.", 1).alias("clause_id"), F.trim(F.regexp_replace("part", r"^\d+\.\s+|\n+$", "")).alias("text"))


def points(clauses_: DataFrame) -> DataFrame:
    """(id, clause_id, text) become (id, clause_id, label, text): lettered lines open points."""
    part = F.explode(F.filter(F.split("text", r"(?m)(?=^[a-zđ]\)\s)"), lambda p: p.rlike(r"^[a-zđ]\)\s"))).alias("part")
    return clauses_.select("id", "clause_id", part).select("id", "clause_id", F.regexp_extract("part", r"^([a-zđ])\)", 1).alias("label"), F.trim(F.regexp_replace("part", r"^[a-zđ]\)\s+|\n+$", "")).alias("text"))


AMENDS = r"^(\d+)\.\s*(?:Sửa đổi|Bổ sung|Bãi bỏ).*?Điều\s*(\d+[a-z]?)"


def amendments(chunks: DataFrame) -> DataFrame:
    """(id, full_text) become sub-chunks: what stands before the first amending line, and one for each such line."""
    line = chunks.select("id", F.posexplode(F.split("full_text", "\n")).alias("line_no", "line")).withColumn("target", F.nullif(F.regexp_extract("line", AMENDS, 2), F.lit("")))
    part = F.sum(F.col("target").isNotNull().cast("int")).over(Window.partitionBy("id").orderBy("line_no"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return line.withColumn("part", part.cast("bigint")).groupBy("id", "part").agg(F.coalesce(F.max("target"), F.lit("Lời dẫn/Mở đầu")).alias("target"), text.alias("text"))
