"""Web pages (page_id, url, html) to blocks: one Arrow job finds blocks and why each should go; the rest are columns and windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.common import ratio, slices, trimmed
from lectern.operators.blocks import article_blocks, plain_texts
from lectern.operators.page_tree import CANDIDATES, LEAST_ARTICLE, read_page

#: Headings of summaries, starts of boilerplate, elements that are allowed.
SUMMARY_HEADINGS = (
    r"^(ai\s+)?summary$", r"^key\s+(takeaways?|points?|highlights?)$", r"^(in\s+brief|tl;?dr|highlights?)$", r"^what\s+you('ll)?\s+(learn|need\s+to\s+know)$", r"^(quick\s+)?overview$", r"^at\s+a\s+glance$", r"^the\s+bottom\s+line$",
    r"^(ai\s+)?oppsummering$", r"^kort\s+fortalt$", r"^hovedpoeng(er)?$", r"^n[øo]kkelpunkt(er)?$", r"^sammendrag$", r"^det\s+viktigste$", r"^kort\s+og\s+godt$",
)
BOILERPLATE = (
    r"read\s+more", r"les\s+mer", "related", "relater", "advertisement", "annonse", "sponsored", "sponset", "recommended", "anbefalt", "trending", "popul[æa]r", r"see\s+also", r"se\s+ogs[åa]", r"more\s+from", r"mer\s+fra", r"share\s+this",
    r"del\s+denne", "subscribe", "abonner", r"sign\s+up", r"meld\s+deg", r"follow\s+us", r"f[øo]lg\s+oss",
)
ALLOWED = (
    "p br hr h1 h2 h3 h4 h5 h6 ul ol li dl dt dd strong b em i u s del ins mark sub sup small blockquote q cite abbr dfn code pre kbd samp var a table thead tbody tfoot tr th td caption colgroup col figure figcaption details summary time "
    "div span section article aside header footer main nav"
).split()
LEAST_CONTAINER, LEAST_PARAGRAPH, MOST_LINKS = 80, 20, 0.5
BLOCKS = "page_id long, block long, tag string, level long, content string, link_chars long, reason string, selector string, clean string, markup string, inside array<int>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            rows = [(page, i, tag, int(tag[1]) if tag[0] == "h" and tag[1:].isdigit() else None, *rest) for page, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for i, (tag, *rest) in enumerate(read_page(html))]
            columns = list(zip(*rows, strict=True)) or [()] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)


_TYPES = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
_ARROW = pa.schema([(c.split(" ")[0], _TYPES[c.split(" ")[1]]) for c in BLOCKS.split(", ")])


def _dealt(pages: DataFrame) -> DataFrame:
    """Pages over as many tasks as a shuffle has: to read one takes far longer than its bytes, and a file of a few row groups, as pages
    that are much alike compress to, would be read by as few tasks."""
    return pages.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("page_id", "html"))


def page_blocks(pages: DataFrame) -> DataFrame:
    """Every block of the pages with its tag, level, characters in links, and why it should go and by which element; table
    rows have their cells between bars.  ``clean`` and ``markup`` are its content after C6, as text and with inline elements; ``inside``
    ranks those of the page's five best candidates for the article (C2) that hold it.  Null and empty pages have none."""
    return _dealt(pages.select("page_id", "html")).mapInArrow(_parsed, BLOCKS)


def in_article(judged: DataFrame) -> DataFrame:
    """Of judged blocks (with their ``chars``) those in the best candidate that keeps ``LEAST_ARTICLE`` characters, or all of a page where none does."""
    page = Window.partitionBy("page_id")
    kept = F.when(F.col("reason").isNull(), F.col("chars")).otherwise(0)
    chars = lambda rank: F.sum(F.when(F.array_contains("inside", rank), kept)).over(page)
    best = F.coalesce(*(F.when(chars(r) >= LEAST_ARTICLE, F.lit(r)) for r in range(1, CANDIDATES + 1)))
    return judged.withColumn("best", best).where(F.col("best").isNull() | F.expr("array_contains(inside, best)")).drop("best")


def normalised(blocks: DataFrame) -> DataFrame:
    """No h1 (the title is the page's), h4 to h6 as h3, content without what spans of captions, shares and the like hold."""
    level = F.when(F.col("level") > 3, F.lit(3).cast("long")).otherwise(F.col("level"))
    tag = F.when(F.col("level") > 3, F.lit("h3")).otherwise(F.col("tag"))
    return blocks.where("coalesce(level, 0) <> 1").withColumns({"tag": tag, "level": level, "content": F.col("clean")}).where("content <> ''")


def heuristic_reason() -> Column:
    """Why a paragraph or container should go: little text, mostly links, or a start that is boilerplate."""
    n, small = F.length("content"), F.when(F.col("tag") == "div", LEAST_CONTAINER).when(F.col("tag") == "p", LEAST_PARAGRAPH)
    links = ratio(F.col("link_chars"), n) > MOST_LINKS
    known = F.col("content").rlike("(?iu)^(" + "|".join(BOILERPLATE) + ")")
    return F.when(small.isNotNull(), F.when(n < small, "low-text-density").when(links, "high-link-density").when(known, "boilerplate-pattern"))


def in_summary(blocks: DataFrame) -> DataFrame:
    """C4: blocks with in_section: a summary heading and what follows it up to a heading of its level or above."""
    order = Window.partitionBy("page_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    summary = trimmed(F.col("content")).rlike("(?iu)" + "|".join(SUMMARY_HEADINGS))
    inside = F.lit(False)
    for level in range(1, 7):
        opened = F.max(F.when((F.col("level") == level) & summary, F.col("block"))).over(order)
        inside = inside | F.coalesce(opened == F.max(F.when(F.col("level") <= level, F.col("block"))).over(order), F.lit(False))
    return blocks.withColumn("in_section", inside)


def judged_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of pages with the reason for which each goes; null for what stays."""
    rows = in_summary(page_blocks(pages))
    reason = F.coalesce("reason", F.when(F.col("in_section"), "summary-section"), heuristic_reason())
    return rows.select("page_id", "block", "tag", "level", "content", reason.alias("reason"), "selector", "clean", "markup", "inside")


def removal_log(pages: DataFrame) -> DataFrame:
    """C11: the blocks that go, each with its reason, the element that the rule fits and the first 50 characters."""
    gone = judged_blocks(pages).where("reason is not null")
    return gone.select("page_id", "block", "reason", F.coalesce("selector", "tag").alias("selector"), F.substring("content", 1, 50).alias("preview"))


def removals(pages: DataFrame) -> DataFrame:
    """C11: blocks that go for each reason, with their characters."""
    return judged_blocks(pages).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"), F.sum(F.length("content")).cast("long").alias("chars"))


def article_rows(pages: DataFrame) -> DataFrame:
    """The blocks of each page's article (page_id, block, type, level, content, markup): C1 to C5, C2, C6, B6.  A block that goes by
    itself is dropped where it was read, but for headings, which say where a summary ends; of content only its length is shuffled."""
    own = page_blocks(pages).withColumns({"reason": F.coalesce("reason", heuristic_reason()), "chars": F.length("content")}).where("reason is null or level is not null")
    judged = in_summary(own).withColumn("reason", F.when(F.col("in_section"), "summary-section").otherwise(F.col("reason")))
    kept = normalised(in_article(judged).where("reason is null"))
    kinds = F.when(F.col("level").isNotNull(), "heading").when(F.col("tag") == "pre", "code").when(F.col("tag") == "blockquote", "quote").when(F.col("tag") == "li", "list").otherwise("paragraph")
    return article_blocks(kept.select("page_id", "block", kinds.alias("type"), "level", "content", "markup"))


def articles(pages: DataFrame) -> DataFrame:
    """The article text of each page that has any left."""
    return plain_texts(article_rows(pages).withColumnRenamed("page_id", "doc_id")).withColumnRenamed("doc_id", "page_id")


def metadata() -> list[Column]:
    """Title (``Untitled`` without one), author and image of a page."""
    meta = lambda name: F.nullif(F.regexp_extract("html", rf'<meta[^>]*(?:property|name)="{name}"[^>]*content="([^"]*)"', 1), F.lit(""))
    title = F.nullif(F.regexp_replace(F.regexp_extract("html", r"<title>([^<]*)</title>", 1), r"^\s+|\s+$", ""), F.lit(""))
    return [F.coalesce(title, F.lit("Untitled")).alias("title"), meta("author").alias("author"), F.coalesce(meta("og:image"), meta("twitter:image")).alias("image")]


def unsafe_tags() -> Column:
    """Elements of a page outside the allowed ones, sorted, comma-joined."""
    tags = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), F.lower))
    return F.array_join(F.array_sort(F.array_except(tags, F.array(*map(F.lit, ALLOWED)))), ",")


def has_script_link() -> Column:
    """Whether a link runs a script."""
    return F.col("html").rlike(r"""(?i)href\s*=\s*["']?\s*javascript:""")
