"""Library queries over archive items: filters, sorts, facets, candidates, retention, collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINISHED, LONG_READ, RETAINED = 95, 10_000, 200


def of_types(items: DataFrame, *types: str) -> DataFrame:
    """H1: items of the types; ``books`` are epub and mobi."""
    wanted = [t for name in types for t in (("epub", "mobi") if name == "books" else (name,))]
    return items.where(F.col("type").isin(*wanted))


def matching(items: DataFrame, query: str) -> DataFrame:
    """items with the query in title, author or source label, whatever the case."""
    q = query.lower()
    hit = [F.coalesce(F.lower(F.col(c)).contains(q), F.lit(False)) for c in ("title", "author", "source_label")]
    return items.where(hit[0] | hit[1] | hit[2])


def ordered(items: DataFrame, by: str, descending: bool = False) -> list[Column]:
    """H2: sort columns; titles and authors as a reader expects them (accents and case decide last), ties by id.  Only the order uses a
    collation; no key that is grouped or joined by does."""
    named = lambda c: F.collate(F.col(c), "UNICODE")
    if by == "author":
        return [named(by).desc_nulls_last() if descending else named(by).asc_nulls_last(), named("title").asc(), F.asc("id")]
    if by in ("progress", "word_count"):
        return [F.desc("percent" if by == "progress" else by), named("title").asc(), F.asc("id")]
    key = named(by) if by == "title" else F.col(by)
    return [key.desc() if descending else key.asc(), F.asc("id")]


def with_notes(items: DataFrame, notes: DataFrame) -> DataFrame:
    """H6: items that have an annotation (id of the item)."""
    return items.join(notes.select("id"), "id", "left_semi")


def page(items: DataFrame, by: str, limit: int, offset: int = 0, descending: bool = False) -> DataFrame:
    """H3: one page of the sorted items; the limit is the feature."""
    return items.orderBy(*ordered(items, by, descending)).offset(offset).limit(limit)


def status(percent: Column) -> Column:
    """H5: unread, reading or finished."""
    p = F.coalesce(percent, F.lit(0))
    return F.when(p <= 0, "unread").when(p < FINISHED, "reading").otherwise("finished")


def date_cutoff(preset: str, as_of: str) -> Column:
    """H7: first day of today, week, month or year."""
    day = F.lit(as_of).cast("date")
    return {"today": day, "week": F.date_sub(day, 7), "month": F.add_months(day, -1), "year": F.add_months(day, -12)}[preset]


def smart(name: str, as_of: str) -> Column:
    """H8: predicate of a smart collection."""
    p = F.coalesce(F.col("percent"), F.lit(0))
    return {
        "in-progress": (p > 0) & (p < FINISHED), "unread": p == 0, "finished": p >= FINISHED, "long-reads": F.col("word_count") >= LONG_READ, "recent": F.col("last_opened") >= date_cutoff("week", as_of),
    }[name]


def library_query(items: DataFrame, *, query: str = "", types: tuple[str, ...] = (), collection: str | None = None, smart_name: str | None = None, state: str | None = None, long_reads: bool = False, opened: str | None = None, as_of: str) -> DataFrame:
    """H9: all filters together; a smart collection turns off the status and long-read filters."""
    out = matching(items, query) if query else items
    out = of_types(out, *types) if types else out
    out = out.where(F.array_contains("collection_ids", collection)) if collection else out
    if smart_name:
        out = out.where(smart(smart_name, as_of))
    else:
        out = out.where(status(F.col("percent")) == state) if state else out
        out = out.where(F.col("word_count") >= LONG_READ) if long_reads else out
    return out.where(F.col("last_opened") >= date_cutoff(opened, as_of)) if opened else out


def facets(items: DataFrame) -> DataFrame:
    """Items of each type and of each collection."""
    types = items.groupBy(F.col("type").alias("value")).agg(F.count("*").alias("n")).select(F.lit("type").alias("facet"), "value", "n")
    bridge = items.select(F.explode("collection_ids").alias("value"))
    return types.unionByName(bridge.groupBy("value").agg(F.count("*").alias("n")).select(F.lit("collection").alias("facet"), "value", "n"))


def next_to_read(items: DataFrame, top: int = 3) -> DataFrame:
    """Each user's web items in progress, opened last first, before the unread ones, added last first."""
    web = items.where((F.col("type") == "web") & (F.col("percent") < FINISHED))
    reading = F.col("percent") > 0
    rank = Window.partitionBy("user_id").orderBy(F.when(reading, 0).otherwise(1), F.desc(F.when(reading, F.col("last_opened")).otherwise(F.col("created"))), "id")
    return web.withColumn("rank", F.row_number().over(rank).cast("long")).where(F.col("rank") <= top).select("user_id", "id", "rank")


def deleted(items: DataFrame, gone: DataFrame, at: str | None) -> tuple[DataFrame, DataFrame]:
    """The items without those of ``gone`` (id, or user_id and id), and the tombstones of these: by id, hash and url."""
    from lectern.operators.identity import normalised_url

    by = list(gone.columns)
    kept = items.join(gone, by, "left_anti")
    keys = F.array(F.col("id").cast("string"), F.concat(F.lit("hash:"), F.col("file_hash")), F.concat(F.lit("url:"), normalised_url(F.col("url"))))
    stones = items.join(gone, by, "left_semi").select("user_id", F.explode(keys).alias("key")).where("key is not null").distinct()
    return kept, stones.withColumn("deleted_at", F.lit(at).cast("date"))


def newest(items: DataFrame, keep: int = RETAINED) -> DataFrame:
    """The newest items of each user, as many as the library keeps."""
    rank = Window.partitionBy("user_id").orderBy(F.desc("last_opened"), "id")
    return items.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= keep).drop("rank")


def content_breakdown(items: DataFrame) -> DataFrame:
    """Items and percent of each type."""
    n = items.groupBy("type").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(total).select("type", "n", F.floor(F.col("n") * 100 / F.col("total") + 0.5).cast("long").alias("percent"))


def progress_breakdown(items: DataFrame) -> DataFrame:
    """Each user's completed, started and unread items; complete is 100 here."""
    p = F.coalesce(F.col("percent"), F.lit(0))
    return items.groupBy("user_id").agg(F.count_if(p >= 100).alias("completed"), F.count_if((p > 0) & (p < 100)).alias("in_progress"), F.count_if(p <= 0).alias("unread"))


def in_collection(items: DataFrame, collection: str) -> DataFrame:
    """Items of a collection."""
    return items.where(F.array_contains("collection_ids", collection))


def with_membership(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Collection ids after changes (id, add, remove); an empty list is null, and changed says whether it differs."""
    now = F.coalesce("collection_ids", F.array().cast("array<string>"))
    after = F.array_sort(F.array_except(F.array_union(now, F.coalesce("add", F.array().cast("array<string>"))), F.coalesce("remove", F.array().cast("array<string>"))))
    joined = items.join(changes, "id", "left").select("id", F.array_sort(now).alias("now"), after.alias("after"))
    return joined.select("id", F.when(F.size("after") > 0, F.array_join("after", ",")).alias("collections"), (F.col("now") != F.col("after")).alias("changed"))


def changed_membership(items: DataFrame, changes: DataFrame, at: str) -> DataFrame:
    """Items (id, collection_ids, collections_stamp) after changes (id, kind, collection_ids), whose kind is ``add``, ``remove``, ``set`` or
    ``toggle``: ids in order, null for none.  The stamp becomes ``at`` where the collections differ from before, and stays elsewhere.  Of
    several changes to an item the greatest (kind, ids) counts; a null list is an empty one."""
    none = F.array().cast("array<string>")
    given = changes.groupBy("id").agg(F.max(F.struct("kind", F.coalesce("collection_ids", none).alias("ids"))).alias("c"))
    now, ids = F.array_distinct(F.coalesce("collection_ids", none)), F.coalesce("c.ids", none)
    union, less = F.array_union(now, ids), F.array_except(now, ids)
    after = F.when(F.col("c.kind") == "add", union).when(F.col("c.kind") == "remove", less).when(F.col("c.kind") == "set", F.array_distinct(ids)).when(F.col("c.kind") == "toggle", F.array_union(less, F.array_except(ids, now))).otherwise(now)
    joined = items.join(given, "id", "left").select("id", F.array_sort(now).alias("now"), F.array_sort(after).alias("after"), "collections_stamp")
    changed = F.col("now") != F.col("after")
    return joined.select("id", F.when(F.size("after") > 0, F.col("after")).alias("collection_ids"), F.when(changed, F.lit(at).cast("date")).otherwise(F.col("collections_stamp")).alias("collections_stamp"), changed.alias("changed"))


def without_collection(items: DataFrame, collection: str) -> DataFrame:
    """Items after a collection is deleted; an empty list is null."""
    left = F.array_remove("collection_ids", collection)
    return items.select("id", F.when(F.size(left) > 0, F.array_join(F.array_sort(left), ",")).alias("collections"))


def cache_stats(items: DataFrame) -> DataFrame:
    """Each user's items, those with cached content (column cached), and candidates for caching."""
    wanted = next_to_read(items.where("not cached")).groupBy("user_id").agg(F.count("*").alias("candidates"))
    n = items.groupBy("user_id").agg(F.count("*").alias("items"), F.count_if("cached").alias("cached_items"))
    return n.join(wanted, "user_id", "left").select("user_id", "items", "cached_items", F.coalesce("candidates", F.lit(0)).alias("candidates"))


def book_progress(positions: DataFrame, chapters: DataFrame) -> DataFrame:
    """Percent and label of positions (book, chapter, block, blocks) by the words of the chapters (book, chapter, words);
    books of one chapter or no words go by blocks."""
    before = Window.partitionBy("book").orderBy("chapter").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("book")
    placed = chapters.select("book", "chapter", "words", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("earlier"), F.sum("words").over(whole).alias("total"), F.count("*").over(whole).alias("chapters"))
    share = F.coalesce(F.try_divide((F.col("block") + 1).cast("double"), F.col("blocks").cast("double")), F.lit(0.0))
    book = (F.col("chapters") > 1) & (F.col("total") > 0)
    percent = F.floor(F.when(book, F.try_divide(F.col("earlier") + F.col("words") * share, F.col("total").cast("double"))).otherwise(share) * 100 + 0.5).cast("long")
    out = positions.join(placed, ["book", "chapter"]).select("book", "chapter", "chapters", percent.alias("percent"))
    label = F.when(F.col("chapters") > 1, F.concat(F.lit("Ch "), (F.col("chapter") + 1).cast("string"), F.lit(" of "), F.col("chapters").cast("string"), F.lit(" ("), F.col("percent").cast("string"), F.lit("%)")))
    return out.select("book", "chapter", "percent", F.coalesce(label, F.concat(F.col("percent").cast("string"), F.lit("%"))).alias("label"))


def touched(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Items after changes (id, opened_at, new_block, new_percent); what a change leaves null stays."""
    j = items.join(changes, "id", "left")
    return j.select("id", "user_id", F.greatest("last_opened", "opened_at").alias("last_opened"), F.coalesce("new_block", "block").alias("block"), F.coalesce("new_percent", "percent").alias("percent"))


def sync_status(type_: Column, cached: Column, url: Column, pasted: Column) -> Column:
    """Files are synced with cached content, pages with a URL, pasted texts with their text."""
    has = F.when(type_.isin("pdf", "epub", "mobi", "docx"), F.coalesce(cached, F.lit(False))).when(type_ == "web", F.coalesce(url, F.lit("")) != "").when(type_ == "paste", F.coalesce(pasted, F.lit("")) != "")
    return F.when(has, "synced").when(~has, "not-synced").otherwise("not-applicable")


def suggestions(items: DataFrame, query: str, top: int = 8) -> DataFrame:
    """the first ``top`` distinct titles, authors and sources of each user that contain the query; none under two characters.
    The limit is the feature."""
    q = query.strip().lower()
    fields = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(c).alias("kind"), F.col(c).alias("text")) for i, c in enumerate(("title", "author", "source_label"))))
    rows = items.select("user_id", "id", "last_opened", F.explode(fields).alias("f")).where(F.lower("f.text").contains(q) & F.lit(len(q) >= 2))
    order = F.struct(-F.unix_date("last_opened"), "id", "f.place")
    once = rows.groupBy("user_id", F.col("f.text").alias("text")).agg(F.min(order).alias("first"), F.min_by("f.kind", order).alias("kind"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("first", "text")).cast("long")
    return once.select("user_id", "kind", "text", rank.alias("place")).where(F.col("place") <= top)


def collection_catalog(users: DataFrame, collections: DataFrame, defaults: tuple[str, ...]) -> DataFrame:
    """I4: each user's collections (user_id, name), or the defaults where the user has none."""
    own = collections.select("user_id", "name").distinct()
    without = users.join(own, "user_id", "left_anti").select("user_id", F.explode(F.array(*map(F.lit, defaults))).alias("name"))
    return own.unionByName(without)
