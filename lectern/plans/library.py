"""Queries of identity, library, merge and annotations, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import annotations as J
from lectern.operators import identity as G
from lectern.operators import library as H
from lectern.operators import merge as M
from lectern.sources import bindings as B

ITEMS = """items as (select o_orderkey as id, o_custkey as user_id, p_name as title, case when o_orderkey % 5 <> 0 then c_name end as author, (['web', 'pdf', 'docx', 'epub', 'mobi', 'paste'])[o_orderkey % 6 + 1] as type, p_brand as source_label,
 o_orderdate::date as created, (o_orderdate::date + (o_orderkey % 90)::int) as last_opened, o_orderkey % 101 as percent, case when o_orderkey % 3 <> 0 then o_orderkey % 7 end as chapter, o_orderkey % 40 as block, floor(o_totalprice / 10)::bigint as word_count,
 case when o_orderkey % 6 between 1 and 4 then 'h' || (o_orderkey % 97) end as file_hash, case when o_orderkey % 6 = 0 then 'https://www.site' || (o_orderkey % 50) || '.example/p/' || (o_orderkey % 31) || '/?utm_source=x&id=' || (o_orderkey % 7) end as url,
 case when o_orderkey % 3 = 0 then [c_mktsegment, o_orderpriority] end as collection_ids from orders join customer on o_custkey = c_custkey join part on o_orderkey % 2000 = p_partkey)"""
NORMAL = "regexp_replace(regexp_replace({}, '^https://www\\.', 'https://'), '/\\?utm_source=x&', '?')"
NOTES = """notes as (select distinct concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::int, l_returnflag, l_linestatus, l_shipdate::date) as id, l_orderkey as doc_key, (['yellow', 'green', 'blue', 'pink', 'purple'])[l_partkey % 5 + 1] as color, l_linenumber::bigint as start_block, l_suppkey % 30 as start_word,
 (l_linenumber + l_partkey % 3)::bigint as end_block, case when l_returnflag = 'R' then 'note' end as note, l_linestatus = 'F' as favorite, case when l_partkey % 4 = 0 then [l_returnflag, l_linestatus] end as tags, l_shipdate::date as created, l_quantity from lineitem)"""


def _merged(source: str, key: str, name: str) -> str:
    """SQL of the merge of the rows of ``source`` that share user and ``key``."""
    far = "order by coalesce(chapter, 0) desc, block desc, percent desc, id"
    new = "order by last_opened desc, id"
    some = lambda c: f"first({c} order by id) filter ({c} is not null) as {c}" if c != key else c
    cols = ", ".join([f"first({c} {far}) as {c}" for c in ("id", "chapter", "block", "percent")] + [f"first({c} {new}) as {c}" for c in ("title", "author", "type", "source_label", "word_count")] + [some("file_hash"), some("url")])
    return f"{name} as (select user_id, {cols}, max(last_opened) as last_opened, min(created) as created, count(*) as merged_rows from {source} group by user_id, {key})"


_OUT = "user_id, id, title, author, type, source_label, created, last_opened, percent, chapter, block, word_count, file_hash, url"
DEDUP = f"""keyed as (select *, {NORMAL.format("url")} as url_key from items), hashed as (select * from keyed where file_hash is not null), linked as (select * from keyed where file_hash is null and url is not null),
{_merged("hashed", "file_hash", "by_hash")}, {_merged("linked", "url_key", "by_url")},
once as (select {_OUT}, merged_rows from by_hash union all select {_OUT}, merged_rows from by_url union all select {_OUT}, 1 as merged_rows from keyed where file_hash is null and url is null)"""
REPLICAS = "replicas as (select id, user_id, percent, chapter, block, last_opened, 0 as replica from items where id % 3 <> 0 union all select id, user_id, (percent + 17) % 101, chapter, (block + 5) % 40, case when id % 2 = 0 then last_opened + 1 else last_opened end, 1 from items where id % 3 <> 1)"
STONES = f"stones as (select distinct user_id, unnest([id::varchar, 'hash:' || file_hash, 'url:' || {NORMAL.format('url')}]) as key from items where id % 41 = 0)"


def replicas(s, d):
    items = B.archive_items(s, d)
    a = items.where("id % 3 <> 0").withColumn("replica", F.lit(0))
    b = items.where("id % 3 <> 1").withColumn("percent", (F.col("percent") + 17) % 101).withColumn("block", (F.col("block") + 5) % 40)
    b = b.withColumn("last_opened", F.when(F.col("id") % 2 == 0, F.date_add("last_opened", 1)).otherwise(F.col("last_opened"))).withColumn("replica", F.lit(1))
    return a, b


def _both(s, d):
    a, b = replicas(s, d)
    return a.unionByName(b)


def _gone(s, d):
    return H.deleted(B.archive_items(s, d), B.archive_items(s, d).where("id % 41 = 0").select("id"), B.AS_OF_LONG)


def _items(f):
    return lambda s, d: f(B.archive_items(s, d))


def _notes(f):
    return lambda s, d: f(B.annotations(s, d))


def _upserted(notes):
    return J.upserted(notes, notes.where("start_word % 7 = 0").select("id", F.lit("red"), F.lit("changed"), F.col("favorite")))


def _library(items):
    return H.library_query(items, query="a", types=("web", "books"), state="reading", long_reads=True, opened="year", as_of="1999-06-30").select("id", "user_id", "title")


QUERIES = {
    "g01_normalised_url": lambda s, d: B.table(s, d, "pages").select("page_id", G.normalised_url(F.col("url")).alias("url")),
    "g05_document_key": _items(lambda i: i.select("id", G.document_key(F.col("file_hash"), F.col("url"), F.col("title"), F.col("created")).alias("key"))),
    "g06_source_label": _items(lambda i: i.select("id", G.source_label(F.col("url"), F.col("file_hash"), F.col("type")).alias("label"), G.type_of_source(F.col("type")).alias("type"))),
    "g07_library_dedup": _items(G.deduplicated),
    "g08_duplicates_removed": _items(G.duplicates_removed),
    "h01_type_filter": _items(lambda i: H.of_types(i, "pdf", "books").select("id", "type")),
    "h02_sorted_page": _items(lambda i: H.page(i, "author", 50, 20).select("id", "author", "title")),
    "h05_status": _items(lambda i: i.select("id", H.status(F.col("percent")).alias("status"))),
    "h08_smart_collections": _items(lambda i: i.select("id", *(H.smart(n, "1999-06-30").alias(n.replace("-", "_")) for n in ("in-progress", "unread", "finished", "long-reads", "recent")))),
    "h09_library_query": _items(_library),
    "h10_facets": _items(H.facets),
    "h11_next_to_read": _items(H.next_to_read),
    "h16_deleted_items": lambda s, d: _gone(s, d)[0].select("id", "user_id"),
    "h16_tombstones": lambda s, d: _gone(s, d)[1].select("user_id", "key"),
    "h17_newest": _items(lambda i: H.newest(i, 5).select("user_id", "id")),
    "h20_content_breakdown": _items(H.content_breakdown),
    "h21_progress_breakdown": _items(H.progress_breakdown),
    "i01_in_collection": _items(lambda i: H.in_collection(i, "BUILDING").select("id")),
    "i02_changed_membership": _items(lambda i: H.changed_membership(i.withColumn("collections_stamp", F.col("created")), i.where("id % 5 > 0").select("id", F.element_at(F.array(*map(F.lit, ("add", "remove", "set", "toggle"))), (F.col("id") % 5).cast("int")).alias("kind"), F.array(F.lit("BUILDING"), F.lit("new")).alias("collection_ids")), "2001-09-01").select("id", F.array_join("collection_ids", ",").alias("collections"), "collections_stamp", "changed")),
    "j02_searched": _notes(lambda n: J.filtered(n, search=" No ").select("id", "doc_key")),
    "j03_by_date": _notes(lambda n: J.by_date(n.withColumn("user_id", F.col("doc_key") % 50))),
    "i02_membership": _items(lambda i: H.with_membership(i, i.where("id % 4 = 0").select("id", F.array(F.lit("new")).alias("add"), F.array(F.lit("BUILDING")).alias("remove")))),
    "i03_deleted_collection": _items(lambda i: H.without_collection(i, "BUILDING")),
    "f06_library_search": _items(lambda i: H.matching(i, "an").select("id", "title")),
    "m01_further_positions": lambda s, d: M.further_positions(_both(s, d), "user_id", "id"),
    "m02_further_progress": lambda s, d: M.further_progress(_both(s, d), "user_id", "id"),
    "m06_not_deleted": lambda s, d: M.not_deleted(B.archive_items(s, d), _gone(s, d)[1]).select("user_id", "id"),
    "m09_newest_rows": lambda s, d: M.newest_rows(_both(s, d), ["user_id", "id"], "last_opened").select("user_id", "id", "last_opened", "replica"),
    "m14_conflicts": lambda s, d: M.conflicts(*replicas(s, d), ["user_id", "id"], ["percent", "block", "last_opened"]),
    "m17_content_plan": lambda s, d: M.content_plan(*replicas(s, d)),
    "j02_filtered": _notes(lambda n: J.filtered(n, "blue", "R").select("id", "doc_key")),
    "j03_by_document": _notes(J.by_document),
    "j05_by_tag": _notes(J.by_tag),
    "j04_totals": _notes(J.totals),
    "j04_by_color": _notes(lambda n: J.by_color(n, B.PALETTE)),
    "j06_positions": _notes(J.positions),
    "j08_touching": _notes(J.touching),
    "j09_counted": lambda s, d: J.counted(B.archive_items(s, d), B.annotations(s, d)),
    "j10_upserted": _notes(lambda n: _upserted(n.groupBy("id").agg(F.min("color").alias("color"), F.min("note").alias("note"), F.min("start_word").alias("start_word"), F.max("favorite").alias("favorite")))),
}

_I = f"with {ITEMS}"
_N = f"with {NOTES}"
ORACLE_SQL = {
    "g05_document_key": f"{_I} select id, coalesce('hash:' || file_hash, 'url:' || {NORMAL.format('url')}, 'doc:' || title || '-' || created) as key from items",
    "g06_source_label": f"{_I} select id, coalesce(regexp_extract(url, '^https://www\\.([^/]*)', 1), file_hash, type) as label, type from items",
    "g07_library_dedup": f"{_I}, {DEDUP} select * from once",
    "g08_duplicates_removed": f"{_I}, {DEDUP} select user_id, sum(merged_rows - 1)::bigint as removed from once group by user_id",
    "h01_type_filter": f"{_I} select id, type from items where type in ('pdf', 'epub', 'mobi')",
    "h02_sorted_page": f"{_I} select id, author, title from items order by author nulls last, title, id limit 50 offset 20",
    "h05_status": f"{_I} select id, case when percent <= 0 then 'unread' when percent < 95 then 'reading' else 'finished' end as status from items",
    "h08_smart_collections": f"{_I} select id, percent > 0 and percent < 95 as in_progress, percent = 0 as unread, percent >= 95 as finished, word_count >= 10000 as long_reads, last_opened >= date '1999-06-23' as recent from items",
    "h09_library_query": f"{_I} select id, user_id, title from items where (contains(lower(title), 'a') or contains(lower(coalesce(author, '')), 'a') or contains(lower(source_label), 'a')) and type in ('web', 'epub', 'mobi') and percent > 0 and percent < 95 and word_count >= 10000 and last_opened >= date '1998-06-30'",
    "h10_facets": f"{_I} select 'type' as facet, type as value, count(*) as n from items group by type union all select 'collection', value, count(*) from (select unnest(collection_ids) as value from items) group by value",
    "h11_next_to_read": f"{_I} select user_id, id, row_number() over (partition by user_id order by percent = 0, case when percent > 0 then last_opened else created end desc, id) as rank from items where type = 'web' and percent < 95 qualify rank <= 3",
    "h16_deleted_items": f"{_I} select id, user_id from items where id % 41 <> 0",
    "h16_tombstones": f"{_I}, {STONES} select * from stones where key is not null",
    "h17_newest": f"{_I} select user_id, id from items qualify row_number() over (partition by user_id order by last_opened desc, id) <= 5",
    "h20_content_breakdown": f"{_I} select type, count(*) as n, floor(count(*) * 100::double / sum(count(*)) over () + 0.5)::bigint as percent from items group by type",
    "h21_progress_breakdown": f"{_I} select user_id, count(*) filter (percent >= 100) as completed, count(*) filter (percent > 0 and percent < 100) as in_progress, count(*) filter (percent <= 0) as unread from items group by user_id",
    "i01_in_collection": f"{_I} select id from items where list_contains(collection_ids, 'BUILDING')",
    "i02_changed_membership": f"""{_I}, c as (select id, created, list_sort(list_distinct(coalesce(collection_ids, []))) as b, ['BUILDING', 'new'] as g from items),
x as (select *, list_sort(case id % 5 when 1 then list_distinct(list_concat(b, g)) when 2 then list_filter(b, lambda x: not list_contains(g, x)) when 3 then g when 4 then list_concat(list_filter(b, lambda x: not list_contains(g, x)), list_filter(g, lambda x: not list_contains(b, x))) else b end) as a from c)
select id, case when len(a) > 0 then array_to_string(a, ',') end as collections, case when a <> b then date '2001-09-01' else created end as collections_stamp, a <> b as changed from x""",
    "j02_searched": f"{_N} select id, doc_key from notes where contains(lower(note), 'no') or len(list_filter(tags, lambda t: contains(lower(t), 'no'))) > 0",
    "j03_by_date": f"{_N} select doc_key % 50 as user_id, id, created, row_number() over (partition by doc_key % 50 order by created desc, start_block, start_word, id) as place from notes",
    "i02_membership": f"{_I}, c as (select id, list_sort(coalesce(collection_ids, [])) as b, case when id % 4 = 0 then list_sort(list_filter(list_distinct(list_concat(coalesce(collection_ids, []), ['new'])), lambda x: x <> 'BUILDING')) else list_sort(coalesce(collection_ids, [])) end as a from items) select id, case when len(a) > 0 then array_to_string(a, ',') end as collections, a <> b as changed from c",
    "i03_deleted_collection": f"{_I}, c as (select id, list_sort(list_filter(collection_ids, lambda x: x <> 'BUILDING')) as a from items) select id, case when len(a) > 0 then array_to_string(a, ',') end as collections from c",
    "f06_library_search": f"{_I} select id, title from items where contains(lower(title), 'an') or contains(lower(coalesce(author, '')), 'an') or contains(lower(source_label), 'an')",
    "m01_further_positions": f"{_I}, {REPLICAS} select user_id, id, chapter, block, last_opened from replicas qualify row_number() over (partition by user_id, id order by coalesce(chapter, 0) desc, block desc, last_opened desc, replica) = 1",
    "m02_further_progress": f"{_I}, {REPLICAS} select user_id, id, percent, replica from replicas qualify row_number() over (partition by user_id, id order by percent desc, replica) = 1",
    "m06_not_deleted": f"{_I}, {STONES} select user_id, id from items i where not exists (select 1 from stones s where s.user_id = i.user_id and s.key in (i.id::varchar, 'hash:' || i.file_hash, 'url:' || {NORMAL.format('i.url')}))",
    "m09_newest_rows": f"{_I}, {REPLICAS} select user_id, id, last_opened, replica from replicas qualify row_number() over (partition by user_id, id order by last_opened desc, replica desc) = 1",
    "m14_conflicts": f"{_I}, {REPLICAS}, j as (select a.user_id, a.id, concat_ws(',', case when a.percent is distinct from b.percent then 'percent' end, case when a.block is distinct from b.block then 'block' end, case when a.last_opened is distinct from b.last_opened then 'last_opened' end) as fields from replicas a join replicas b on a.user_id = b.user_id and a.id = b.id and a.replica = 0 and b.replica = 1) select * from j where fields <> ''",
    "m17_content_plan": f"{_I} select id, case when id % 3 = 1 then 'upload' when id % 3 = 0 then 'download' else 'keep' end as action from items",
    "j02_filtered": f"{_N} select id, doc_key from notes where color = 'blue' and list_contains(tags, 'R')",
    "j03_by_document": f"{_N} select doc_key, count(*) as n, max(created) as latest from notes group by doc_key",
    "j05_by_tag": f"{_N} select tag, count(*) as n from (select unnest(coalesce(tags, ['Untagged'])) as tag from notes) group by tag",
    "j04_totals": f"{_N} select count(*) as total, count(note) as with_notes, count(*) filter (favorite) as favorites, count(distinct doc_key) as documents from notes",
    "j04_by_color": f"{_N} select color, count(*) as n from notes group by color",
    "j06_positions": f"{_N} select doc_key, id, row_number() over (partition by doc_key order by start_block, start_word, id) as place from notes",
    "j08_touching": f"{_N} select doc_key, block, count(*) as n, min(id) as first_id from (select doc_key, id, unnest(range(start_block, end_block + 1)) as block from notes) group by all",
    "j09_counted": f"{_I}, {NOTES} select id, coalesce(n, 0) as annotation_count from items left join (select doc_key, count(*) as n from notes group by 1) on id = doc_key",
    "j10_upserted": f"{_N}, one as (select id, min(color) as color, min(note) as note, min(start_word) as start_word, bool_or(favorite) as favorite from notes group by id) select id, case when start_word % 7 = 0 then 'red' else color end as color, case when start_word % 7 = 0 then 'changed' else note end as note, case when start_word % 7 = 0 or note is not null then 'note' else 'highlight' end as type from one where not (start_word % 7 = 0 and favorite)",
}
