"""Operator 8: URL filter by rules and a path-template tree. DataFrame functions only.

Rules decide first: a rule is a host and a path, fits that host and its subdomains where the url's path starts with the
rule's path, and the longest rule that fits wins.  Its verdict is also the label of the url in the tree.

The tree has a root for each host.  Level by level, from the left, a path segment becomes a branch:

* runs of digits become ``#``;
* a branch with under 1 / ``SPREAD`` of its parent's urls is a value, not a place, and becomes ``*``;
* a branch whose labelled share of blocked urls does not differ from that of its siblings together (two-proportion z under
  ``SIMILAR``) is merged with the others of its kind, as ``*``; a branch without labels, or without labelled siblings,
  cannot be compared and stays;
* what follows ``DEPTH`` segments is one segment.

A leaf is a template.  A node's purity is (blocked + PRIOR_WEIGHT * prior) / (labelled + PRIOR_WEIGHT).  The prior comes from the node above
it as far as that is labelled: its purity where all its urls have a label, its own prior where none has, in proportion between.
Above a host's tree stands its parent domain, where each host counts once, and above all domains the neutral share.  This is the mean of the labelled hosts'
blocked shares, half at most.  So templates without labels are judged by what surrounds them, one hot host moves only what is below it,
and where little is known nothing is rejected.  A url that no rule fits is blocked where its template's purity is ``REJECT`` or more.

Urls are counted by host and generalised path before anything else, so a host with a third of all urls is a few rows.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged as the empty host's
empty template; repeated rows count and are judged each; without labels nothing is rejected; an empty table gives no rows;
other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, materialised

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SPREAD, SIMILAR, PRIOR_WEIGHT, REJECT, DEPTH, NEUTRAL = 50, 1.96, 4.0, 0.75, 6, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path together, and its verdict; nulls where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def segments_of(path: Column) -> Column:
    """Segments with runs of digits as #; those beyond DEPTH as one."""
    parts = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), lambda s: s != "")
    return F.when(F.size(parts) <= DEPTH, parts).otherwise(F.concat(F.slice(parts, 1, DEPTH), F.array(F.lit("**"))))


def _purity(prior: Column) -> Column:
    return (F.col("blocked") + PRIOR_WEIGHT * prior) / (F.col("labelled") + F.lit(PRIOR_WEIGHT))


def _below(purity: Column, known: Column, prior: Column) -> Column:
    """The prior that a node gives to those below it."""
    return known * purity + (1.0 - known) * prior


def template_tree(paths: DataFrame) -> DataFrame:
    """(host, segments, template, purity) from (host, segments, n, labelled, blocked)."""
    counts = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    hosts = paths.groupBy("host").agg(*counts).withColumn("share", F.col("blocked") / F.nullif(F.col("labelled").cast("double"), F.lit(0.0)))
    neutral = min(NEUTRAL, hosts.agg(F.avg("share")).first()[0] or 0.0)
    hosts = hosts.withColumn("domain", F.when(F.instr("host", ".") > 0, F.expr("substring(host, instr(host, '.') + 1)")).otherwise(""))
    domains = hosts.groupBy("domain").agg(((F.coalesce(F.sum("share"), F.lit(0.0)) + F.lit(PRIOR_WEIGHT * neutral)) / (F.count("share") + F.lit(PRIOR_WEIGHT))).alias("purity"), F.avg(F.col("labelled") / F.col("n").cast("double")).alias("known"))
    above = hosts.join(domains.select("domain", _below(F.col("purity"), F.col("known"), F.lit(neutral)).alias("above")), "domain")
    above = above.select("host", _below(_purity(F.col("above")), F.col("labelled") / F.col("n").cast("double"), F.col("above")).alias("prior"))
    scratch = Scratch(paths.sparkSession)
    tree = paths.join(above, "host").withColumn("template", F.lit("")).withColumn("purity", F.col("prior"))
    deepest = paths.agg(F.max(F.size("segments"))).first()[0] or 0
    for level in range(1, deepest + 1):
        here = tree.withColumn("segment", F.get("segments", F.lit(level - 1)))
        branch = here.groupBy("host", "template", "segment").agg(*counts)
        parent = branch.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
        seen, rest = F.col("labelled").cast("double"), (F.col("all_labelled") - F.col("labelled")).cast("double")
        share, other = F.col("blocked") / F.nullif(seen, F.lit(0.0)), (F.col("all_blocked") - F.col("blocked")) / F.nullif(rest, F.lit(0.0))
        pooled = F.col("all_blocked") / F.nullif(F.col("all_labelled").cast("double"), F.lit(0.0))
        spread = F.sqrt(pooled * (1.0 - pooled) * (1.0 / F.nullif(seen, F.lit(0.0)) + 1.0 / F.nullif(rest, F.lit(0.0))))
        similar = F.coalesce(F.abs(share - other) <= F.lit(SIMILAR) * spread, F.lit(False))
        value = F.col("n") * SPREAD < F.col("all_n")
        step = F.when(F.col("segment").isNull(), F.lit("")).when(value | similar, F.lit("/*")).otherwise(F.concat(F.lit("/"), "segment"))
        named = branch.join(parent, ["host", "template"]).select("host", "template", "segment", step.alias("step"))
        on = (F.col("t.host") == F.col("b.host")) & (F.col("t.template") == F.col("b.template")) & F.col("t.segment").eqNullSafe(F.col("b.segment"))
        tree = here.alias("t").join(named.alias("b"), on).select("t.host", "t.segments", "t.n", "t.labelled", "t.blocked", "t.prior", "t.purity", F.concat("t.template", "b.step").alias("template"))
        tree = scratch.write(tree, f"url-level{level}")
        scratch.clear(keep=1)
        going = F.size("segments") >= level - 1  # the others ended above
        nodes = tree.where(going).groupBy("host", "template").agg(*counts, F.first("prior").alias("prior"))
        nodes = nodes.select("host", "template", _purity(F.col("prior")).alias("own"), _below(_purity(F.col("prior")), F.col("labelled") / F.col("n").cast("double"), F.col("prior")).alias("below"))
        tree = tree.join(nodes, ["host", "template"], "left").select("host", "segments", "n", "labelled", "blocked", "template", F.when(going, F.col("below")).otherwise(F.col("prior")).alias("prior"), F.when(going, F.col("own")).otherwise(F.col("purity")).alias("purity"))
    return tree


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """Per row: id, host, path, rule, verdict, template and its purity."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).select("id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.select("id", "host", "path", name.alias("rule"), verdict.alias("ruled"), segments_of(F.col("path")).alias("segments"))
    paths = parsed.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    tree = template_tree(materialised(paths, "url-paths"))
    method = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    placed = tree.select("host", "segments", "template", "purity")
    return parsed.join(placed, ["host", "segments"], "left").select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", "purity")


def oracle_sql(table: str = "pages", depth: int = DEPTH, rules=RULES) -> str:
    """The same in DuckDB SQL, for id, host, path, rule and verdict."""

    def case(column: int) -> str:
        whens = (f"when (host = '{r[0]}' or ends_with(host, '.{r[0]}')) and starts_with(path, '{r[1]}') then '{(r[0] + r[1], r[2])[column]}'" for r in sorted(rules, key=lambda r: -len(r[0] + r[1])))
        return f"case {' '.join(whens)} end"

    out = f"""
with cut as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from {table}),
parsed as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from cut),
ruled as (select *, {case(0)} as rule, {case(1)} as ruled, list_filter(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/'), lambda s: s <> '') as parts from parsed),
keyed as (select page_id, host, path, rule, ruled, case when len(parts) <= {depth} then parts else list_concat(parts[1:{depth}], ['**']) end as segments from ruled),
p0 as (select host, segments, count(*) as n, count(ruled) as labelled, count(*) filter (ruled = 'block') as blocked from keyed group by host, segments),
hosts as (select host, case when position('.' in host) > 0 then substr(host, position('.' in host) + 1) else '' end as domain, sum(n)::double as n, sum(labelled)::double as labelled, sum(blocked)::double as blocked, sum(blocked)::double / nullif(sum(labelled), 0) as share from p0 group by host),
neutral as (select least({NEUTRAL}, coalesce(avg(share), 0)) as g from hosts),
domains as (select domain, (coalesce(sum(share), 0) + {PRIOR_WEIGHT} * any_value(g)) / (count(share) + {PRIOR_WEIGHT}) as purity, avg(labelled / n) as known from hosts, neutral group by domain),
above as (select host, h.labelled, h.blocked, h.labelled / h.n as known, d.known * purity + (1 - d.known) * g as prior from hosts h join domains d using (domain), neutral),
t0 as (select p0.*, '' as template, known * (a.blocked + {PRIOR_WEIGHT} * prior) / (a.labelled + {PRIOR_WEIGHT}) + (1 - known) * prior as prior, 0.0 as purity from p0 join above a using (host))"""
    for k in range(1, depth + 2):
        out += f""",
h{k} as (select *, segments[{k}] as segment from t{k - 1}),
b{k} as (select host, template, segment, sum(n) as n, sum(labelled)::double as labelled, sum(blocked)::double as blocked from h{k} group by all),
c{k} as (select *, sum(n) over w as all_n, sum(labelled) over w as all_labelled, sum(blocked) over w as all_blocked from b{k} window w as (partition by host, template)),
d{k} as (select *, blocked / nullif(labelled, 0) as share, (all_blocked - blocked) / nullif(all_labelled - labelled, 0) as other, all_blocked / nullif(all_labelled, 0) as pooled from c{k}),
e{k} as (select host, template, segment, case when segment is null then '' when n * {SPREAD} < all_n or coalesce(abs(share - other) <= {SIMILAR} * sqrt(pooled * (1 - pooled) * (1 / nullif(labelled, 0) + 1 / nullif(all_labelled - labelled, 0))), false) then '/*' else '/' || segment end as step from d{k}),
u{k} as (select h.host, h.segments, h.n, h.labelled, h.blocked, h.prior, h.purity, h.template || e.step as template, len(h.segments) >= {k - 1} as going from h{k} h join e{k} e on h.host = e.host and h.template = e.template and h.segment is not distinct from e.segment),
v{k} as (select *, (sum(blocked) over w + {PRIOR_WEIGHT} * prior) / (sum(labelled) over w + {PRIOR_WEIGHT}) as own, sum(labelled) over w / sum(n) over w as known from u{k} window w as (partition by host, template, going)),
t{k} as (select host, segments, n, labelled, blocked, template, case when going then known * own + (1 - known) * prior else prior end as prior, case when going then own else purity end as purity from v{k})"""
    return (
        out
        + f"""
select k.page_id, k.host, k.path, k.rule, coalesce(k.ruled, case when p.purity >= {REJECT} then 'block' else 'allow' end) as verdict from keyed k left join t{depth + 1} p on k.host = p.host and k.segments = p.segments"""
    )
