"""Secret scans by corpus-wide ownership frequency, in DataFrame operations only.

Base patterns give spans of three kinds. A fourth kind, ``opaque``, is a weaker candidate: a long
run of letters and digits in both cases outside every base span. Each candidate's value is
hashed; per hash the distinct repositories and owners that hold it are counted over the whole
corpus. A value that several owners hold is a copied example; a value of few owners that looks
live stays a secret, and only such opaque candidates become spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithofig.llm.shared import materialize

# The patterns of the kinds, the group that is the value, and its least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
OPAQUE = r"[A-Za-z0-9+/_-]{24,}"
KINDS = ["assign", "access", "hex", "opaque"]
#: Values that so many owners or more hold are examples.
EXAMPLE_OWNERS = 3


def _matches(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Spans of one kind as structs, by the lengths of the matches and of the text between them."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))
    kind_of = "array<struct<start:int,kind:int,stop:int,value:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind_of).alias("found"))

    def step(s: Column, m: Column) -> Column:
        begin = s["at"] + F.length(m["gap"])
        end = begin + F.coalesce(F.length(m["whole"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("stop"), m["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(m["whole"].isNotNull() & (F.length(m["value"]) >= least), F.concat(s["found"], F.array(span))).otherwise(s["found"]).alias("found"))

    spans = F.aggregate(zipped, start, step)["found"]
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(F.array().cast(kind_of))


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per row of ``docs``: base spans, all spans and how many candidates are live.

    Columns ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example``. Spans
    are of the whole match, in code points with the end exclusive, in order of their start. Null
    texts count as empty; a null owner is an owner of its own; each document is a repository.
    Repeated rows are each returned, and count once as a repository. An empty table gives an
    empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("\0")).alias("owner"), F.xxhash64(text).alias("h"),
        _matches(text, ASSIGN, 0, 2, 12).alias("assign"), _matches(text, ACCESS, 1, 0, 18).alias("access"),
        _matches(text, HEX, 2, 0, 16).alias("hex"), _matches(text, OPAQUE, 3, 0, 24).alias("weak"))
    base = F.concat("assign", "access", "hex")
    clear = F.filter("weak", lambda w: F.regexp_like(w["value"], F.lit("[0-9]")) & F.regexp_like(w["value"], F.lit("[a-z]")) & F.regexp_like(w["value"], F.lit("[A-Z]"))
                     & ~F.exists(F.col("base"), lambda b: (b["start"] < w["stop"]) & (w["start"] < b["stop"])))
    hashed = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), F.sha2(s["value"], 256).alias("value")))
    found = found.withColumn("base", base).withColumn("weak", hashed(clear)).withColumn("base", hashed(F.col("base")))
    found = materialize(found.select("doc_id", "owner", "h", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], "base", "weak"))

    each = found.select("doc_id", "owner", "h", F.explode(F.concat("base", "weak")).alias("s"))
    holders = each.select("s.value", "owner", "doc_id").groupBy("value", "owner", "doc_id").agg(F.lit(1).alias("one"))
    by_owner = holders.groupBy("value", "owner").agg(F.count("*").alias("repositories"))
    known = by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    judged = each.select("doc_id", "h", "s", "s.value").distinct().join(known, "value")
    live = (F.col("owners") < example_owners)
    per_doc = judged.groupBy("doc_id", "h").agg(
        F.sum(live.cast("long")).alias("n_live"), F.sum((~live).cast("long")).alias("n_example"),
        F.collect_list(F.when(live & (F.col("s.kind") == 3), F.col("s"))).alias("more"))
    some = F.size(F.concat("base", "weak")) > 0
    none = found.where(~some).select("*", F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_example"), F.array().cast(found.schema["weak"].dataType).alias("more"))
    with_some = found.where(some).alias("f").join(per_doc.alias("p"), F.col("f.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("f.h") == F.col("p.h"))).select("f.*", "n_live", "n_example", "more")
    return with_some.union(none).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.concat("base", "more")).alias("spans"), "n_live", "n_example")


#: The same in DuckDB: gaps and matches give positions, values are counted by owner.
ORACLE_SQL = """
with docs as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text, coalesce(source, chr(0)) as owner from documents
), kinds as (
  select 0 as kind, 'assign' as name, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)' as pat, 12 as least
  union all select 1, 'access', '(AKIA[A-Z0-9]{14,})', 18
  union all select 2, 'hex', '([0-9a-f]{16,})', 16
  union all select 3, 'opaque', '([A-Za-z0-9+/_-]{24,})', 24
), cut as (
  select rid, doc_id, owner, kind, name, least, regexp_split_to_array(text, pat) as gaps, regexp_extract_all(text, pat, 0) as whole, regexp_extract_all(text, pat, 1) as vals
  from docs, kinds where regexp_matches(text, pat)
), numbered as (
  select rid, doc_id, owner, kind, name, least, unnest(range(1, len(whole) + 1)) as i, unnest(whole) as w, unnest(vals) as v, unnest(gaps[1:len(whole)]) as g from cut
), placed as (
  select *, sum(length(g) + length(w)) over (partition by rid, kind order by i) as stop from numbered
), spans as (
  select rid, doc_id, owner, kind, name, (stop - length(w))::bigint as start, stop::bigint as stop, v from placed where length(v) >= least
), weak as (
  select * from spans s where kind = 3 and regexp_matches(v, '[0-9]') and regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]')
  and not exists (select 1 from spans b where b.rid = s.rid and b.kind < 3 and b.start < s.stop and s.start < b.stop)
), cand as (
  select * from spans where kind < 3 union all select * from weak
), known as (
  select v, count(distinct owner) as owners from cand group by v
), judged as (
  select c.*, owners < 3 as live from cand c join known using (v)
), summed as (
  select rid, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
    string_agg(name || ':' || start || ':' || stop, ',' order by start, kind) filter (kind < 3) as base,
    string_agg(name || ':' || start || ':' || stop, ',' order by start, kind) filter (kind < 3 or live) as spans,
    count(*) filter (live) as n_live, count(*) filter (not live) as n_example
  from judged group by rid
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example
from docs left join summed using (rid)
"""
