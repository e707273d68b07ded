"""The operators of this package as registered queries, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithofig.llm.decontaminate import find_leaks
from lithofig.llm.jaccard_join import jaccard_join
from lithofig.llm.language_id import fit_language_model, identify_language
from lithofig.llm.mixing import mix_sources
from lithofig.llm.quality_crf import fit_line_field, score_quality
from lithofig.llm.secret_scan import ORACLE_SQL as SECRET_SQL
from lithofig.llm.secret_scan import scan_secrets
from lithofig.llm.shared import id_text
from lithofig.llm.token_counts import section_token_counts
from lithofig.llm.token_records import token_records
from lithofig.llm.url_rules import judge_urls
from lithofig.llm.vector_dedup import near_duplicate_vectors

END_ID = 1
# The rules that the url query judges by (host, path, verdict).
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_records(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), 0.93)


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(_table(spark, sf_dir, "pages"), rules)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fold = F.coalesce(F.pmod(id_text("doc_id"), F.lit(3)) == 1, F.lit(False))
    model = fit_language_model(docs.where(~fold))
    return identify_language(docs.select("doc_id", fold.alias("held_out"), "text"), model)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    fold = F.coalesce(F.pmod(id_text("doc_id"), F.lit(5)) == 0, F.lit(False))
    field = fit_line_field(docs, labels.where(~fold))
    return score_quality(docs.select("doc_id", fold.alias("held_out"), "text"), field)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return section_token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (op1_token_records, op2_vector_dedup, op3_url_rules, op4_language_id, op5_secret_scan, op6_mixing, op7_jaccard_join, op8_quality, op9_token_counts, op10_decontaminate)
}

#: Every pair of equal labels: right, and for small tables only.
VECTOR_SQL = """
with recursive good as (
  select vec_id, label, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings
  where label is not null and embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93
), reach(node, root) as (
  select vec_id, vec_id from embeddings union select l.b, r.root from reach r join links l on l.a = r.node
), roots as (
  select node, min(root) as root from reach group by node
), degree as (
  select a, count(distinct b) as n from links group by a
)
select vec_id, coalesce(n, 0)::bigint as n_links, root as component_id, vec_id = root as kept
from embeddings left join degree on a = vec_id left join roots on node = vec_id
"""

URL_SQL = """
with rules(rhost, rpath, verdict) as (
  values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), cut as (
  select page_id, case when contains(coalesce(url, ''), '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), parts as (
  select row_number() over () as rid, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut
), fits as (
  select rid, rhost || rpath as rule, verdict, row_number() over (partition by rid order by length(rhost || rpath) desc, length(rhost) desc) as place,
    count(*) over (partition by rid) as depth
  from parts join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict, coalesce(depth, 0)::integer as depth
from parts left join fits on fits.rid = parts.rid and place = 1
"""

MIX_SQL = """
with recursive sized as (
  select doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents
), keyed as (
  select *, -ln((('0x' || substr(md5('mix' || coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0) / (0.5 + 0.5 * least(size, 100) / 100.0) as key from sized
), sources as (
  select source, sum(size)::bigint as source_size, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint] as w from keyed group by source
), fill(step, level) as (
  select 0, 1.5 * (select sum(source_size) from sources) / (select sum(w) from sources)
  union all
  select step + 1, (1.5 * (select sum(source_size) from sources) - coalesce((select sum(2.0 * source_size) from sources where level * w > 2.0 * source_size), 0))
    / (select sum(w) from sources where level * w <= 2.0 * source_size)
  from fill where step < 40 and exists (select 1 from sources where level * w <= 2.0 * source_size)
), plan as (
  select *, least(2.0 * source_size, (select max(level) from fill) * w) as target from sources
), epochs as (
  select *, floor(target / source_size) as e, target - floor(target / source_size) * source_size as rest from plan
), placed as (
  select k.*, p.source_size, p.target, p.e, p.rest, sum(size) over (partition by k.source order by key, doc_id, size rows unbounded preceding) as stop
  from keyed k join epochs p on k.source is not distinct from p.source
)
select doc_id, size, source_size, target, (size * (e + (case when stop - rest <= rest - (stop - size) then 1 else 0 end)))::bigint as taken,
  (e + (case when stop - rest <= rest - (stop - size) then 1 else 0 end))::bigint as copies
from placed
"""

ORACLES = {"op2_vector_dedup": VECTOR_SQL, "op3_url_rules": URL_SQL, "op5_secret_scan": SECRET_SQL, "op6_mixing": MIX_SQL}
