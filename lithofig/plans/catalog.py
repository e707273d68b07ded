"""Queries registered for the driver, each with its SQL where SQL can express it.

The driver's tables hold no papers, so several queries read tables that are derived from them by
SQL text that both engines run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithofig.functions import rules
from lithofig.operators import latex, layout, match, vectors
from lithofig.sources import readers, writers

QUERIES: dict = {}
ORACLES: dict = {}

LATEX_DOCS = """select doc_id as paper_id, concat(
 chr(92),'documentclass{article}',chr(10),chr(92),'begin{document}',chr(10),chr(10),
 translate(substr(coalesce(text,''),1,300),'{}',''),chr(10),chr(10),
 chr(92),'begin{figure}',chr(10),chr(92),'caption{Figure ',cast(doc_id%9+1 as varchar(20)),': ',
   translate(substr(coalesce(text,''),1,60),'{}',''),'}',chr(10),
 chr(92),'label{fig:',cast(doc_id as varchar(20)),'}',chr(10),chr(92),'end{figure}',chr(10),chr(10),
 'See ',case when doc_id%4=0 then 'nothing'
             else concat(chr(92),'ref{fig:',cast(doc_id as varchar(20)),'}') end,
 case when doc_id%3=0 and doc_id%4<>0
      then concat(' and ',chr(92),'ref{fig:',cast(doc_id as varchar(20)),'}') else '' end,
 ' with ',cast(doc_id%7+2 as varchar(20)),' qubits and a cnot gate. ',
 translate(substr(coalesce(text,''),301),'{}',''),chr(10),chr(10),'End.',chr(10),
 chr(92),'end{document}') as content
from documents"""
LAYOUT_ITEMS = """select *, cast(row_number() over (partition by page_no order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as int) as item_ord from (
 select l_orderkey as page_no, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
 case when l_linenumber%2=1 then 'picture' else 'caption' end as kind,
 cast(l_quantity*10 as bigint) as t, cast(l_quantity*10 as bigint)-40 as b from lineitem) x"""
PAPER_META = """select doc_id as paper_id, case doc_id%4 when 0 then array('quant-ph') when 1 then array('cs.LG','quant-ph.x') when 2 then array('cs.LG') else array('hep-th','math.QA') end as categories,
 case when doc_id%10=0 then null else concat('https://e/', cast(doc_id as varchar(20))) end as source_url from documents"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _derived(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    _table(spark, sf_dir, name).createOrReplaceTempView(f"lithofig_{name}")
    return spark.sql(sql.replace(f"from {name}", f"from lithofig_{name}").replace("\\", "\\\\"))


def _latex_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, LATEX_DOCS, "documents")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query()
def clean_embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", rules.clean_for_embeddings(F.col("text")).alias("cleaned"))



CAPTION_SQL = r'''
with a as (select paper_id, lower(content) as t from (DOCS)),
b as (select paper_id, regexp_replace(regexp_replace(t, '\\ref\{[^}]*fig[^}]*\}', '<Reference>', 'g'), '\$.*?\$', '', 'gs') as t from a),
c as (select paper_id, regexp_replace(regexp_replace(regexp_replace(t, '\\[a-zA-Z]+\{.*?\}', '', 'g'), '\\[\pL\pN_]+\(.*?\)', '', 'g'), '\\\S+', '', 'g') as t from b),
d as (select paper_id, replace(replace(replace(replace(t, '-' || chr(10), ' '), chr(10), ' '), '-', ' '), '^', '') as t from c),
e as (select paper_id, replace(replace(replace(replace(regexp_replace(t, '[`_|{}~%&$()\[\]§=,+]', ' ', 'g'), chr(39), ''), chr(34), ''), '!', ' .'), ' ?', ' .') as t from d)
select paper_id, trim(regexp_replace(regexp_replace(t, ' {2,}', ' ', 'g'), '(?i)fig\.\s+', '', 'g')) as cleaned from e'''.replace("DOCS", LATEX_DOCS)


@query(CAPTION_SQL)
def clean_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latex_docs(spark, sf_dir).select("paper_id", rules.clean_caption(F.col("content")).alias("cleaned"))


@query(r"""
with s as (select doc_id, unnest(list_filter(string_split(replace(replace(text, ' !', ' .'), ' ?', ' .'), ' .'), lambda x: x <> '')) as s from documents),
w as (select doc_id, list_filter(string_split(regexp_replace(translate(s, '%&$()[]§=,', ''), '^\s+|\s+$', '', 'g'), ' '), lambda x: regexp_full_match(x, '[\pL\pN]+')) as w from s)
select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_sentences, 0)::bigint as n_sentences
from documents d left join (select doc_id, sum(len(w)) as n_words, count(*) as n_sentences from w group by doc_id) using (doc_id)""")
def sentenize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", rules.sentenize(F.col("text")).alias("s"))
    return docs.select("doc_id", F.aggregate("s", F.lit(0).cast("long"), lambda n, w: n + F.size(w)).alias("n_words"), F.size("s").cast("long").alias("n_sentences"))


@query(r"""select item_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower('Figure 3: ' || text), '\b(?:fig|figure)\s+\d+\s*:?', '', 'g'), '[^\pL\pN_\s]', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') as normalized from benchmark""")
def normalize_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "benchmark")
    return rows.select("item_id", rules.normalize_caption(F.concat(F.lit("Figure 3: "), "text")).alias("normalized"))


@query()
def latex_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latex_docs(spark, sf_dir).select("paper_id", rules.latex_text(F.col("content")).alias("cleaned"))


@query()
def latex_chain_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latex_docs(spark, sf_dir).select("paper_id", rules.latex_text_compat(F.col("content")).alias("cleaned"))


@query()
def pdf_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", rules.page_text(F.col("text"), F.col("doc_id") % 3 + 1).alias("cleaned"))


@query(r"""select doc_id as id, regexp_replace(regexp_replace(text, 'http\S+', ' hrefl ', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', ' email ', 'g') as marked from documents
union all select page_id, regexp_replace(url, 'http\S+', ' hrefl ', 'g') from pages""")
def placeholder_email_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").union(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return both.select("id", rules.fold(F.col("text"), rules.PLACEHOLDERS).alias("marked"))


@query(f"""select paper_id, regexp_extract(c, '(?i)(?:Figure|Fig\\.?)\\s*(\\d+)', 1) as figure_number,
regexp_replace(regexp_replace(c, '(?i)^(?:Figure|Fig\\.?)\\s*\\d+[:.\\s-]*\\s*', ''), '^\\s+|\\s+$', '', 'g') as caption
from (select paper_id, regexp_extract(content, '\\\\caption\\{{([^}}]*)\\}}', 1) as c from ({LATEX_DOCS}))""")
def figure_number_and_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = latex.figure_blocks(_latex_docs(spark, sf_dir))
    return blocks.select("paper_id", rules.figure_number(F.col("caption")).alias("figure_number"), rules.strip_figure_prefix(F.col("caption")).alias("caption"))


BLOCK_SQL = f"""select paper_id, 0 as block_ord, regexp_replace(regexp_extract(content, '\\\\caption\\{{([^}}]*)\\}}', 1), '^\\s+|\\s+$', '', 'g') as caption, regexp_extract(content, '\\\\label\\{{([^}}]+)\\}}', 1) as label from ({LATEX_DOCS})"""


@query(BLOCK_SQL)
def figure_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latex.figure_blocks(_latex_docs(spark, sf_dir))


@query(BLOCK_SQL)
def figure_blocks_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latex.figure_blocks(_latex_docs(spark, sf_dir), exact=False)


@query(f"select paper_id, 0 as label_ord, regexp_extract(content, '\\\\label\\{{([^}}]+)\\}}', 1) as label from ({LATEX_DOCS})")
def figure_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latex.all_labels(_latex_docs(spark, sf_dir))


PARAGRAPH_SQL = f"""
with docs as ({LATEX_DOCS}), parts as (
  select paper_id, unnest(string_split(content, chr(10) || chr(10))) as p, generate_subscripts(string_split(content, chr(10) || chr(10)), 1) as k from docs
), placed as (
  select paper_id, k, p, coalesce(sum(length(p) + 2) over (partition by paper_id order by k rows between unbounded preceding and 1 preceding), 0) as s from parts
), refs as (
  select paper_id, k, unnest(regexp_extract_all(p, '\\\\ref\\{{(.*?)\\}}', 1)) as label, (s + case when k > 1 then length(regexp_extract(p, '^(\\n*)', 1)) else 0 end)::integer as start,
    (s + length(p))::integer as stop, regexp_replace(p, '^\\s+|\\s+$', '', 'g') as description from placed
)"""


@query(PARAGRAPH_SQL + " select paper_id, label, start, stop, description from refs")
def ref_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latex.references(_latex_docs(spark, sf_dir)).drop("ref_ord")


@query(PARAGRAPH_SQL + " select paper_id, label, min(start) as start, min(stop) as stop, min(description) as description from refs group by paper_id, label")
def first_ref_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latex.first_references(_latex_docs(spark, sf_dir)).drop("ref_ord")


@query(PARAGRAPH_SQL + " select r.paper_id, count(*)::bigint as n_mentions, min(start) as first_start, max(stop) as last_stop from refs r group by r.paper_id")
def caption_desc_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = latex.caption_mentions(_latex_docs(spark, sf_dir))
    return found.select("paper_id", F.size("mentions").cast("long").alias("n_mentions"), F.array_min(F.transform("mentions", lambda m: m["start"])).alias("first_start"), F.array_max(F.transform("mentions", lambda m: m["stop"])).alias("last_stop"))


@query("select doc_id, contains(lower(text), 'hath') or contains(lower(text), 'tion of') or contains(lower(text), 'leau') as vetoed from documents")
def hard_negative_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", rules.vetoed(F.col("text"), ["hath", "tion of", "leau"]).alias("vetoed"))


@query("""select doc_id, case when contains(lower(text), 'there') then least(s + 0.15, 1.0) when contains(lower(text), 'heat') then least(s + 0.1, 1.0) when contains(lower(text), 'de la') then least(s + 0.05, 1.0) else s end as score
from (select doc_id, text, (doc_id % 100) / 100.0::double as s from documents)""")
def keyword_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("s", (F.col("doc_id") % 100) / F.lit(100.0))
    return docs.select("doc_id", rules.boosted(F.col("s"), F.col("text"), [("there", 0.15), ("heat", 0.1), ("de la", 0.05)]).alias("score"))


VECTOR_CTE = """with v as (select vec_id, label, embedding::double[] as e from embeddings),
mean as (select list(m order by i) as c from (select i, avg(x) as m from (select unnest(e) as x, generate_subscripts(e, 1) as i from v) group by i))"""


@query(VECTOR_CTE + " select vec_id, round(list_cosine_similarity(e, c), 6) as score from v, mean")
def cosine_to_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _table(spark, sf_dir, "embeddings")
    scored = v.join(F.broadcast(vectors.centroid(v)), how="left")
    return scored.select("vec_id", F.round(vectors.cosine("embedding", "centroid"), 6).alias("score"))


@query("""with v as (select label, embedding::double[] as e from embeddings), m as (select label, i, avg(x) as m from (select label, unnest(e) as x, generate_subscripts(e, 1) as i from v) group by label, i),
n as (select label, sqrt(sum(m * m)) as n from m group by label) select label, i - 1 as pos, round(m / n, 6) as value from m join n using (label)""")
def normalized_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = vectors.centroid(_table(spark, sf_dir, "embeddings"), by=["label"], unit=True)
    return means.select("label", F.posexplode("centroid").alias("p", "x")).select("label", F.col("p").cast("long").alias("pos"), F.round("x", 6).alias("value"))


@query("""with v as (select vec_id, embedding::double[] as e from embeddings), a as (select e as f from v where vec_id % 50 = 0),
mean as (select list(m order by i) as c from (select i, avg(x) as m from (select unnest(f) as x, generate_subscripts(f, 1) as i from a) group by i))
select vec_id, round(greatest(max(list_dot_product(e, f)), any_value(list_cosine_similarity(e, c))), 6) as score from v, a, mean group by vec_id""")
def max_anchor_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _table(spark, sf_dir, "embeddings")
    anchors = v.where("vec_id % 50 = 0").select(F.col("embedding").alias("vec"))
    return vectors.max_anchor_score(v, anchors).select("vec_id", F.round("score", 6).alias("score"))


@query("""with v as (select vec_id, label, embedding::double[] as e from embeddings), mean as (
select list(m order by i) as c from (select i, avg(x) as m from (select unnest(e) as x, generate_subscripts(e, 1) as i from v where label = 0) group by i)),
s as (select vec_id, round(list_dot_product(e, c), 6) as score from v, mean where label <> 0)
select vec_id::varchar as sentence, 0 as turn, null::double as score from v where label = 0 union all select vec_id::varchar, 1, score from s where score > 0.1""")
def anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _table(spark, sf_dir, "embeddings").where("label is not null").select("label", F.col("vec_id").alias("ord"), F.col("vec_id").cast("string").alias("sentence"), F.col("embedding").alias("vec"))
    found = vectors.expand_anchors(v.where("label = 0").drop("label"), v.where("label <> 0").drop("label"), 0.1000005)
    return found.select("sentence", "turn", F.round("score", 6).alias("score"))


@query(VECTOR_CTE + " select vec_id, round(list_cosine_similarity(e, c), 6) as score from v, mean order by round(list_cosine_similarity(e, c), 6) desc, vec_id limit 50")
def topk_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_to_centroid(spark, sf_dir).orderBy(F.desc("score"), "vec_id").limit(50)


@query(f"""with i as ({LAYOUT_ITEMS}) select page_no, item_ord, caption_ord, dist::double as dist from (
select p.page_no, p.item_ord, c.item_ord as caption_ord, least(abs(p.b - c.t), abs(p.t - c.b)) as dist,
row_number() over (partition by p.page_no, p.item_ord order by least(abs(p.b - c.t), abs(p.t - c.b)), c.item_ord) as k
from i p join i c on p.page_no = c.page_no and p.kind = 'picture' and c.kind = 'caption' where least(abs(p.b - c.t), abs(p.t - c.b)) < 250) where k = 1""")
def nearest_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _derived(spark, sf_dir, LAYOUT_ITEMS, "lineitem")
    return layout.nearest_captions(items, keys=("page_no",)).withColumn("dist", F.col("dist").cast("double"))


@query(f"with i as ({LAYOUT_ITEMS}) select page_no, kind, min(item_ord) as item_ord, arg_max(t, item_ord) as t, arg_max(b, item_ord) as b from i group by page_no, kind")
def dedup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _derived(spark, sf_dir, LAYOUT_ITEMS, "lineitem").select("page_no", "kind", "item_ord", "t", "b")
    return layout.last_wins(items, ["page_no", "kind"], "item_ord")


@query(f"""with i as (select *, page_no::varchar as paper_id from ({LAYOUT_ITEMS})), n as (
select p.paper_id, p.item_ord, c.l_linenumber as number, c.l_partkey as part, row_number() over (partition by p.paper_id, p.item_ord order by least(abs(p.b - c.t), abs(p.t - c.b)), c.item_ord) as k
from i p join i c on p.paper_id = c.paper_id and p.kind = 'picture' and c.kind = 'caption' where least(abs(p.b - c.t), abs(p.t - c.b)) < 250)
select paper_id, paper_id || '_' || number || '.png' as figure_name, min(item_ord) as fig_ord, number::varchar as figure_number, arg_max('part ' || part, item_ord) as caption, 1 as page_number
from n where k = 1 group by paper_id, number""")
def assembled_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _derived(spark, sf_dir, LAYOUT_ITEMS, "lineitem").select(
        F.col("page_no").cast("string").alias("paper_id"), "item_ord", "kind", F.concat(F.lit("Figure "), F.col("l_linenumber"), F.lit(": part "), "l_partkey").alias("text"),
        F.lit(1).alias("page_no"), "t", "b", F.array().cast("array<string>").alias("captions"), F.encode(F.col("l_partkey").cast("string"), "UTF-8").alias("image"))
    return layout.assemble_figures(items).drop("image")


@query()
def fuzzy_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    captions = _table(spark, sf_dir, "benchmark").select(F.lit(0).alias("paper_id"), F.col("item_id").alias("cap_idx"), F.col("text").alias("caption"))
    figures = _table(spark, sf_dir, "benchmark").select(F.lit(0).alias("paper_id"), F.col("item_id").alias("fig_ord"), F.col("item_id").cast("string").alias("figure_number"), F.lit(1).alias("page_number"), F.col("text").alias("caption"))
    return match.match_figures(captions, figures)


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "[.] ")).alias("sent_ord", "s"))
    rows = rows.select("doc_id", "sent_ord", F.when(F.col("sent_ord") % 5 == 0, F.concat(F.lit("Fig. "), (F.col("sent_ord") % 3 + 1).cast("string"), F.lit(" "), "s")).otherwise(F.col("s")).alias("sent"))
    before = Window.partitionBy("doc_id").orderBy("sent_ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("sent") + 1).over(before), F.lit(0)).cast("int")
    return rows.withColumn("start", start).withColumn("stop", F.col("start") + F.length("sent"))


SENTENCE_SQL = """with s as (select doc_id, unnest(string_split(text, '. ')) as s, (generate_subscripts(string_split(text, '. '), 1) - 1)::integer as sent_ord from documents),
m as (select doc_id, sent_ord, case when sent_ord % 5 = 0 then concat('Fig. ', (sent_ord % 3 + 1)::varchar, ' ', s) else s end as sent from s),
p as (select *, coalesce(sum(length(sent) + 1) over (partition by doc_id order by sent_ord rows between unbounded preceding and 1 preceding), 0)::integer as start from m),
f as (select * exclude (start), start, max((start + length(sent))::integer) over (partition by doc_id order by sent_ord rows between current row and 9 following) as stop, trim(string_agg(sent, ' ') over (partition by doc_id order by sent_ord rows between current row and 2 following), ' ') as caption,
trim(string_agg(sent, ' ') over (partition by doc_id order by sent_ord rows between current row and 9 following), ' ') as description,
(sent_ord % 3 + 1)::varchar as figure from p)"""


@query(SENTENCE_SQL + " select doc_id, sent_ord, start, stop, figure, caption, description from f where sent_ord % 5 = 0")
def mention_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.mention_frames(_sentences(spark, sf_dir), joiner=" ", keys=("doc_id",))


@query(SENTENCE_SQL + " select doc_id, 'Figure_' || figure as figure_label, arg_min(caption, sent_ord) as caption, count(*)::bigint as n_mentions, min(start) as first_start, max(stop) as last_stop from f where sent_ord % 5 = 0 group by doc_id, figure")
def figure_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = layout.mention_frames(_sentences(spark, sf_dir), joiner=" ", keys=("doc_id",)).withColumn("page_number", F.lit(1))
    return layout.figure_mentions(frames, "doc_id").select("doc_id", "figure_label", "caption", F.size("descriptions").cast("long").alias("n_mentions"), F.array_min(F.transform("start_end_positions", lambda p: p["start"])).alias("first_start"), F.array_max(F.transform("start_end_positions", lambda p: p["end"])).alias("last_stop"))


@query(f"""select paper_id, regexp_extract(lower(content), '(\\d+)\\s*-?\\s*qubits?', 1) as qubits, array_to_string(list_sort(list_distinct(list_filter([
{", ".join(f"regexp_extract(lower(content), '{p}', 1)" for p in rules.GATES)}], lambda g: g <> ''))), ',') as gates from ({LATEX_DOCS})""")
def gates_and_qubits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _latex_docs(spark, sf_dir)
    return docs.select("paper_id", rules.qubit_count(F.col("content")).alias("qubits"), F.array_join(rules.gate_tags(F.col("content")), ",").alias("gates"))


@query("""with a as (select user_id as record_id, event_id as q_ord, case when event_id % 7 = 0 then 'one two three four five ' || event_type else event_type end as answer, value / (select max(value) from events) as score from events),
b as (select record_id, answer, score, row_number() over (partition by record_id order by score desc, q_ord) as k from a where score > 0 and answer not like '% %')
select record_id, case when score > 0.1 and not contains(lower(answer), 'line') then answer end as algorithm, round(score, 9) as score from b where k = 1""")
def qa_best_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    most = events.agg(F.max("value").alias("most"))
    answers = events.join(F.broadcast(most)).select(F.col("user_id").alias("record_id"), F.col("event_id").alias("q_ord"), F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("one two three four five "), "event_type")).otherwise(F.col("event_type")).alias("answer"), (F.col("value") / F.col("most")).alias("score"))
    return match.best_answers(answers).withColumn("score", F.round("score", 9))


STOP = ["the", "and", "of", "to", "in"]


@query("""with w as (select doc_id, list_filter(regexp_extract_all(lower(text), '[\\pL\\pN_]{2,}', 0), lambda x: x not in ('the', 'and', 'of', 'to', 'in')) as w from documents),
g as (select doc_id, w[i] as term from w, unnest(range(1, len(w) + 1)) t(i) union all select doc_id, w[i] || ' ' || w[i + 1] from w, unnest(range(1, len(w))) t(i)
union all select doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] from w, unnest(range(1, len(w) - 1)) t(i)),
c as (select term, count(*)::bigint as cnt from g group by term having count(distinct doc_id) >= 2)
select term, cnt, case when term in ('qiskit', 'cirq', 'ansatz', 'unitary', 'qubit') then 0.15 when not contains(term, ' ') then 0.05 when contains(term, 'quantum') or contains(term, 'circuit') then 0.10 else 0.15 end::double as boost
from c order by cnt desc, term desc limit 50""")
def ngram_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.top_keywords(_table(spark, sf_dir, "documents"), STOP, key="doc_id")


@query("""select d.doc_id::varchar as paper_id, case when l.doc_id is not null then coalesce(n, 0) end::bigint as "No_Img" from documents d left join (select distinct doc_id from labels) l using (doc_id)
left join (select doc_id, count(*) as n from labels where quality = 1 group by doc_id) c using (doc_id)""")
def images_per_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = _table(spark, sf_dir, "labels"), _table(spark, sf_dir, "documents")
    records = labels.where("quality = 1").select(F.col("doc_id").cast("string").alias("arxiv_id"))
    return match.images_per_paper(records, docs.select(F.col("doc_id").cast("string").alias("paper_id")), labels.select(F.col("doc_id").cast("string").alias("paper_id")))


@query("""with r as (select doc_id as ord, doc_id % 3 as n, sum(doc_id % 3) over (order by doc_id) as running from documents)
select ord, n, running::bigint as running from r where ord <= coalesce((select min(ord) from r where running = 250), 1e18)""")
def cap_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), (F.col("doc_id") % 3).alias("n"))
    return match.cap_batch(counts, 250)


@query("select doc_id as ord, case when doc_id % 7 = 0 then null else concat(doc_id::varchar, ':', lang) end as paper_id from documents where doc_id % 5 <> 0")
def id_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    line = F.when(F.col("doc_id") % 5 == 0, F.lit("  ")).when(F.col("doc_id") % 7 == 0, F.lit("nocolon")).otherwise(F.concat(F.lit(" arxiv:"), F.col("doc_id"), F.lit(":"), "lang", F.lit(" ")))
    return readers.id_list(docs.select("doc_id", line.alias("value")), order="doc_id")


@query("select doc_id as paper_id from documents where doc_id % 4 in (0, 1) and doc_id % 10 <> 0 and doc_id % 6 <> 0")
def category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, meta = _table(spark, sf_dir, "documents"), _derived(spark, sf_dir, PAPER_META, "documents")
    ids = docs.select(F.col("doc_id").alias("paper_id"))
    return readers.wanted_papers(ids, meta, ids.where("paper_id % 6 = 0")).select("paper_id")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = latex.mention_lists(latex.caption_mentions(_latex_docs(spark, sf_dir)))
    keyed = lists.select(F.concat("paper_id", F.lit("_"), F.col("paper_id") % 9 + 1, F.lit(".png")).alias("image_key"), F.col("paper_id").cast("string").alias("arxiv_id"), "caption", "description", "start_end")
    return match.enrich(keyed)


@query(PARAGRAPH_SQL + """ select concat(paper_id::varchar, '_', (paper_id % 9 + 1)::varchar, '.png') as image_key, paper_id::varchar as arxiv_id, 'cnot' as gates, (paper_id % 7 + 2)::varchar as qubits, count(*)::bigint as n_mentions
from refs group by paper_id""")
def enriched_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir)
    return rows.select("image_key", "arxiv_id", F.array_join("gates", ",").alias("gates"), "qubits", F.size("description").cast("long").alias("n_mentions"))


@query()
def enriched_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.keyed_json(_records(spark, sf_dir))


@query("select source, count(*)::bigint as n_docs, sum(case when contains(lower(text), 'hath') then 1 else 0 end)::bigint as n_vetoed, sum(length(text))::bigint as n_chars from documents group by source")
def veto_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("veto", rules.vetoed(F.col("text"), ["hath"]).cast("long"))
    return docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("veto").alias("n_vetoed"), F.sum(F.length("text")).alias("n_chars"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LaTeX mining up to enriched records."""
    return enriched_records(spark, sf_dir)
