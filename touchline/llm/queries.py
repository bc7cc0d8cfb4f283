"""The queries of this subpackage, as __spark_entry__.py registers them, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import exact, html, language, lines, mixing, negatives, packing, search, simhash, sketches, toxicity, trie, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The dated list of op1: list, pattern, action, date.
URL_LIST = (
    ("adult", "adult-x.example.com", "add", "2023-06-01"),
    ("adult", "adult-x.example.com", "remove", "2024-06-10"),
    ("adult", "adult-x.example.com", "add", "2024-07-01"),
    ("gambling", "casino-win.example.com", "add", "2024-02-01"),
    ("gambling", "casino-win.example.com", "remove", "2024-05-01"),
    ("gambling", "casino-win.example.com", "add", "2024-08-01"),
    ("gambling", "free-bets.example.net", "add", "2024-03-15"),
    ("pharma", "cheap-pills.example.com", "add", "2023-12-01"),
    ("pharma", "cheap-pills.example.com", "remove", "2024-09-01"),
    ("spam", "tionsh.example.net/de", "add", "2024-04-01"),
    ("spam", "tionsh.example.net/de", "remove", "2024-10-01"),
    ("spam", "ththth.example.org", "add", "2024-01-15"),
    ("spam", "ththth.example.org", "remove", "2024-01-15"),
    ("copyright", "tionble.example.com/en", "add", "2024-05-20"),
    ("copyright", "example.org", "add", "2024-11-01"),
    ("allow", "thther.example.org", "add", "2024-01-01"),
    ("allow", "thther.example.org/de", "add", "2024-01-01"),
    ("spam", "thther.example.org/de", "add", "2024-11-15"),
)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against the dated list; a page counts as fetched page_id mod 366 days after 2024-01-01."""
    entries = spark.createDataFrame(URL_LIST, "list_name string, pattern string, action string, dated string")
    entries = entries.withColumn("dated", F.to_date("dated"))
    fetched = F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod(F.col("page_id"), F.lit(366)).cast("int"))
    captures = _table(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched_on"))
    found = urls.filter_urls(captures, entries)
    verdict = F.col("url_filter.blocked").cast("int").alias("blocked")
    rest = [F.col(f"url_filter.{c}").alias(c) for c in ("list_name", "pattern", "active")]
    return found.select("page_id", "url", "fetched_on", urls.host("url").alias("host"), verdict, *rest)


OP1_SQL = f"""
with entries(list_name, pattern, action, dated) as (
  select column0, column1, column2, cast(column3 as date) from (values {", ".join(map(str, URL_LIST))}) as t(column0, column1, column2, column3)
), spans as (
  select list_name, pattern, action, dated as valid_from,
         lead(dated) over (partition by list_name, pattern order by dated, action) as valid_to
  from entries
), live as (
  select list_name, pattern, valid_from, valid_to, split_part(pattern, '/', 1) as eh,
         substr(pattern, length(split_part(pattern, '/', 1)) + 1) as ep
  from spans where action = 'add' and (valid_to is null or valid_to > valid_from)
), captures as (
  select page_id, url, cast(date '2024-01-01' + cast(((page_id % 366) + 366) % 366 as integer) as date) as fetched_on,
         lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) as host,
         '/' || trim(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1)), '/+', '/', 'g'), '/') as path
  from pages
), met as (
  select c.page_id, c.url, c.fetched_on, c.host, l.list_name, l.pattern
  from captures c left join live l
    on (c.host = l.eh or ends_with(c.host, '.' || l.eh)) and (l.ep = '' or c.path = l.ep or starts_with(c.path, l.ep || '/'))
   and c.fetched_on >= l.valid_from and (l.valid_to is null or c.fetched_on < l.valid_to)
), ranked as (
  select *, count(list_name) over (partition by page_id) as active,
         row_number() over (partition by page_id
           order by length(pattern) desc nulls last, case when list_name = 'allow' then 0 else 1 end, list_name, pattern) as rn
  from met
)
select page_id, url, fetched_on, host,
       cast(case when list_name is null or list_name = 'allow' then 0 else 1 end as integer) as blocked,
       list_name, pattern, cast(active as bigint) as active
from ranked where rn = 1
"""


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"), [F.col("page_id"), F.col("url")])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("lines.total").alias("n_lines"), F.col("lines.dropped").alias("n_dropped"), "text")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, plan = mixing.mix(_table(spark, sf_dir, "documents"))
    sources = spark.createDataFrame(plan.sources, "name string, source_size long, target double")
    own = F.col("source").eqNullSafe(F.col("name"))
    joined = mixed.join(F.broadcast(sources), own)  # as few rows as there are sources, which max_patterns bounds
    return joined.select("doc_id", F.col("mix.size").alias("size"), "source_size", "target", F.col("mix.taken").alias("taken"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _fold(modulus: int):
    """crc32 of doc_id as text, modulo modulus; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(_fold(3) != 1))
    held_out = F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out")
    found = toxicity.score(docs, model, [F.col("doc_id"), held_out])
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs.where(_fold(4) != 2))
    held_out = F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out")
    return language.identify(docs, model, [F.col("doc_id"), held_out])


def op8_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(_table(spark, sf_dir, "documents"), path)


def op9_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every document whose id is divisible by 50."""
    docs = _table(spark, sf_dir, "documents")
    return search.search(docs, docs.where(F.col("doc_id") % 50 == 0))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.find_copies(_table(spark, sf_dir, "documents"))


OP11_SQL = """
with d as (
  select doc_id, coalesce(length(text), 0) as n,
         translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') as norm
  from documents
), ranked as (
  select *, row_number() over w as place, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size
  from d window w as (partition by norm order by n desc, doc_id nulls last)
)
select doc_id, keep_id, group_size, place = 1 as kept, sha256(norm) as text_sha256 from ranked
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(_table(spark, sf_dir, "conversations"))


OP12_SQL = """
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as digest, turn
  from conversations where conv_id is not null
), numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, digest) as nth from t
), convs as (
  select conv_id, conv_id - conv_id % 100 as base, count(*) as n,
         xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
           lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)), lambda z, i: xor(z >> 1, (z & 1) * 3988292384)))) % 6 as h
  from numbered group by conv_id
), rebuilt as (
  select c.conv_id, n.nth as at, n.digest, length(n.text) as size from convs c join numbered n on n.conv_id = c.base and n.nth <= c.h
  union all
  select c.conv_id, 10 + n.nth, n.digest, length(n.text) from convs c join numbered n on n.conv_id = c.conv_id and n.nth > c.h
), whole as (
  select c.conv_id, coalesce(list(r.digest order by r.at) filter (r.digest is not null), []) as turns,
         coalesce(list(r.size order by r.at) filter (r.digest is not null), []) as sizes
  from convs c left join rebuilt r using (conv_id) group by c.conv_id
), prefixes as (
  select conv_id, turns, d as depth, list_slice(turns, 1, d) as node, case when d = 0 then 0 else sizes[d] end as size
  from (select *, unnest(range(len(turns) + 1)) as d from whole)
), nodes as (
  select node, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(size) as size,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (len(turns) = depth), '')) as ends_sha256
  from prefixes group by node, depth
), tied as (
  select a.*, p.conv_id as parent_conv_id, (select count(*) from nodes k where k.depth = a.depth + 1 and list_slice(k.node, 1, a.depth) = a.node) as n_children
  from nodes a left join nodes p on p.depth = a.depth - 1 and p.node = list_slice(a.node, 1, a.depth - 1)
), below as (
  select list_slice(node, 1, i) as node, count(*) filter (n_children = 0) as n_leaves, sum((n_convs - 1) * size) as saved_tokens
  from (select *, unnest(range(depth + 1)) as i from tied) group by 1
)
select t.conv_id, t.depth::bigint as depth, t.parent_conv_id, t.n_convs, t.n_children, b.n_leaves, b.saved_tokens::bigint as saved_tokens, t.ends_sha256
from tied t join below b on b.node = t.node
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 50 is an anchor; every seventh label is moved on first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


OP13_SQL = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
), p as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, p.positive_id,
       cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as integer) as rank,
       s.vec_id as negative_id, p.positive_score, s.score as negative_score
from p join scored s on s.anchor_id = p.anchor_id and not s.same and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
qualify rank <= 3
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_url_filter": op1_url_filter, "op7_html": op7_html, "op2_line_dedup": op2_line_dedup, "op3_mixing": op3_mixing, "op5_simhash": op5_simhash, "op4_toxicity": op4_toxicity, "op6_language": op6_language, "op8_packing": op8_packing, "op9_search": op9_search, "op10_fingerprints": op10_fingerprints, "op11_exact_dedup": op11_exact_dedup, "op12_prefix_trie": op12_prefix_trie, "op13_hard_negatives": op13_hard_negatives}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op11_exact_dedup": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_hard_negatives": OP13_SQL}
