"""The queries of the training-data operators, and the SQL that some of them equal."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import ann, decontaminate, line_dedup, mixing, quality, simhash, token_count, token_store, url_filter, warc
from quillgraph.llm.common import bound_batches, read


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
with words as (
  select 'd' as kind, doc_id as id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_\x{80}-\x{10FFFF}]+') as w from documents
  union all select 'i', item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_\x{80}-\x{10FFFF}]+') from benchmark where item_id is not null),
shingles as (
  select distinct kind, id, s from (
    select kind, id, unnest(list_transform(generate_series(1, greatest(1, len(w) - 4)), lambda i: array_to_string(w[i:i + 4], ' '))) as s
    from words where len(w) > 0)),
sizes as (select id, count(*) as n from shingles where kind = 'i' group by id)
select d.id as doc_id, i.id as item_id, count(*)::bigint as n_shared, any_value(z.n)::bigint as n_item, count(*) / any_value(z.n)::double as containment
from shingles d join shingles i on d.s = i.s and d.kind = 'd' and i.kind = 'i' join sizes z on z.id = i.id
group by 1, 2 having count(*) >= 0.8 * any_value(z.n) - 1e-9
"""


def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are captures, one a day in the order of page_id over 2024; the list's history is derived from their hosts."""
    pages = read(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")).alias("fetched"))
    # the history: a third of the hosts is listed for a while (a ninth twice), and some sections of hosts
    own = url_filter.host(F.col("url"))
    section = F.concat(own, F.lit("/"), F.split(F.regexp_replace(url_filter.path(F.col("url")), "^/+", ""), "/")[0])
    digit = lambda c, i: (F.ascii(F.substring(F.md5(c.cast("binary")), i, 1)) + F.ascii(F.substring(F.md5(c.cast("binary")), i + 1, 1)) * 31) % 180
    keys = pages.select(F.explode(F.array(own, section)).alias("entry")).where("entry <> '' and not endswith(entry, '/')").distinct()
    keys = keys.where(F.ascii(F.substring(F.md5(F.col("entry").cast("binary")), 9, 1)) % 3 == 0)
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    e = F.col("entry")
    history = keys.select("entry", F.explode(F.array(
        F.struct(F.lit("add").alias("action"), day(digit(e, 1)).alias("listed")),
        F.struct(F.lit("remove").alias("action"), day(digit(e, 1) + 1 + digit(e, 3) / 2).alias("listed")),
        F.struct(F.when(F.ascii(F.substring(F.md5(e.cast("binary")), 11, 1)) % 3 == 0, "add").otherwise("remove").alias("action"), day(digit(e, 1) + digit(e, 3) + 2).alias("listed")),
    )).alias("x")).select("entry", "x.action", "x.listed")
    return url_filter.judge(captures, history)


OP4_SQL = """
with p as (
  select page_id, url, date '2024-01-01' + ((page_id * 37) % 366)::int as fetched,
         lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) as host,
         regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path
  from pages),
keys as (
  select distinct entry from (
    select host as entry from p
    union all select host || '/' || string_split(regexp_replace(path, '^/+', ''), '/')[1] from p)
  where entry <> '' and not ends_with(entry, '/') and ascii(substr(md5(entry), 9, 1)) % 3 = 0),
days as (
  select entry, (ascii(substr(md5(entry), 1, 1)) + ascii(substr(md5(entry), 2, 1)) * 31) % 180 as a,
         (ascii(substr(md5(entry), 3, 1)) + ascii(substr(md5(entry), 4, 1)) * 31) % 180 as b,
         ascii(substr(md5(entry), 11, 1)) % 3 = 0 as again
  from keys),
history as (
  select entry, 'add' as action, date '2024-01-01' + a::int as listed from days
  union all select entry, 'remove', date '2024-01-01' + (floor(a + 1 + b / 2.0))::int from days
  union all select entry, case when again then 'add' else 'remove' end, date '2024-01-01' + (a + b + 2)::int from days),
daily as (select entry, listed, bool_or(action = 'add') as is_on from history group by entry, listed),
spans as (select entry, listed as start, coalesce(lead(listed) over (partition by entry order by listed), date '9999-12-31') as stop, is_on from daily),
met as (
  select p.page_id, count(*) as n_active, min((-length(s.entry), s.entry)) as first
  from p join spans s on s.is_on and p.fetched >= s.start and p.fetched < s.stop and p.host <> ''
   and (s.entry = p.host or ends_with(p.host, '.' || s.entry)
        or (contains(s.entry, '/') and starts_with(p.host || '/' || regexp_replace(p.path, '^/+', '') || '/', s.entry || '/')))
  group by p.page_id)
select p.page_id, p.url, p.fetched, p.host, m.page_id is not null as blocked, coalesce(m.n_active, 0)::bigint as n_active, m.first[2] as rule
from p left join met m using (page_id)
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as payload_digest from p),
b as (select payload_digest, payload_bytes, max(page_id) as response from d where payload_bytes >= 1000 group by 1, 2)
select d.page_id, d.payload_bytes, d.payload_digest,
       case when b.response is null or b.response = d.page_id then 'response' else 'revisit' end as record_type,
       case when b.response <> d.page_id then b.response end as refers_to
from d left join b using (payload_digest, payload_bytes)
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return quality.score(documents, quality.train(documents, read(spark, sf_dir, "labels")))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.clean_vectors(read(spark, sf_dir, "embeddings"))
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


OP9_SQL = """
with l as (
  select doc_id, coalesce('s' || source, '') as site, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
b as (select trim(line, ' ') as line from l where trim(line, ' ') <> '' group by 1 having count(distinct site) >= 5)
select l.doc_id, count(*)::bigint as n_lines, count(b.line)::bigint as n_removed,
       md5(coalesce(string_agg(l.line, chr(10) order by l.pos) filter (where b.line is null), '')) as text_md5
from l left join b on trim(l.line, ' ') = b.line
group by l.doc_id
"""


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.tokenize(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def queries() -> dict:
    own = (op1_decontaminate, op2_token_count, op3_simhash, op4_url_filter, op5_warc, op6_mixing, op7_quality, op8_ann, op9_line_dedup, op10_token_ids)
    return {f.__name__: _bounded(f) for f in own}


def _bounded(query):
    """The query in a session whose batches for Python are bounded."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return query(spark, sf_dir)

    return run


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op4_url_filter": OP4_SQL, "op5_warc": OP5_SQL, "op9_line_dedup": OP9_SQL}
