"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, filter_audit, host_rules, licenses, line_dedup, neighbours, packing, private_data, quality, simhash,
    spelling, toxicity, url_filter,
)
from .common import table
from .labelled import held_out

Query = Callable[[SparkSession, str], DataFrame]

# The rules of the url query and the host labels it lists.
URL_RULES = (
    url_filter.Rule("net", "/", "block"),
    url_filter.Rule("example.net", "/en/", "allow"),
    url_filter.Rule("example.com", "/de/", "block"),
    url_filter.Rule("org", "/fr/", "allow"),
)
LISTED_LABELS = ("adult-x", "casino-win", "free-bets", "spam-farm")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return host_rules.judge_documents(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("host_rate", 6).alias("host_rate"),
    )


OP3_SQL = r"""
with d as (
  select row_number() over () r, doc_id, source, coalesce(text, '') t from documents
), w as (
  select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls
  from d
), places as (
  select r, ws, unnest(range(1, len(ws) - 6)) i from w
), windows as (
  select r, i, count(*) over (partition by r, array_to_string(ws[i:i + 7], ' ')) c from places
), repeats as (
  select r, count(distinct i + k) n from windows, range(8) g(k) where c > 1 group by r
), base as (
  select doc_id, source, len(ws) n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols,
         len(ls) - len(list_distinct(ls)) n_dup_lines,
         coalesce(n, 0) n_repeat_words
  from w left join repeats using (r)
), judged as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from base
), hosts as (
  select source, count(*) n, count_if(base_failed) f from judged where source is not null group by source
), sums as (
  select sum(n) n, sum(f) f, sum(f * f / n) q, count(*) h from hosts
), rated as (
  select *, f / n mu, (f / n) * (1 - f / n) v, q / n - (f / n) * (f / n) - (f / n) * (1 - f / n) * h / n b from sums
), prior as (
  select mu, least(greatest(case when b > 0 then v / b - 1 else 10000 end, 1), 10000) s from rated
), rates as (
  select source, (f + mu * s) / (n + s) rate from hosts, prior
)
select doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars,
       cast(n_symbols as bigint) n_symbols, cast(n_dup_lines as bigint) n_dup_lines,
       cast(n_repeat_words as bigint) n_repeat_words, base_failed,
       not base_failed and not coalesce(rate > 0.5, false) kept, round(rate, 6) host_rate
from judged left join rates using (source)
"""


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "license", F.round("dice", 6).alias("dice"), F.size("matches").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("matches.license")), ", ").alias("licenses"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP5_SQL = r"""
with d as (
  select row_number() over () r, doc_id, text from documents
), cut as (
  select r, doc_id, regexp_extract_all(text, '(?s).*?(?:[.!?] |\n|\z)[\x20\x09-\x0D]*') ls from d
), numbered as (
  select r, doc_id, i, ls[i] l from (select r, doc_id, ls, unnest(range(1, len(ls) + 1)) i from cut)
), holding as (
  select *, trim(l, E' \n\r\t') k, row_number() over (partition by r order by i) n
  from numbered where regexp_matches(l, '[^\x20\x09-\x0D]')
), joined as (
  select *, case when count(*) over (partition by r) >= 3 then k || chr(10) || lead(k) over p || chr(10) || lead(k, 2) over p
                 when n = 1 then k || coalesce(chr(10) || lead(k) over p, '') end w
  from holding window p as (partition by r order by n)
), windows as (
  select *, row_number() over (partition by w order by doc_id, n) o from joined where w is not null
), gone as (
  select distinct r, n + g n from windows, range(3) t(g) where o > 1
), dropped as (
  select r, i, 1 yes from gone join holding using (r, n)
)
select d.doc_id, string_agg(case when yes is null then l else '' end, '' order by numbered.i) as text,
       count(yes) removed_lines
from d left join numbered using (r) left join dropped using (r, i) group by d.r, d.doc_id
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", held_out("doc_id", toxicity.FOLDS, toxicity.HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence",
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, trees).select(
        "doc_id", held_out("doc_id", quality.FOLDS, quality.HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = spark.createDataFrame([(x,) for x in LISTED_LABELS], "key string")
    return url_filter.judge_urls(pages, URL_RULES, listed).select(
        "page_id", "host", "path", "rule", "verdict", "listed"
    )


OP10_SQL = r"""
with rest as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages
), parts as (
  select page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path
  from rest
), rules(rule_host, rule_path, does) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
         ('org', '/fr/', 'allow')
), fitting as (
  select page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) rule,
         max_by(does, length(rule_host || rule_path)) does
  from parts join rules
    on (host = rule_host or suffix(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by page_id
), judged as (
  select page_id, host, path, rule, does,
         list_has_any(string_split(host, '.'), ['adult-x', 'casino-win', 'free-bets', 'spam-farm']) listed
  from parts left join fitting using (page_id)
)
select page_id, host, path, rule, coalesce(does, case when listed then 'block' else 'allow' end) verdict, listed
from judged
"""

def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP11_SQL = r"""
with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) t
), runs as (
  select coalesce(cast(doc_id as varchar), '') id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) r from documents
), lowered as (
  select id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') w, count(*) n
  from runs where length(r) >= 6 group by all
), points as (
  select w, n, list_transform(string_split(id || ':' || w, ''), lambda c: unicode(c)) p from lowered
), bytes as (
  select w, n, flatten(list_transform(p, lambda c: case when c < 128 then [c] else [192 + (c >> 6), 128 + (c & 63)] end)) b
  from points
), hashed as (
  select w, n, xor(list_reduce(list_prepend(4294967295, b),
    lambda h, c: xor(h >> 8, t[1 + cast(xor(h, c) & 255 as int)])), 4294967295) h
  from bytes, crc
), written as (
  select case when h % 199 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end word, n
  from hashed
), words as materialized (
  select word, cast(sum(n) as bigint) n from written where length(word) >= 6 group by word having sum(n) >= 5
), dels as (
  select word, i, substr(word, 1, i - 1) || substr(word, i + 1) d
  from (select word, unnest(range(1, length(word) + 1)) i from words)
), nears as materialized (
  select a.word, b.word near from dels a join dels b on a.i = b.i and a.d = b.d and a.word <> b.word
  union select dels.word, w.word from dels join words w on d = w.word
  union select w.word, dels.word from dels join words w on d = w.word
), ranked as (
  select nears.word, near, words.n m, count(*) over (partition by nears.word) n_near,
         row_number() over (partition by nears.word order by words.n desc, near) o
  from nears join words on near = words.word
), forms as materialized (
  select word, case when m >= 5 * n then near end form, n, coalesce(n_near, 0) n_near, case when m >= 5 * n then m end form_n
  from words left join (select * from ranked where o = 1) using (word)
), ways(word, root) as (
  select word, word from forms
  union all select ways.word, form from ways join forms on root = forms.word where form is not null
), roots as (
  select ways.word, root from ways join forms on root = forms.word where form is null
)
select word, form, root, n, n_near, form_n from forms join roots using (word)
"""

def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/documents.parquet"
    return filter_audit.audit_files(spark, path, table(spark, sf_dir, "labels"))


OP12_SQL = r"""
with own as (
  select doc_id, coalesce(lang, '') part, coalesce(text, '') t from documents
), cut as (
  select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws from own
), masked as (
  select doc_id, part, if(len(ws) < 100, 1, 0) + if(100 * len(list_distinct(ws)) < 80 * len(ws), 2, 0)
         + if(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), 4, 0)
         + if(regexp_matches(t, '[#$%&*|]'), 8, 0)
         + if(coalesce(doc_id > min(doc_id) over (partition by t), false), 16, 0) mask
  from cut
), marks as (
  select doc_id, max(if(quality = 1, 1, 0)) good, max(if(toxic = 1, 1, 0)) toxic from labels group by doc_id
), cells as (
  select part, mask, count(*) n, coalesce(sum(good), 0) good, coalesce(sum(toxic), 0) toxic
  from masked left join marks using (doc_id) group by all
), letters as (
  select cast(i as int) k, chr(cast(65 + i as int)) f from range(5) t(i)
), orders as (
  select a.f || b.f || c.f || d.f || e.f filter_order from letters a join letters b on b.k <> a.k
  join letters c on c.k not in (a.k, b.k) join letters d on d.k not in (a.k, b.k, c.k)
  join letters e on e.k not in (a.k, b.k, c.k, d.k)
), places as (
  select filter_order, step, 1 << (ascii(filter_order[step]) - 65) f,
         list_sum(list_transform(string_split(filter_order[1:step - 1], ''), lambda x: if(x = '', 0, 1 << (ascii(x) - 65)))) earlier
  from (select filter_order, unnest(range(1, 6)) step from orders)
), steps as (
  select part, filter_order, step, f,
         sum(if(mask & f = 0 and mask & cast(coalesce(earlier, 0) as int) = 0, n, 0)) kept,
         sum(if(mask & f > 0 and mask & cast(coalesce(earlier, 0) as int) = 0, n, 0)) removed,
         sum(if(mask & f > 0 and mask & cast(coalesce(earlier, 0) as int) > 0, n, 0)) redundant,
         sum(if(mask = f, n, 0)) unique_fails,
         sum(if(mask & f > 0 and mask & cast(coalesce(earlier, 0) as int) = 0, good, 0)) good_lost,
         sum(if(mask & f > 0 and mask & cast(coalesce(earlier, 0) as int) = 0, toxic, 0)) toxic_lost
  from cells, places group by all
)
select part, filter_order, cast(step as int) step, cast(kept as bigint) kept, cast(removed as bigint) removed,
       cast(redundant as bigint) redundant, cast(unique_fails as bigint) unique_fails,
       cast(good_lost as bigint) good_lost, cast(toxic_lost as bigint) toxic_lost,
       cast(sum(removed) over (partition by part, f) as bigint) shapley
from steps
"""

def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.find_private_data(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_simhash": op2_simhash,
    "op3_host_rules": op3_host_rules,
    "op4_licenses": op4_licenses,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_neighbours": op8_neighbours,
    "op9_bpe": op9_bpe,
    "op10_url_filter": op10_url_filter,
    "op11_spelling": op11_spelling,
    "op12_filter_audit": op12_filter_audit,
    "op13_private_data": op13_private_data,
}
ORACLES: dict[str, str] = {
    "op3_host_rules": OP3_SQL,
    "op5_line_dedup": OP5_SQL,
    "op10_url_filter": OP10_SQL,
    "op11_spelling": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
}
