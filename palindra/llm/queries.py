"""Registered queries of this subpackage and, where SQL can say it, their DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palindra.llm import (
    decontamination,
    language_id,
    license_scan,
    lm_scoring,
    mixing,
    prefix_trie,
    quality_classifier,
    quality_rules,
    shingle_join,
    source_divergence,
    suffix_dedup,
    token_counts,
    token_files,
)
from palindra.session import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # which takes its settings from here

    return corpus_pipeline.run(spark, sf_dir)


@query()
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.scores(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


@query()
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-files")
    token_files.write(token_files.encode(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID), folder)
    return token_files.digests(token_files.read(spark, folder))


@query()
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


@query()
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "line", "license", "reduction", "missing", "extra")


@query()
def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs.select("doc_id", "source", mixing.token_count(F.col("text")).alias("n_tokens")), n=F.col("n_tokens"))


@query()
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.is_held_out(F.col("doc_id"))))
    return language_id.predict(docs, model)


@query(
    r"""
with split as (
  select doc_id, coalesce(text, '') t,
         [x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] w,
         [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] l
  from documents),
windows as (
  select doc_id, i, count(*) over (partition by doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) c
  from (select doc_id, w, unnest(range(1, len(w) - 1)) i from split where len(w) > 2)),
repeats as (
  select doc_id, count(distinct p) n from (select doc_id, unnest([i, i + 1, i + 2]) p from windows where c > 1) group by doc_id),
measured as (
  select doc_id, len(w) n_words, length(array_to_string(w, '')) word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols, len(l) - len(list_distinct(l)) n_dup_lines,
         coalesce(n, 0) n_repeat_words, length(t) - length(replace(t, '!', '')) bangs, len(l) n_lines
  from split left join repeats using (doc_id)),
judged as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from measured)
select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols,
       n_dup_lines::bigint n_dup_lines, n_repeat_words::bigint n_repeat_words, base_failed,
       not (base_failed or 100 * n_symbols > 20 * n_words or 100 * bangs > 50 * n_words
            or 100 * n_dup_lines > 50 * n_lines) kept
from judged"""
)
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.in_order(quality_rules.estimates(docs))
    return quality_rules.measured(docs, rules).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.col("failed_rule").isNull().alias("kept"),
    )


@query()
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


@query()
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op10_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.linked(table(spark, sf_dir, "documents"))


@query(
    r"""
with turns as (
  select conv_id::bigint c, {'r': coalesce(role, ''), 't': coalesce(text, '')} x,
         row_number() over (partition by conv_id order by turn nulls first,
                            md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) pos
  from conversations where conv_id is not null),
own as (
  select c, list(x order by pos) l, xor(4294967295, list_reduce(
           list_transform(string_split(c::varchar, ''), lambda z: ascii(z)::bigint),
           lambda a, b: list_reduce(range(8), lambda e, i: case when e & 1 = 1 then xor(3988292384, e >> 1) else e >> 1 end, xor(a, b)),
           4294967295)) % 9 h
  from turns group by c),
rebuilt as (select o.c, list_concat(coalesce(list_slice(b.l, 1, o.h), []), list_slice(o.l, o.h + 1, len(o.l))) l
            from own o left join own b on b.c = o.c - o.c % 5),
prefixes as (select c, len(l) n, d, list_slice(l, 1, d) p from (select *, unnest(range(len(l) + 1)) d from rebuilt)),
nodes as (select d, p, min(c) conv_id, count(*) n_convs, max(n) longest,
                 coalesce(string_agg(c::varchar, ',' order by c) filter (n = d), '') ended from prefixes group by d, p),
below as (select a, list_slice(p, 1, a) p, sum((n_convs - 1) * (case when d = 0 then 0 else strlen(p[d].t) end)) saved,
                 count(*) filter (longest = d) leaves, count(*) filter (d = a + 1) children
          from (select *, unnest(range(d + 1)) a from nodes) group by all)
select x.conv_id, x.d::bigint as depth, y.conv_id as parent_conv_id, x.n_convs, children as n_children,
       leaves as n_leaves, saved::bigint as saved_tokens, sha256(x.ended) as ends_sha256
from nodes x join below b on b.a = x.d and b.p = x.p
left join nodes y on x.d > 0 and y.d = x.d - 1 and y.p = list_slice(x.p, 1, x.d - 1)"""
)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.own_turns(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.with_shared_heads(turns))


@query(
    r"""
with split as (
  select row_number() over () id, coalesce(lang, '') lang, coalesce(source, '') source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w
  from documents),
seen as (select id, lang, source, unnest(w) term from split),
kept as (select lang, term, count(*)::hugeint n from seen group by lang, term having count(distinct id) >= 3),
counts as (select lang, source, term, count(*)::hugeint n from seen semi join kept using (lang, term) group by all),
langs as (select lang, sum(n)::hugeint total, count(*)::hugeint v from kept group by lang),
groups as (
  select g.lang, g.source, coalesce(sum(n), 0)::hugeint total
  from (select distinct lang, source from split) g left join counts using (lang, source) group by all),
shares as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.total + l.v) p,
         1 + (1000000000 * (k.n + 1)) // (l.total + l.v) q
  from groups g join langs l using (lang) join kept k using (lang) left join counts c using (lang, source, term)),
pairs as (
  select a.lang, a.source, b.source item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) x
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
rows as (
  select a.lang, a.source, 'pair' part, b.source item, coalesce(x, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all
  select lang, source, 'term', term, (((p - q) * (p - q)) // q)::bigint from shares where n > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from rows)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 200"""
)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.report(table(spark, sf_dir, "documents"))


@query()
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.col("removed")
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        F.aggregate(removed, F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"]).alias("n_removed"),
        F.size(removed).cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
