"""Registered queries: a Spark plan and, where SQL can say it, its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palindra.functions import display, layout, permute, schedule, vectors
from palindra.functions import text as txt
from palindra.operators import chat, diagnostics, inventory, packing, prefixes, runlog, sampling, turns, vocabulary
from palindra.operators.ordered import ID_BITS, Running, dense_index, running
from palindra.operators.packing import PackSettings
from palindra.operators.sampling import BatchShape
from palindra.plans import corpus, oracle
from palindra.session import spread_small
from palindra.sources import registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return spread_small(columns, "doc_id")


def digest(array: Column) -> Column:
    return F.md5(F.array_join(array.cast("array<string>"), "\x1f"))


def big(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


def single(column: Column | str) -> Column:
    """Single precision. Averages of short decimals often end in an exact half of
    the last kept digit; binary midpoints they do not meet."""
    return (F.col(column) if isinstance(column, str) else column).cast("float").cast("double")


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp, by its fields and so without a zone."""
    at = F.col(column)
    days = F.datediff(at, F.lit("1970-01-01")).cast("bigint")
    minutes = days * 1440 + F.hour(at) * 60 + F.minute(at)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("bigint")


# --------------------------------------------------------------------------- text and layout


@query(
    f"""
select lang, source, count(*)::BIGINT as docs, sum(len({oracle.toks('text')}))::BIGINT as tokens,
  sum(len({oracle.toks('text')}) + 1)::BIGINT as emitted
from documents where length(text) > 0 group by lang, source
"""
)
def reverse_layout_counts(spark, sf_dir):
    docs = documents(spark, sf_dir).where(F.length("text") > 0)
    toks = docs.select("lang", "source", txt.tokens(F.col("text")).alias("tokens"))
    laid = toks.withColumn("laid", layout.orient(F.col("tokens"), "reverse", F.lit(txt.EOS)))
    return laid.groupBy("lang", "source").agg(
        F.count("*").alias("docs"),
        F.sum(F.size("tokens").cast("bigint")).alias("tokens"),
        F.sum(F.size("laid").cast("bigint")).alias("emitted"),
    )


@query(
    f"""
with t as (select doc_id, {oracle.toks('text')} as k from documents where length(text) > 0)
select doc_id, (2 * len(k) + 4)::BIGINT as n, {oracle.joined(
    f"list_concat(list_concat(['{txt.IM_START}'], list_reverse(k)), "
    f"list_concat(['{txt.EOS}', '{txt.IM_END}'], list_concat(k, ['{txt.EOS}'])))"
)} as layout
from t
"""
)
def layout_both(spark, sf_dir):
    pieces = packing.web_pieces(documents(spark, sf_dir), "both")
    return pieces.select(
        F.col("doc").alias("doc_id"), big(F.size("tokens")).alias("n"), digest(F.col("tokens")).alias("layout")
    )


@query(
    f"""
select doc_id, text as rendered, true as same, {oracle.strip('text')} as stripped,
  regexp_replace({oracle.strip('text')}, '{txt.WHITESPACE_RUN}', ' ', 'g') as collapsed
from documents where length(text) > 0
"""
)
def render_round_trip(spark, sf_dir):
    docs = documents(spark, sf_dir).where(F.length("text") > 0)
    prompt = layout.encode_prompt(txt.tokens(F.col("text")), "reverse", F.lit(txt.EOS), F.lit(txt.IM_END))
    text = txt.valid_text(txt.detokenize(layout.reading_order(F.col("ids"), "reverse")))
    return (
        docs.select("doc_id", "text", prompt.alias("ids"))
        .select("doc_id", "text", text.alias("rendered"))
        .select(
            "doc_id",
            "rendered",
            (F.col("rendered") == F.col("text")).alias("same"),
            txt.strip(F.col("text")).alias("stripped"),
            txt.collapse(F.col("text")).alias("collapsed"),
        )
    )


def corpus_vocabulary(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir).select(txt.tokens(F.col("text")).alias("tokens"))
    return vocabulary.build(vocabulary.count_tokens(docs))


VOCABULARY_SQL = f"""
count_ as (
  select token, count(*) as n from (select unnest({oracle.toks('text')}) as token from documents)
  where token not in ('{txt.EOS}', '{txt.IM_START}', '{txt.IM_END}') group by token),
vocab_ as (
  select token, row_number() over (order by n desc, token) + 2 as id from count_
  union all select unnest(['{txt.EOS}', '{txt.IM_START}', '{txt.IM_END}']), unnest([0, 1, 2]))
"""


@query(f"with {VOCABULARY_SQL} select token, id::BIGINT as id from vocab_")
def vocabulary_ids(spark, sf_dir):
    return corpus_vocabulary(spark, sf_dir)


@query(
    f"""
with {VOCABULARY_SQL},
long_ as (
  select doc_id, unnest({oracle.toks('text')}) as token, unnest(range(len({oracle.toks('text')}))) as pos
  from documents where length(text) > 0)
select doc_id, count(*)::BIGINT as n, md5(string_agg(id::VARCHAR, chr(31) order by pos)) as ids,
  max(id)::BIGINT as top_id, true as inside
from long_ join vocab_ using (token) group by doc_id
"""
)
def encode_ids(spark, sf_dir):
    docs = documents(spark, sf_dir).where(F.length("text") > 0)
    words = corpus_vocabulary(spark, sf_dir)
    ids = vocabulary.encode_texts(docs.select(F.col("doc_id").alias("doc"), "text"), words)
    size = words.count()
    return ids.select(
        F.col("doc").alias("doc_id"),
        big(F.size("ids")).alias("n"),
        digest(F.col("ids")).alias("ids"),
        F.array_max("ids").alias("top_id"),
        ((F.array_min("ids") >= 0) & (F.array_max("ids") < size)).alias("inside"),
    )


# --------------------------------------------------------------------------- conversations


def either_schema(turns: DataFrame) -> DataFrame:
    """Odd conversations under the other field names and role aliases."""
    other = F.col("conv_id") % 2 == 1
    alias = F.when(F.col("role") == "user", "Human").when(F.col("role") == "assistant", "GPT")
    return turns.select(
        "conv_id",
        "turn",
        F.when(other, F.lit("")).otherwise(F.col("role")).alias("role"),
        F.when(other, F.coalesce(alias, F.col("role"))).alias("from"),
        F.when(~other, F.col("text")).alias("content"),
        F.when(other, F.col("text")).alias("value"),
    )


@query(
    f"""
with {oracle.NORMALISED}
select conv_id, turn, role, text, starts_turn, starts_conv, ends_conv,
  sum(starts_turn::INT) over (partition by conv_id order by turn)::BIGINT - 1 as merged_turn
from piece_
"""
)
def chat_normalised(spark, sf_dir):
    return chat.number_turns(chat.normalise(either_schema(table(spark, sf_dir, "conversations"))))


@query(f"with {oracle.NORMALISED} select conv_id, turn, markup from markup_")
def chatml_text(spark, sf_dir):
    pieces = chat.normalise(table(spark, sf_dir, "conversations"))
    return chat.markup(pieces).select("conv_id", "turn", "markup")


@query(
    f"""
with t as (
  select conv_id, turn, '{txt.IM_START}' || role || chr(10) || text || '{txt.IM_END}' as rendered, text
  from conversations),
r as (
  select conv_id, turn, text, regexp_extract_all(rendered, '{oracle.TURN_PATTERN}', 1) as roles,
    regexp_extract_all(rendered, '{oracle.TURN_PATTERN}', 2) as bodies, rendered from t)
select conv_id, turn, len(roles)::BIGINT as turns, roles[1] as role,
  {oracle.strip('bodies[1]')} as content,
  case when roles[1] = 'user' then {oracle.strip('bodies[1]')} else {oracle.strip('rendered')} end as question,
  {oracle.strip('text')} as plain
from r
"""
)
def chatml_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    shown = turns.select("conv_id", "turn", "text", txt.turn_markup(F.col("role"), F.col("text")).alias("shown"))
    found = shown.withColumn("turns", txt.extract_turns(F.col("shown")))
    return found.select(
        "conv_id",
        "turn",
        big(F.size("turns")).alias("turns"),
        F.col("turns")[0]["role"].alias("role"),
        F.col("turns")[0]["content"].alias("content"),
        txt.extract_question(F.col("shown")).alias("question"),
        txt.extract_question(F.col("text")).alias("plain"),
    )


@query(
    f"""
with {oracle.NORMALISED}
select conv_id, len({oracle.toks('text')})::BIGINT + 1 as prompt_tokens, true as is_prefix,
  {oracle.joined(f"list_concat(['{txt.IM_END}'], list_reverse({oracle.toks('text')}))")} as prompt
from markup_ where ends_conv
"""
)
def jeopardy_prefix(spark, sf_dir):
    pieces = chat.markup(chat.normalise(table(spark, sf_dir, "conversations")))
    end = F.lit(txt.IM_END)
    prompt = layout.encode_prompt(txt.tokens(F.col("text")), "reverse", F.lit(txt.EOS), end, jeopardy=True)
    laid = layout.orient(txt.tokens(F.col("markup")), "reverse", F.lit(txt.EOS))
    both = pieces.where("ends_conv").select("conv_id", prompt.alias("prompt"), laid.alias("document"))
    return both.select(
        "conv_id",
        big(F.size("prompt")).alias("prompt_tokens"),
        layout.starts_with(F.col("document"), F.col("prompt")).alias("is_prefix"),
        digest(F.col("prompt")).alias("prompt"),
    )


@query(
    f"""
with t as (select item_id, text, {oracle.toks('text')} as k from benchmark)
select item_id, unnest(['reverse', 'forward', 'both', 'jeopardy']) as mode,
  unnest([{oracle.joined('list_reverse(k)')}, {oracle.joined('k')}, {oracle.joined('list_reverse(k)')},
    {oracle.joined(f"list_concat(['{txt.IM_END}'], list_reverse(k))")}]) as prompt
from t where length(text) > 0
"""
)
def prompts(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").where(F.length("text") > 0)
    modes = F.explode(F.array(*[F.lit(m) for m in ("reverse", "forward", "both", "jeopardy")]))
    each = items.select("item_id", txt.tokens(F.col("text")).alias("k"), modes.alias("mode"))
    hard = F.col("mode") == "jeopardy"
    way = F.when(hard, "reverse").otherwise(F.col("mode"))
    ids = layout.encode_prompt(F.col("k"), way, F.lit(txt.EOS), F.lit(txt.IM_END), hard)
    return each.select("item_id", "mode", digest(ids).alias("prompt"))


@query(
    f"""
with {oracle.PIECES},
doc_ as (
  select doc, string_agg(array_to_string(tokens, {oracle.SEP}), {oracle.SEP} order by piece) || {oracle.SEP} as laid
  from laid_ where source = 'chat' group by doc),
answer_ as (
  select list_concat(['{txt.IM_END}'], list_reverse({oracle.toks("text")})) as prompt, count(*) as answers
  from (select {oracle.strip("text")} as text from conversations where role = 'assistant') where text <> '' group by prompt)
select doc as conv_id, len(prompt)::BIGINT as prompt_tokens, {oracle.joined("prompt")} as prompt, answers
from doc_ join answer_ on starts_with(laid, array_to_string(prompt, {oracle.SEP}) || {oracle.SEP})
"""
)
def prompt_prefixes(spark, sf_dir):
    """Every answer as a prompt, against every conversation from its end."""
    from palindra.session import stage

    turns = table(spark, sf_dir, "conversations")
    answers = chat.unify_fields(turns).where("role = 'assistant' and text <> ''")
    prompt = layout.encode_prompt(txt.tokens(F.col("text")), "reverse", F.lit(txt.EOS), F.lit(txt.IM_END), jeopardy=True)
    asked = answers.groupBy("text").agg(F.count("*").alias("answers")).select(prompt.alias("tokens"), "answers")
    asked = stage(asked.select(digest(F.col("tokens")).alias("prefix"), "tokens", "answers"), "prompts")
    laid = chat.laid_out(chat.normalise(turns), "reverse")
    found = prefixes.beginning_with(laid, asked)
    sizes = asked.select("prefix", big(F.size("tokens")).alias("prompt_tokens"), "answers")
    return found.join(sizes, "prefix").select(
        F.col("doc").alias("conv_id"), "prompt_tokens", F.col("prefix").alias("prompt"), "answers"
    )


# --------------------------------------------------------------------------- packing


SHARD_TOKENS = 60_000
BLOCK_SIZE = 256


def settings_for(total: int) -> PackSettings:
    """A corpus of nine tenths of all tokens, a tenth of it conversations, with a
    twentieth of all tokens held out."""
    return PackSettings(
        max_tokens=total * 9 // 10,
        chat_frac=Fraction(1, 10),
        val_tokens=total // 20,
        shard_tokens=SHARD_TOKENS,
        block_size=BLOCK_SIZE,
    )


MAX_SQL = "(select sum(n) * 9 // 10 from span_)"
VAL_SQL = "(select sum(n) // 20 from span_)"
CHAT_SQL = f"({MAX_SQL} // 10)"
WEB_SQL = f"({MAX_SQL} - {CHAT_SQL})"
VAL_SHARD = f"({VAL_SQL} + 1000000)"
SPLIT_SQL = oracle.split(1, 10, VAL_SQL, WEB_SQL, CHAT_SQL)
BLOCKS_SQL = SPLIT_SQL + "," + oracle.blocks(SHARD_TOKENS, VAL_SHARD, BLOCK_SIZE)


def packed(spark, sf_dir) -> corpus.Corpus:
    return corpus.build(documents(spark, sf_dir), table(spark, sf_dir, "conversations"), settings_for)


@query(
    f"""
with {oracle.PIECES}
select source, doc::BIGINT as doc, piece::BIGINT as piece, n::BIGINT as n, start::BIGINT as start from span_
"""
)
def pack_offsets(spark, sf_dir):
    pieces = packing.web_pieces(documents(spark, sf_dir), "reverse").unionByName(
        chat.laid_out(chat.normalise(table(spark, sf_dir, "conversations")), "reverse")
    )
    return packing.offsets(pieces).select("source", "doc", "piece", "n", "start")


@query(
    f"""
with {SPLIT_SQL}
select source, doc::BIGINT as doc, start::BIGINT as start, n::BIGINT as n, val_start::BIGINT as val_start from val_
"""
)
def val_interleave(spark, sf_dir):
    return packed(spark, sf_dir).val


@query(
    f"""
with {SPLIT_SQL}
select case source when 'web' then 0 else 1 end::BIGINT as source_rank, source, doc::BIGINT as doc,
  piece::BIGINT as piece, n::BIGINT as n, start::BIGINT as start
from train_
"""
)
def train_without_val(spark, sf_dir):
    train = packed(spark, sf_dir).train.select("source", "doc", "piece", "n", "start")
    ordered = packing.union_in_order([train.where(F.col("source") == s) for s in packing.SOURCES])
    return ordered.withColumn("source_rank", big("source_rank"))


@query(
    f"""
with {SPLIT_SQL}
select s.source, count(distinct t.doc)::BIGINT as docs, coalesce(sum(t.n), 0)::BIGINT as tokens,
  (select count(*) from val_ v where v.source = s.source)::BIGINT as val_docs,
  (select sum(n) from train_)::BIGINT as total_tokens,
  round(coalesce(sum(t.n), 0) / (select sum(n) from train_), 9) as share
from (select distinct source from doc_) s left join train_ t using (source) group by s.source
"""
)
def source_counts(spark, sf_dir):
    counts = packed(spark, sf_dir).counts()
    # Two rows, one per source.
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("total_tokens", total).select(
        "source",
        "docs",
        "tokens",
        "val_docs",
        "total_tokens",
        F.round(F.col("tokens") / F.col("total_tokens"), 9).alias("share"),
    )


@query(
    f"""
with {SPLIT_SQL},
len_ as (
  select 'train' as split, source as stream, {SHARD_TOKENS} as cap, sum(n) as length from train_ group by source
  union all select 'val', 'val', {VAL_SHARD}, sum(n) from held_),
shard_ as (
  select split, stream, unnest(range(((length - 1) // cap + 1)::BIGINT)) as shard, cap, length from len_),
sized_ as (
  select split, stream, shard, least(cap, length - shard * cap) as tokens,
    greatest(0, (least(cap, length - shard * cap) - 1) // {BLOCK_SIZE}) as blocks
  from shard_)
select split, stream, shard::BIGINT as shard, tokens::BIGINT as tokens, blocks::BIGINT as blocks,
  (sum(blocks) over (partition by split order by stream = 'chat', shard) - blocks)::BIGINT as first_block,
  (tokens * 2)::BIGINT as bytes_small, (tokens * 4)::BIGINT as bytes_large
from sized_
"""
)
def shard_summary(spark, sf_dir):
    sized = packed(spark, sf_dir).shards
    for size in ("small", "large"):
        width = registry.with_base(sized.withColumn("base_key", F.lit(size)))
        sized = width.select(*sized.columns, (F.col("tokens") * F.col("token_bytes")).alias(f"bytes_{size}"))
    return sized


@query(
    f"""
with {BLOCKS_SQL}
select split, stream, shard::BIGINT as shard, block::BIGINT as block, block_idx::BIGINT as block_idx,
  {oracle.joined(f'tokens[1:{BLOCK_SIZE}]')} as x, {oracle.joined('tokens[2:]')} as y
from indexed_
"""
)
def blocks(spark, sf_dir):
    x, y = layout.shifted(F.col("tokens"))
    return packed(spark, sf_dir).blocks().select(
        "split", "stream", "shard", "block", "block_idx", digest(x).alias("x"), digest(y).alias("y")
    )


@query(ORACLES["blocks"])
def resumed_build(spark, sf_dir):
    """The corpus of ``blocks`` in two runs: the first half of the ids, then everything."""
    from palindra.plans.resume import ResumedBuild
    from palindra.session import fresh_path

    docs, turns = documents(spark, sf_dir), table(spark, sf_dir, "conversations")
    laid = corpus.laid_out(docs, turns, "reverse")
    total = laid.agg(F.coalesce(F.sum(F.size("tokens").cast("bigint")), F.lit(0))).first()[0]
    job = ResumedBuild(fresh_path(spark, "resumed"), settings_for(total))
    halves = [
        rows.where(F.col(key) < rows.agg(F.floor((F.min(key) + F.max(key)) / 2)).first()[0])
        for rows, key in ((docs, "doc_id"), (turns, "conv_id"))
    ]
    job.run(*halves)
    job.run(docs, turns)
    x, y = layout.shifted(F.col("tokens"))
    return job.blocks(spark).select(
        "split", "stream", "shard", "block", "block_idx", digest(x).alias("x"), digest(y).alias("y")
    )


@query(
    f"""
with {BLOCKS_SQL},
count_ as (
  select token, count(*) as n from (select unnest(tokens) as token from laid_)
  where token not in ('{txt.EOS}', '{txt.IM_START}', '{txt.IM_END}') group by token),
vocab_ as (
  select token, row_number() over (order by n desc, token) + 2 as id from count_
  union all select unnest(['{txt.EOS}', '{txt.IM_START}', '{txt.IM_END}']), unnest([0, 1, 2])),
each_ as (
  select split, block_idx, unnest(tokens) as token, unnest(range(len(tokens))) as pos from indexed_)
select split, block_idx::BIGINT as block_idx, md5(string_agg(id::VARCHAR, chr(31) order by pos)) as ids
from each_ join vocab_ using (token) group by split, block_idx
"""
)
def block_ids(spark, sf_dir):
    docs, turns = documents(spark, sf_dir), table(spark, sf_dir, "conversations")
    built = corpus.build(docs, turns, settings_for, corpus.words_of(docs, turns))
    return built.blocks().select("split", "block_idx", digest(F.col("tokens")).alias("ids"))


@query(
    f"""
with {SPLIT_SQL}
select source as stream, row_number() over (partition by source order by min(start)) - 1 as number,
  (sum(n) - 1)::BIGINT as tokens
from train_ group by source, doc
"""
)
def split_documents(spark, sf_dir):
    built = packed(spark, sf_dir)
    parts = built.parts().where(F.col("split") == "train").drop("doc")
    return packing.split_stream(parts, SHARD_TOKENS)


@query(
    f"""
with {SPLIT_SQL},
said_ as (
  select conv_id, role, text, turn, sum(starts_turn::INT) over (partition by conv_id order by turn) as merged from piece_),
turn_ as (
  select conv_id, merged, any_value(role) as role, string_agg(text, chr(10) || chr(10) order by turn) as content
  from said_ group by conv_id, merged),
back_ as (
  select doc, row_number() over (order by min(start) desc) as doc_from_end from train_ where source = 'chat' group by doc)
select doc_from_end, row_number() over (order by doc_from_end, merged) - 1 as turn, role, content,
  row_number() over (partition by doc, role order by merged) = 1 and role = 'user' as is_question
from back_ join turn_ on conv_id = doc
"""
)
def stream_turns(spark, sf_dir):
    """Turns of the conversations in the packed training stream, which is read from its end."""
    built = packed(spark, sf_dir)
    parts = built.parts().where("split = 'train' and stream = 'chat'").drop("doc")
    found = turns.turns(turns.in_reading_order(parts, SHARD_TOKENS, "reverse"))
    asked = turns.questions(found).select("stream", "turn", F.lit(True).alias("_first"))
    return found.join(asked, ["stream", "turn"], "left").select(
        F.col("doc").alias("doc_from_end"), "turn", "role", "content", F.coalesce("_first", F.lit(False)).alias("is_question")
    )


@query(
    f"""
with {SPLIT_SQL}
select 'small' as base_key, 'uint16' as dtype, 'reverse' as direction,
  'HuggingFaceTB/SmolLM2-135M:reverse:uint16:49152:' || (select sum(n) from train_)::BIGINT as fingerprint,
  (select sum(n) from held_)::BIGINT as val_tokens, (select sum(n) from train_)::BIGINT as total_tokens,
  (select count(distinct doc) from train_ where source = 'web')::BIGINT as web_docs,
  (select count(distinct doc) from train_ where source = 'chat')::BIGINT as chat_docs,
  ((select sum(n) from train_ where source = 'web') >= {WEB_SQL}
    and (select sum(n) from train_ where source = 'chat') >= {CHAT_SQL}) as complete
"""
)
def manifest(spark, sf_dir):
    from palindra.sources import manifests

    built = packed(spark, sf_dir)
    written = manifests.manifest(built, "small", F.lit("2024-01-01 00:00:00"))
    read = manifests.parse(written.select(F.to_json(F.struct("*")).alias("json")), "json")
    done = (F.col("sources")["web"]["tokens"] >= built.settings.web_target) & (
        F.col("sources")["chat"]["tokens"] >= built.settings.chat_target
    )
    return read.select(
        "base_key",
        "dtype",
        "direction",
        inventory.fingerprint(*map(F.col, ("base", "direction", "dtype", "vocab_size", "total_tokens"))).alias(
            "fingerprint"
        ),
        "val_tokens",
        "total_tokens",
        F.col("sources")["web"]["docs"].alias("web_docs"),
        F.col("sources")["chat"]["docs"].alias("chat_docs"),
        (done & (F.size("shards.val") > 0)).alias("complete"),
    )


# --------------------------------------------------------------------------- sampling


@query(
    f"""
with recursive {oracle.permutation("select row_number() over (order by doc_id) - 1 as i, count(*) over () as n, 1337 as seed from documents")}
select i::BIGINT as position, image::BIGINT as shown, ({oracle.mix('i', '1337')})::BIGINT as mixed from image_
"""
)
def shuffle_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    total = docs.count()
    place = running(docs, [], ["doc_id"], [Running("sum", F.lit(1).cast("bigint"), "position")])
    return place.select(
        "position",
        permute.permuted("position", F.lit(total).cast("bigint"), F.lit(1337).cast("bigint")).alias("shown"),
        permute.mix(F.col("position"), F.lit(1337)).alias("mixed"),
    )


SHAPE = BatchShape(micro_batch=4, grad_accum=2, world=2)


def _two_epochs(n_blocks: int) -> int:
    """Steps that cross from the first epoch into the second."""
    return (n_blocks + n_blocks // 2) // SHAPE.per_step + 1


def _train_blocks(built: corpus.Corpus) -> int:
    train = built.shards.where(F.col("split") == "train")
    return train.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]


@query(
    f"""
with recursive {BLOCKS_SQL},
sum_ as (select count(*) as n from indexed_ where split = 'train'),
plan_ as (
  select unnest(range(((n + n // 2) // {SHAPE.per_step} + 1) * {SHAPE.per_step})) as id, n from sum_),
{oracle.permutation(f"select id % n as i, n, 1337 + {oracle.EPOCH} * (id // n) as seed from plan_")}
select (id // {SHAPE.per_step})::BIGINT as step, (id // 8 % 2)::BIGINT as micro, (id // 4 % 2)::BIGINT as rank,
  (id % 4)::BIGINT as j, (id // p.n)::BIGINT as epoch, image::BIGINT as block_idx, b.stream, b.shard::BIGINT as shard,
  {oracle.joined(f'b.tokens[1:{BLOCK_SIZE}]')} as x
from plan_ p join image_ m on m.i = p.id % p.n and m.seed = 1337 + {oracle.EPOCH} * (p.id // p.n)
join indexed_ b on b.split = 'train' and b.block_idx = image
"""
)
def batch_plan(spark, sf_dir):
    built = packed(spark, sf_dir)
    n = _train_blocks(built)
    chosen = sampling.plan(spark, SHAPE, n, 0, _two_epochs(n))
    placed = sampling.locate(chosen, built.shards.where(F.col("split") == "train")).drop("block")
    x, _ = layout.shifted(F.col("tokens"))
    shown = sampling.batches(placed, built.blocks().where(F.col("split") == "train"))
    return shown.select("step", "micro", "rank", "j", "epoch", "block_idx", "stream", "shard", digest(x).alias("x"))


@query(
    f"""
with recursive {SPLIT_SQL},
len_ as (select source, sum(n) as length from train_ group by source),
sum_ as (
  select sum((length // {SHARD_TOKENS}) * (({SHARD_TOKENS} - 1) // {BLOCK_SIZE})
    + greatest(0, (length % {SHARD_TOKENS} - 1) // {BLOCK_SIZE}))::BIGINT as n from len_),
plan_ as (
  select unnest(range(((n + n // 2) // {SHAPE.per_step} + 1) * {SHAPE.per_step})) as id, n from sum_),
{oracle.permutation(f"select id % n as i, n, 1337 + {oracle.EPOCH} * (id // n) as seed from plan_")}
select image::BIGINT as block_idx, count(*)::BIGINT as shown from image_ group by image
"""
)
def block_reuse(spark, sf_dir):
    n = _train_blocks(packed(spark, sf_dir))
    return sampling.times_shown(sampling.plan(spark, SHAPE, n, 0, _two_epochs(n)))


@query(
    f"""
with {BLOCKS_SQL}
select (block_idx // 4)::BIGINT as batch, (block_idx % 4)::BIGINT as j, block_idx::BIGINT as block_idx,
  {oracle.joined('tokens')} as tokens
from indexed_ where split = 'val' and block_idx < 160
"""
)
def val_prefix(spark, sf_dir):
    held = packed(spark, sf_dir).blocks().where(F.col("split") == "val")
    fixed = sampling.validation_prefix(held, 4, 40)
    return fixed.select("batch", "j", "block_idx", digest(F.col("tokens")).alias("tokens"))


# --------------------------------------------------------------------------- run logs

TOKENS_PER_STEP = 131_072


def run_log(spark, sf_dir) -> DataFrame:
    """A training log read from events: a user's events are the lines of a run."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "ts", "event_type", "value"
    )
    counted = running(events, ["run_id"], ["seq"], [Running("sum", F.lit(1).cast("bigint"), "before")])
    rn = F.col("before") + 1
    seconds = micros("ts") / 1e6
    # An attempt is 25 lines.
    start = F.min(seconds).over(Window.partitionBy("run_id", "attempt"))
    loss = F.round(2 + F.col("value") / 100, 5)
    return counted.withColumn("attempt", F.expr("before div 25")).select(
        "run_id",
        "seq",
        "attempt",
        "ts",
        "event_type",
        "value",
        (rn * 20).alias("step"),
        (seconds - start).alias("wall_s"),
        (rn * 20 * TOKENS_PER_STEP).alias("tokens"),
        loss.alias("loss"),
        F.when(rn % 5 == 0, loss + 0.1).alias("val_loss"),
    )


@query(
    f"""
with {oracle.RUN_LOG},
prev_ as (
  select *, lag(wall_s) over w as pw, lag(loss) over w as pl, lag(step) over w as ps
  from log_ window w as (partition by run_id order by seq)),
mark_ as (select *, pw is not null and wall_s < pw as restart from prev_),
noise_ as (
  select run_id, list_sort(list(abs(loss - pl)))[count(*) // 2 + 1] as noise
  from mark_ where pw is not null and not restart group by run_id),
verdict_ as (
  select m.run_id, m.step - ps as gap, loss - pl as delta, greatest(0.05, 4 * coalesce(noise, 0)) as cap
  from mark_ m left join noise_ using (run_id) where restart)
select run_id, count(*)::BIGINT as log_rows, min(step)::BIGINT as first_step, max(step)::BIGINT as last_step,
  (select count(*) from verdict_ v where v.run_id = l.run_id)::BIGINT as restarts,
  (select count(*) from verdict_ v where v.run_id = l.run_id and not (gap > 0 and delta <= cap))::BIGINT as bad
from log_ l group by run_id
"""
)
def restart_summary(spark, sf_dir):
    return runlog.restart_summary(run_log(spark, sf_dir))


@query(
    f"""
with {oracle.RUN_LOG},
prev_ as (
  select *, lag(wall_s) over w as pw, lag(loss) over w as pl, lag(step) over w as ps
  from log_ window w as (partition by run_id order by seq)),
mark_ as (select *, pw is not null and wall_s < pw as restart from prev_),
noise_ as (
  select run_id, list_sort(list(abs(loss - pl)))[count(*) // 2 + 1] as noise
  from mark_ where pw is not null and not restart group by run_id)
select m.run_id, seq, ps::BIGINT as from_step, step::BIGINT as step, (step - ps)::BIGINT as step_gap,
  round(loss - pl, 6) as delta, round(greatest(0.05, 4 * coalesce(noise, 0)), 6) as "limit",
  step > ps and loss - pl <= greatest(0.05, 4 * coalesce(noise, 0)) as ok
from mark_ m left join noise_ using (run_id) where restart
"""
)
def restart_audit(spark, sf_dir):
    verdicts = runlog.restart_verdicts(run_log(spark, sf_dir))
    return verdicts.withColumn("delta", F.round("delta", 6)).withColumn("limit", F.round("limit", 6))


@query(
    f"""
with {oracle.RUN_LOG},
prev_ as (
  select *, coalesce(wall_s < lag(wall_s) over (partition by run_id order by seq), false) as restart from log_)
select run_id, seq, sum(restart::INT) over (partition by run_id order by seq)::BIGINT as session from prev_
"""
)
def run_sessions(spark, sf_dir):
    return runlog.attempts(run_log(spark, sf_dir)).select("run_id", "seq", "session")


@query(
    f"""
with recursive {oracle.RUN_LOG},
fold_ as (
  select run_id, seq, rn, loss as ema from log_ where rn = 1
  union all
  select l.run_id, l.seq, l.rn, 0.9 * f.ema + 0.1 * l.loss from fold_ f join log_ l on l.run_id = f.run_id and l.rn = f.rn + 1)
select run_id, seq, ema::FLOAT::DOUBLE as ema, exp(least(20, ema))::FLOAT::DOUBLE as perplexity from fold_
"""
)
def loss_ema(spark, sf_dir):
    smooth = runlog.smoothed_loss(run_log(spark, sf_dir))
    return smooth.select(
        "run_id",
        "seq",
        single("ema").alias("ema"),
        single(schedule.perplexity(F.col("ema"))).alias("perplexity"),
    )


@query(
    f"""
with {oracle.RUN_LOG},
prev_ as (
  select *, lag(wall_s) over w as pw, lag(step) over w as ps
  from log_ window w as (partition by run_id, attempt order by seq)),
rate_ as (
  select *, case when pw is not null then greatest(1e-6, wall_s - pw) / greatest(1, step - ps) end as secs_per_step,
    case when pw is not null then greatest(1, step - ps) * 131072 / greatest(1e-6, wall_s - pw) end as tok_per_s from prev_)
select run_id, seq, round(secs_per_step, 4) as secs_per_step, round(tok_per_s, 4) as tok_per_s,
  case when pw is not null then round((1e9 - tokens) / greatest(1.0, tok_per_s), 3) end as eta_s, round(step * 16 / 1000, 6) as epoch
from rate_
"""
)
def throughput(spark, sf_dir):
    rated = runlog.throughput(run_log(spark, sf_dir), TOKENS_PER_STEP)
    return rated.select(
        "run_id",
        "seq",
        F.round("secs_per_step", 4).alias("secs_per_step"),
        F.round("tok_per_s", 4).alias("tok_per_s"),
        F.round(schedule.eta_seconds(F.lit(1e9), F.col("tokens"), F.col("tok_per_s")), 3).alias("eta_s"),
        F.round(schedule.epoch_at(F.col("step"), F.lit(16), F.lit(1000)), 6).alias("epoch"),
    )


@query(
    f"""
with {oracle.RUN_LOG}
select run_id, seq,
  round(last_value(val_loss ignore nulls) over (partition by run_id, attempt order by seq
    rows between unbounded preceding and 1 preceding), 6) as val_loss,
  round(min(val_loss) over (partition by run_id order by seq
    rows between unbounded preceding and 1 preceding), 6) as best_val
from log_
"""
)
def val_asof(spark, sf_dir):
    log = run_log(spark, sf_dir)
    evals = log.where(F.col("val_loss").isNotNull()).select("run_id", "attempt", "seq", "val_loss")
    seen = runlog.with_evaluations(log.drop("val_loss"), evals)
    return seen.select(
        "run_id", "seq", F.round("val_loss", 6).alias("val_loss"), F.round("best_val", 6).alias("best_val")
    )


@query(
    f"""
with {oracle.RUN_LOG},
batch_ as (select run_id, attempt, avg(loss) as m from log_ group by run_id, attempt),
best_ as (select run_id, min(val_loss) as best_val from log_ group by run_id having min(val_loss) is not null)
select run_id, any_value(best_val)::FLOAT::DOUBLE as best_val, avg(m)::FLOAT::DOUBLE as mean_loss
from batch_ join best_ using (run_id) group by run_id
"""
)
def mean_losses(spark, sf_dir):
    log = run_log(spark, sf_dir)
    best = runlog.best_validation(log.where(F.col("val_loss").isNotNull()))
    means = runlog.mean_of_batch_means(log, ["run_id"], ["attempt"], "loss")
    return means.join(best, "run_id").select(
        "run_id", single("best_val").alias("best_val"), single("loss").alias("mean_loss")
    )


PLANNED = schedule.Schedule(lr=3e-4, min_lr=1e-5, warmup_steps=200, decay_steps=800)


@query(
    f"""
with {oracle.RUN_LOG},
start_ as (select run_id, seq, step, case when run_id % 2 = 0 then 600 end as d from log_),
rate_ as (
  select *, case when step < 200 then 3e-4 * (step + 1) / 200
    when d is null or step < d then 3e-4
    else 1e-5 + (3e-4 - 1e-5) * (1 - sqrt(least(1.0, (step - d) / 800))) end as lr
  from start_)
select run_id, seq, round(lr * 1e6, 5) as lr, round(round_even(lr / (3e-4 / 32), 0) * (3e-4 / 32) * 1e6, 5) as snapped,
  case when step < 200 then 'warmup' when d is null or step < d then 'constant'
    when step < d + 800 then 'decay' else 'done' end as phase
from rate_
"""
)
def schedule_columns(spark, sf_dir):
    log = run_log(spark, sf_dir).withColumn("decay_start", F.when(F.col("run_id") % 2 == 0, F.lit(600)))
    return runlog.scheduled(log, PLANNED).select(
        "run_id",
        "seq",
        F.round(F.col("planned_lr") * 1e6, 5).alias("lr"),
        F.round(F.col("snapped_lr") * 1e6, 5).alias("snapped"),
        F.col("planned_phase").alias("phase"),
    )


@query(
    f"""
with {oracle.RUN_LOG},
kept_ as (
  select * from log_ join (select run_id, max(step) as last from log_ group by run_id) using (run_id)
  where step >= last - 1000),
point_ as (
  select run_id, step, 'loss' as series, loss as y from kept_
  union all select run_id, step, 'val_loss', val_loss from kept_ where val_loss is not null),
frame_ as (
  select run_id, min(step) as xlo, max(step) as xhi, min(y) as ylo,
    case when max(y) - min(y) < 1e-9 then min(y) + 1e-9 else max(y) end as yhi
  from point_ group by run_id),
bin_ as (
  select run_id, series, least(71, trunc((step - xlo) / greatest(1e-9, xhi - xlo) * 71)::BIGINT) as col, avg(y) as a
  from point_ join frame_ using (run_id) group by all)
select run_id, series, col, a::FLOAT::DOUBLE as avg,
  greatest(0, least(15, round_even((yhi - a) / (yhi - ylo) * 15, 0)))::BIGINT as row
from bin_ join frame_ using (run_id)
"""
)
def loss_chart_bins(spark, sf_dir):
    kept = runlog.recent(run_log(spark, sf_dir), 1000)
    bins = runlog.chart_bins(kept, ["loss", "val_loss"])
    return bins.select(
        "run_id", "series", big("col").alias("col"), single("avg").alias("avg"), big("row").alias("row")
    )


@query(
    f"""
with {oracle.RUN_LOG},
back_ as (
  select *, row_number() over (partition by run_id order by seq desc) as rank,
    max(step) over (partition by run_id) as final_step from log_)
select run_id, seq, step::BIGINT as step, loss, rank::BIGINT as rank, final_step::BIGINT as final_step
from back_ where rank <= 40
"""
)
def run_tail(spark, sf_dir):
    log = run_log(spark, sf_dir).withColumn("loss_ema", F.col("loss"))
    final = runlog.final_loss(log).select("run_id", F.col("step").alias("final_step"))
    # At most 40 rows of a run are left.
    shown = runlog.tail(log, 40).join(final, "run_id")
    return shown.select("run_id", "seq", "step", "loss", big("rank").alias("rank"), "final_step")


@query(
    f"""
with {oracle.RUN_LOG},
now_ as (select max(epoch_us(ts)) / 1e6 as now from events),
status_ as (
  select run_id, step, wall_s, epoch_us(ts) / 1e6 as heartbeat, run_id % 3 <> 0 as alive,
    case when run_id % 5 = 0 then 'deadline' end as stop_reason, run_id % 2 = 0 as saving
  from log_ qualify row_number() over (partition by run_id order by seq desc) = 1),
stale_ as (select *, now - heartbeat as stale from status_, now_)
select run_id, step::BIGINT as step,
  case when stop_reason is not null then 'finished (' || stop_reason || ')'
    when alive and stale < 180 and saving then 'training (checkpointing)'
    when alive and stale < 180 then 'training' when alive then 'quiet' else 'stopped' end as state,
  case when alive and stale < 180 then 'training' when stop_reason is not null then 'finished' else 'stalled' end as board_state,
  (trunc(stale)::BIGINT // 3600) || 'h' || lpad((trunc(stale)::BIGINT // 60 % 60)::VARCHAR, 2, '0') || 'm'
    || lpad((trunc(stale)::BIGINT % 60)::VARCHAR, 2, '0') || 's' as quiet_for,
  case when stale < 90 then round_even(stale, 0)::BIGINT || 's ago'
    when stale < 5400 then round_even(stale / 60, 0)::BIGINT || 'm ago'
    when stale < 172800 then round_even(stale / 3600, 0)::BIGINT || 'h ago'
    else round_even(stale / 86400, 0)::BIGINT || 'd ago' end as age,
  round(greatest(0, least(1, step / 2000)), 6) as progress,
  repeat('#', round_even(least(1, step / 2000) * 20, 0)::INT) || repeat('-', 20 - round_even(least(1, step / 2000) * 20, 0)::INT) as bar
from stale_
"""
)
def run_liveness(spark, sf_dir):
    now = table(spark, sf_dir, "events").agg(F.max(micros("ts")) / 1e6).first()[0]
    run = F.col("run_id")
    status = runlog.latest(run_log(spark, sf_dir)).select(
        "run_id",
        "step",
        (micros("ts") / 1e6).alias("heartbeat"),
        (run % 3 != 0).alias("alive"),
        F.when(run % 5 == 0, "deadline").alias("stop_reason"),
        (run % 2 == 0).alias("saving"),
    )
    share = F.col("step") / 2000
    return runlog.liveness(status, F.lit(now)).select(
        "run_id",
        "step",
        "state",
        "board_state",
        display.clock(F.col("stale_s")).alias("quiet_for"),
        display.age(F.col("stale_s")).alias("age"),
        F.round(display.fraction(share), 6).alias("progress"),
        display.bar(share, 20).alias("bar"),
    )


# --------------------------------------------------------------------------- inventories


def checkpoint_listing(spark, sf_dir) -> DataFrame:
    """A file listing read from orders: a customer's orders are the files of a run."""
    prefix = F.element_at(
        F.create_map(
            *[F.lit(x) for x in ("1-URGENT", "ckpt", "2-HIGH", "weights", "3-MEDIUM", "milestone")],
            *[F.lit(x) for x in ("4-NOT SPECIFIED", "sft", "5-LOW", "optim")],
        ),
        F.col("o_orderpriority"),
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run_id"),
        F.concat(
            F.lit("/runs/"), F.col("o_custkey"), F.lit("/"), prefix, F.lit("_step"), F.col("o_orderkey"), F.lit(".pt")
        ).alias("path"),
        F.when(F.col("o_orderstatus") == "P", 0)
        .otherwise(F.round(F.col("o_totalprice") * 100))
        .cast("bigint")
        .alias("length"),
        F.floor(micros("o_orderdate") / 1_000_000).alias("mtime"),
    )


LISTING_SQL = """
listed_ as (
  select o_custkey as run_id, o_orderkey as step, epoch(o_orderdate)::BIGINT as mtime,
    case o_orderpriority when '1-URGENT' then 'ckpt' when '2-HIGH' then 'weights'
      when '3-MEDIUM' then 'milestone' when '4-NOT SPECIFIED' then 'sft' else 'optim' end as prefix,
    case when o_orderstatus = 'P' then 0 else round(o_totalprice * 100)::BIGINT end as length
  from orders),
found_ as (
  select *, '/runs/' || run_id || '/' || prefix || '_step' || step || '.pt' as path,
    case prefix when 'ckpt' then 'full' else prefix end as kind
  from listed_ where prefix <> 'optim' and length > 0)
"""


@query(f"with {LISTING_SQL} select run_id, path, step, kind, round(length / 1e6, 6) as size_mb, mtime from found_")
def checkpoints(spark, sf_dir):
    return inventory.parse_checkpoints(checkpoint_listing(spark, sf_dir)).select(
        "run_id", "path", "step", "kind", F.round("size_mb", 6).alias("size_mb"), "mtime"
    )


@query(
    f"""
with {LISTING_SQL}
select run_id, arg_max(path, (kind = 'full', step, path)) as resume_path,
  arg_max(path, (mtime, path)) filter (kind <> 'sft') as export_path
from found_ group by run_id
"""
)
def checkpoint_pick(spark, sf_dir):
    found = inventory.parse_checkpoints(checkpoint_listing(spark, sf_dir))
    return inventory.picks(found, ["run_id"])


@query(
    f"""
with {LISTING_SQL}
select run_id, kind, path from found_ where kind in ('full', 'weights')
qualify row_number() over (partition by run_id, kind order by mtime desc, path desc)
  > case kind when 'full' then 2 else 4 end
"""
)
def checkpoint_retention(spark, sf_dir):
    found = inventory.parse_checkpoints(checkpoint_listing(spark, sf_dir))
    return inventory.expired(found, ["run_id"]).select("run_id", "kind", "path")


def source_manifests(spark, sf_dir) -> DataFrame:
    """A manifest per document source, its base and direction taken from its size."""
    docs = documents(spark, sf_dir).where(F.length("text") > 0)
    sized = docs.groupBy("source").agg(F.sum(F.size(txt.tokens(F.col("text"))) + 1).alias("total_tokens"))
    keys = F.array(*[F.lit(b[0]) for b in registry.BASES])
    listed = sized.select(
        F.col("source").alias("path"),
        "total_tokens",
        F.get(keys, (F.col("total_tokens") % 6).cast("int")).alias("base_key"),
        F.element_at(
            F.array(*[F.lit(x) for x in layout.DIRECTIONS]), (F.col("total_tokens") % 3 + 1).cast("int")
        ).alias("direction"),
        F.when(F.col("total_tokens") % 5 != 0, F.array(F.lit("web_000"))).alias("shards"),
    )
    return registry.with_base(listed).select(
        "path", "total_tokens", "base_key", "direction", "shards", F.col("hf_name").alias("base"), "dtype", "vocab_size"
    )


MANIFEST_SQL = f"""
key_ as (
  select * from (values (0, 'small', 'HuggingFaceTB/SmolLM2-135M', 49152),
    (1, 'small-tpu', 'HuggingFaceTB/SmolLM2-135M', 49152), (2, 'large', 'Qwen/Qwen3-0.6B-Base', 151669),
    (3, 'large-gpu', 'Qwen/Qwen3-0.6B-Base', 151669), (4, 'large-lora-gpu', 'Qwen/Qwen3-1.7B-Base', 151669),
    (5, 'xlarge-lora', 'Qwen/Qwen3-4B-Base', 151669)) as b(i, key, hf_name, vocab_size)),
size_ as (
  select source as path, sum(len({oracle.toks('text')}) + 1)::BIGINT as total_tokens
  from documents where length(text) > 0 group by source),
manifest_ as (
  select path, total_tokens, key as base_key, hf_name as base, vocab_size,
    case when vocab_size <= 65535 then 'uint16' else 'uint32' end as dtype,
    ['reverse', 'forward', 'both'][total_tokens % 3 + 1] as direction, total_tokens % 5 <> 0 as has_shards
  from size_ join key_ on i = total_tokens % 6)
"""


@query(
    f"""
with {MANIFEST_SQL},
best_ as (select arg_max(path, (total_tokens, path)) as best from manifest_ where has_shards)
select path, total_tokens, base_key,
  base || ':' || direction || ':' || dtype || ':' || vocab_size || ':' || total_tokens as fingerprint,
  path = best as picked, base <> 'Qwen/Qwen3-0.6B-Base' as wrong_base,
  (total_tokens * case dtype when 'uint16' then 2 else 4 end)::BIGINT as bytes
from manifest_, best_
"""
)
def corpus_pick(spark, sf_dir):
    from palindra.session import stage

    found = stage(source_manifests(spark, sf_dir), "manifests")
    picked = inventory.largest_corpus(found).select("path", F.lit(True).alias("picked"))
    asked = found.select("path", "base").withColumn("base_key", F.lit("large"))
    wrong = inventory.base_mismatches(asked).select("path", F.lit(True).alias("wrong_base"))
    described = found.join(picked, "path", "left").join(wrong, "path", "left").na.fill(False)
    mark = inventory.fingerprint(*map(F.col, ("base", "direction", "dtype", "vocab_size", "total_tokens")))
    return described.select(
        "path",
        "total_tokens",
        "base_key",
        mark.alias("fingerprint"),
        "picked",
        "wrong_base",
        (F.col("total_tokens") * schedule.bytes_per_token(F.col("vocab_size"))).cast("bigint").alias("bytes"),
    )


@query(
    f"""
with {MANIFEST_SQL},
live_ as (select m.path, m.base_key, k.hf_name, case when m.total_tokens % 2 = 0 then 1024 else 512 end as block_size, k.vocab_size
  from manifest_ m join key_ k on k.key = m.base_key),
pair_ as (
  select path, unnest(['base_key', 'hf_name', 'block_size', 'vocab_size']) as field,
    unnest(['large', 'Qwen/Qwen3-0.6B-Base', '1024', '151669']) as live,
    unnest([base_key, hf_name, block_size::VARCHAR, vocab_size::VARCHAR]) as saved
  from live_)
select path, field, saved, live from pair_ where saved <> live
"""
)
def config_differences(spark, sf_dir):
    found = source_manifests(spark, sf_dir)
    block = F.when(F.col("total_tokens") % 2 == 0, F.lit(1024)).otherwise(F.lit(512))
    saved = found.select("path", "base_key", F.col("base").alias("hf_name"), block.alias("block_size"), "vocab_size")
    live = registry.with_base(found.select("path").withColumn("base_key", F.lit("large")))
    return inventory.config_differences(saved, live, "path")


@query(
    f"""
with {oracle.RUN_LOG},
rated_ as (select run_id, sum(tokens) as tokens, max(epoch_us(ts)) / 3.6e9 - min(epoch_us(ts)) / 3.6e9 as hours, max(step) as steps
  from log_ group by run_id),
key_ as (
  select * from (values (0, 'small', 131072, 2), (1, 'small-tpu', 131072, 2), (2, 'large', 131072, 4),
    (3, 'large-gpu', 65536, 4), (4, 'large-lora-gpu', 65536, 4), (5, 'xlarge-lora', 131072, 4)) as b(i, key, per_step, width))
select run_id, key as base_key, round(hours * 3600 * 4000, 2) as session_tokens,
  round(hours * 3600 * 4000 / per_step, 4) as session_steps, round(greatest(0.4, hours - 0.45), 6) as train_hours,
  greatest(200, trunc(120 * greatest(0.4, hours - 0.45))::BIGINT)::BIGINT as decay_steps,
  greatest(15, trunc(greatest(0.4, hours - 0.45) * 60 / 8)::BIGINT)::BIGINT as milestone_min,
  round(greatest(0, (5e9 - tokens) * width / 1e9) + 8, 6) as disk_gb
from rated_ join key_ on i = run_id % 6
"""
)
def session_plan(spark, sf_dir):
    hours = (F.max(micros("ts")) - F.min(micros("ts"))) / 3.6e9
    rated = run_log(spark, sf_dir).groupBy("run_id").agg(F.sum("tokens").alias("tokens"), hours.alias("spent"))
    keys = F.array(*[F.lit(b[0]) for b in registry.BASES])
    based = registry.with_base(rated.withColumn("base_key", F.get(keys, (F.col("run_id") % 6).cast("int"))))
    spent, seen = F.col("spent"), schedule.session_tokens(F.col("spent"), F.lit(4000))
    need = schedule.disk_gb_needed(F.lit(5e9), F.col("tokens"), F.col("token_bytes"))
    return based.select(
        "run_id",
        "base_key",
        F.round(seen, 2).alias("session_tokens"),
        F.round(seen / F.col("tokens_per_step"), 4).alias("session_steps"),
        F.round(schedule.train_hours(spent), 6).alias("train_hours"),
        big(schedule.planned_decay_steps(spent)).alias("decay_steps"),
        big(schedule.milestone_minutes(spent)).alias("milestone_min"),
        F.round(need, 6).alias("disk_gb"),
    )


@query(
    """
with c as (
  select user_id, event_id, event_type, value, value < 20 as ok, (event_id % 32)::BIGINT as bits,
    case event_type when 'click' then 'SAVE_NOW' when 'view' then 'STOP_NOW' when 'error' then 'DECAY_NOW' end as flag
  from events)
select user_id, count(*) filter (ok)::BIGINT as passed, count(*)::BIGINT as total, bit_or(bits)::BIGINT as bits,
  round(max(value), 6) as max_value, avg(value)::FLOAT::DOUBLE as mean_value, round(sum(value), 4) as sum_value,
  array_to_string(list_sort(list(distinct flag) filter (flag is not null)), ',') as raised,
  count(*)::BIGINT as replies, round(case when sum(value) > 0 then sum(event_id % 100) / sum(value) else 0 end, 6) as rate
from c group by user_id
"""
)
def checks_rollup(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    flag = (
        F.when(F.col("event_type") == "click", "SAVE_NOW")
        .when(F.col("event_type") == "view", "STOP_NOW")
        .when(F.col("event_type") == "error", "DECAY_NOW")
    )
    rows = events.select(
        "user_id",
        "value",
        (F.col("value") < 20).alias("ok"),
        (F.col("event_id") % 32).alias("bits"),
        (F.col("event_id") % 100).alias("tokens"),
        F.col("value").alias("seconds"),
        flag.alias("flag"),
    )
    found = diagnostics.passed() | diagnostics.reduced() | diagnostics.flags_set() | diagnostics.session()
    return rows.groupBy("user_id").agg(*[c.alias(n) for n, c in found.items()]).select(
        "user_id",
        "passed",
        "total",
        "bits",
        F.round("max_value", 6).alias("max_value"),
        single("mean_value").alias("mean_value"),
        F.round("sum_value", 4).alias("sum_value"),
        F.array_join("raised", ",").alias("raised"),
        "replies",
        F.round("rate", 6).alias("rate"),
    )


# --------------------------------------------------------------------------- stored vectors


def logits(spark, sf_dir) -> DataFrame:
    target = F.when(F.col("vec_id") % 10 == 0, F.lit(-1)).otherwise(F.col("label"))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("logits"), target.alias("target")
    )


LOGITS_SQL = """
v_ as (
  select vec_id, embedding::DOUBLE[] as v, case when vec_id % 10 = 0 then -1 else label end as target from embeddings),
e_ as (select *, list_transform(v, lambda x: exp(x - list_max(v))) as e from v_),
p_ as (select *, list_transform(e, lambda x: x / list_sum(e)) as p from e_)
"""


@query(
    f"""
with {LOGITS_SQL}
select vec_id, round(list_sum(list_transform(p, lambda x: -x * ln(greatest(x, 1e-12)))), 6) as entropy,
  (list_position(v, list_max(v)) - 1)::BIGINT as greedy, round(list_max(p), 6) as chosen from p_
"""
)
def logit_entropy(spark, sf_dir):
    rows = logits(spark, sf_dir).withColumn("p", vectors.softmax(F.col("logits")))
    greedy = vectors.best(F.col("logits"))
    return rows.select(
        "vec_id",
        F.round(vectors.entropy(F.col("p")), 6).alias("entropy"),
        big(greedy).alias("greedy"),
        F.round(F.get("p", greedy.cast("int")), 6).alias("chosen"),
    )


@query(
    f"""
with {LOGITS_SQL},
l_ as (select vec_id, unnest(v) as x, unnest(p) as p, unnest(range(len(v))) as id from p_),
r_ as (select *, row_number() over (partition by vec_id order by x desc, id) as r,
  nth_value(x, 10) over (partition by vec_id order by x desc, id rows between unbounded preceding and unbounded following) as kth
  from l_)
select vec_id, string_agg(id::VARCHAR, ',' order by r) filter (r <= 5) as top5,
  round(sum(p) filter (r <= 5), 6) as top5_mass, string_agg(id::VARCHAR, ',' order by id) filter (x >= kth) as kept,
  count(*) filter (x < kth)::BIGINT as masked
from r_ group by vec_id
"""
)
def logit_topk(spark, sf_dir):
    rows = logits(spark, sf_dir).withColumn("p", vectors.softmax(F.col("logits")))
    top5 = vectors.top(F.col("p"), 5)
    hidden = F.filter(vectors.masked_top_k(F.col("logits"), 10), lambda x: x == float("-inf"))
    return rows.select(
        "vec_id",
        F.array_join(F.transform(top5, lambda s: s["id"].cast("string")), ",").alias("top5"),
        F.round(vectors.total(F.transform(top5, lambda s: s["value"])), 6).alias("top5_mass"),
        F.array_join(
            F.transform(vectors.kept_by_top_k(F.col("logits"), 10), lambda i: i.cast("string")), ","
        ).alias("kept"),
        big(F.size(hidden)).alias("masked"),
    )


@query(
    f"""
with {LOGITS_SQL}
select (vec_id % 8)::BIGINT as batch, round(avg(ln(list_sum(e)) + list_max(v) - v[target + 1]) filter (target <> -1), 6) as loss,
  count(*) filter (target <> -1)::BIGINT as targets
from p_ group by 1
"""
)
def cross_entropy(spark, sf_dir):
    rows = logits(spark, sf_dir).withColumn("batch", F.col("vec_id") % 8)
    losses = diagnostics.mean_cross_entropy(rows, "logits", "target", ["batch"])
    return losses.withColumn("loss", F.round("loss", 6))


@query(
    """
with v_ as (
  select vec_id, embedding::DOUBLE[] as a,
    list_transform(embedding::DOUBLE[], lambda x: x + case when vec_id % 7 = 0 then 1e-4 else 0 end) as b from embeddings),
k_ as (select *, 'all' as rows, true as there from v_ union all select *, 'some missing', vec_id % 50 <> 3 from v_),
w_ as (
  select rows, count(*) filter (not there) as unmatched,
    max(list_max(list_transform(list_zip(a, b), lambda s: abs(s[1] - s[2])))) filter (there) as delta,
    greatest(max(list_max(list_transform(a, lambda x: abs(x)))), 1.0) as scale from k_ group by rows)
select rows, unmatched, round(delta, 9) as delta, round(delta / scale, 9) as relative,
  delta / scale <= tol and unmatched = 0 as ok, dtype
from w_, (values ('float32', 1e-5), ('float16', 2e-3), ('bfloat16', 1.5e-2)) as t(dtype, tol)
"""
)
def vector_agreement(spark, sf_dir):
    stored = logits(spark, sf_dir).select("vec_id", F.col("logits").alias("v"))
    shift = F.when(F.col("vec_id") % 7 == 0, 1e-4).otherwise(0.0)
    reloaded = stored.withColumn("_shift", shift).select(
        "vec_id", F.transform("v", lambda x: x + F.col("_shift")).alias("v")
    )
    whole = diagnostics.agreement(stored, reloaded, "vec_id", "v", *vectors.TOLERANCE)
    some = reloaded.where("vec_id % 50 <> 3")
    part = diagnostics.agreement(stored, some, "vec_id", "v", *vectors.TOLERANCE)
    out = whole.withColumn("rows", F.lit("all")).unionByName(part.withColumn("rows", F.lit("some missing")))
    return out.withColumn("delta", F.round("delta", 9)).withColumn("relative", F.round("relative", 9))


@query(
    f"""
with v_ as (select vec_id, list_transform(embedding::DOUBLE[], lambda x: x / 0.8) as z from embeddings),
m_ as (select vec_id, z, list_max(z) as top, unnest(range(1, len(z) + 1)) as i from v_),
h_ as (
  select vec_id, i, exp(z[i] - top) as e, ({oracle.mix('i', f"(({oracle.mix('vec_id & 4294967295', '1337')}))")})::BIGINT as h from m_),
p_ as (select vec_id, i, h, e / sum(e) over (partition by vec_id) as p from h_)
select vec_id, (arg_max(i, ln(p) - ln(-ln((h + 0.5) / 4294967296.0))) - 1)::BIGINT as drawn from p_ group by vec_id
"""
)
def gumbel_draw(spark, sf_dir):
    """A seeded draw per stored vector; checked for its distribution in the tests."""
    rows = logits(spark, sf_dir).withColumn("p", vectors.softmax(F.col("logits"), 0.8))
    return rows.select("vec_id", diagnostics.draw(F.col("p"), F.col("vec_id"), 1337).cast("bigint").alias("drawn"))


# --------------------------------------------------------------------------- streams


def arrive_in_slices(rows: DataFrame, order: str, slices: int, folder: str):
    """Write the whole table to a stream's input folder, slice after slice in order,
    and yield after each one so that the stream can take it."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    width = (high - low) // slices + 1
    slot = F.expr(f"({order} - {low}) div {width}")
    for k in range(slices):
        rows.where(slot == k).write.mode("append").parquet(folder)
        yield rows.sparkSession.readStream.schema(rows.schema).parquet(folder)


@query(
    f"""
with t as (
  select doc_id, len({oracle.toks('text')}) + 1 as n,
    {oracle.joined(f"list_concat(list_reverse({oracle.toks('text')}), ['{txt.EOS}'])")} as tokens,
    sum(len({oracle.toks('text')}) + 1) over (order by doc_id) as upto
  from documents where length(text) > 0)
select doc_id as doc, n::BIGINT as n, (upto - n)::BIGINT as start, ((upto - 1) // 50000 - (upto - n) // 50000 + 1)::BIGINT as parts, tokens from t
where upto - n < (select sum(length(text)) // 8 from documents)
"""
)
def stream_pack(spark, sf_dir):
    """Documents arrive in three slices; the budget is a token per eight characters."""
    from palindra.session import fresh_path
    from palindra.streaming.pack import PackStream

    folder = fresh_path(spark, "pack-stream")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    budget = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 8
    job = PackStream(folder, max_tokens=budget, shard_tokens=50_000)
    for stream in arrive_in_slices(docs, "doc_id", 3, f"{folder}/in"):
        if job.run(stream):
            break
    parts = job.parts(spark)
    place = F.col("shard") * job.shard_tokens + F.col("at")
    # A document's parts are few: one more than the shard ends it crosses.
    return parts.groupBy("doc").agg(
        F.sum(F.size("tokens").cast("bigint")).alias("n"),
        F.min(place).alias("start"),
        F.count("*").alias("parts"),
        digest(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("shard", "tokens"))), lambda s: s["tokens"]))).alias("tokens"),
    )


@query(ORACLES["blocks"])
def stream_build(spark, sf_dir):
    """The corpus of ``blocks`` from streams: documents and conversations arrive in three slices each."""
    from palindra.session import fresh_path
    from palindra.streaming.build import StreamBuild

    folder = fresh_path(spark, "build-stream")
    docs, turns = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "conversations")
    laid = corpus.laid_out(docs, turns, "reverse")
    total = laid.agg(F.coalesce(F.sum(F.size("tokens").cast("bigint")), F.lit(0))).first()[0]
    job = StreamBuild(folder, settings_for(total))
    arriving = zip(
        arrive_in_slices(docs, "doc_id", 3, f"{folder}/documents"), arrive_in_slices(turns, "conv_id", 3, f"{folder}/turns")
    )
    for streams in arriving:
        job.start(*streams).awaitTermination()
    x, y = layout.shifted(F.col("tokens"))
    return job.build.blocks(spark).select(
        "split", "stream", "shard", "block", "block_idx", digest(x).alias("x"), digest(y).alias("y")
    )


QUIET_S, GRACE_S = 36 * 3_600, 72 * 3_600


@query(
    f"""
with e as (select user_id as run_id, event_id as seq, epoch_us(ts) as us from events),
t as (select min(us) + {GRACE_S * 1_000_000} as graced, max(us) as upto from e),
n as (select *, lead(us) over w as next_us, lead(seq) over w as next_seq, greatest(us + {QUIET_S * 1_000_000}, graced) as due
      from e, t window w as (partition by run_id order by us, seq)),
g as (select * from n where next_us > due or next_us is null and upto // 1000 > (due + 999) // 1000)
select run_id, 'silent' as state, seq, us as since_us, null::BIGINT as until_us from g
union all
select run_id, 'returned', next_seq, us, next_us from g where next_us is not null and next_us > due
"""
)
def stream_silence(spark, sf_dir):
    """Runs without a line for 36 hours, none before the fourth day of all runs; the log arrives in three slices."""
    from palindra.session import fresh_path
    from palindra.streaming import silence

    folder = fresh_path(spark, "silence")
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), micros("ts").alias("at_us")
    )
    began = log.agg(F.coalesce(F.min("at_us"), F.lit(0))).first()[0]
    for stream in arrive_in_slices(log, "at_us", 3, f"{folder}/in"):
        found = silence.silences(stream, QUIET_S, started_us=began, grace_seconds=GRACE_S)
        silence.follow(found, folder).awaitTermination()
    return spark.read.schema(silence.REPORT).parquet(f"{folder}/out")


def followed(spark, sf_dir):
    """The run log arrives in three slices; returns the follower behind the last one."""
    from palindra.session import fresh_path, stage
    from palindra.streaming.runs import RunFollower

    folder = fresh_path(spark, "run-stream")
    follower = RunFollower(folder)
    log = run_log(spark, sf_dir).select(
        "run_id", "seq", "step", "wall_s", "loss", (micros("ts") / 1e6).alias("heartbeat")
    )
    for stream in arrive_in_slices(stage(log, "log"), "seq", 3, f"{folder}/in"):
        done = follower.start(stream)
        done.awaitTermination()
    return follower, done.lastProgress["batchId"]


@query(
    f"""
with {oracle.RUN_LOG},
prev_ as (
  select *, lag(wall_s) over w as pw, lag(step) over w as ps from log_ window w as (partition by run_id order by seq))
select run_id, seq, ps::BIGINT as from_step, step::BIGINT as step from prev_ where wall_s < pw
"""
)
def stream_restart(spark, sf_dir):
    return followed(spark, sf_dir)[0].restarts(spark)


@query(
    f"""
with recursive {oracle.RUN_LOG},
fold_ as (
  select run_id, seq, rn, loss as ema from log_ where rn = 1
  union all
  select l.run_id, l.seq, l.rn, 0.9 * f.ema + 0.1 * l.loss from fold_ f join log_ l on l.run_id = f.run_id and l.rn = f.rn + 1)
select run_id, seq, ema::FLOAT::DOUBLE as ema from fold_
"""
)
def stream_ema(spark, sf_dir):
    return followed(spark, sf_dir)[0].smoothed(spark).withColumn("ema", single("ema"))


@query(
    f"""
with {oracle.RUN_LOG},
last_ as (
  select run_id, max(seq)::BIGINT as seq, max(step)::BIGINT as step, arg_max(loss, seq) as loss, max(epoch_us(ts)) / 1e6 as heartbeat
  from log_ group by run_id)
select run_id, seq, step, loss, round((select max(heartbeat) from last_) - heartbeat, 3) as quiet_s
from last_ where (select max(heartbeat) from last_) - heartbeat > 180
"""
)
def stream_stall(spark, sf_dir):
    from palindra.streaming import runs

    follower, batch = followed(spark, sf_dir)
    status = follower.status(spark, batch)
    now = status.agg(F.max("heartbeat")).first()[0]
    return runs.stalled(status, F.lit(now)).select(
        "run_id", "seq", "step", "loss", F.round(F.lit(now) - F.col("heartbeat"), 3).alias("quiet_s")
    )


@query(
    f"""
with {oracle.RUN_LOG},
hour_ as (
  select run_id, (epoch_us(date_trunc('day', ts)) // 1000000)::BIGINT as window_s, count(*)::BIGINT as log_rows,
    round(sum(loss), 4) as loss_sum, max(tokens)::BIGINT as tokens, max(ts) as newest
  from log_ group by 1, 2)
select run_id, window_s, log_rows, loss_sum, tokens,
  window_s + 86400 <= (select max(epoch_us(ts)) / 1e6 - 600 from events) as closed from hour_
"""
)
def stream_windows(spark, sf_dir):
    """Daily windows, and whether the watermark has closed them."""
    from palindra.session import fresh_path, stage
    from palindra.streaming import runs

    folder = fresh_path(spark, "window-stream")
    log = stage(run_log(spark, sf_dir).select("run_id", "seq", "ts", "loss", "tokens"), "log")
    zoned = log.withColumn("ts", F.timestamp_micros(micros("ts")))
    for stream in arrive_in_slices(zoned, "seq", 3, f"{folder}/in"):
        runs.follow_windows(stream, folder, "10 minutes", "1 day").awaitTermination()
    newest = zoned.agg(F.max(micros("ts")) / 1e6).first()[0]
    start = F.unix_seconds("window_start")
    return runs.newest_windows(spark, folder).select(
        "run_id",
        start.alias("window_s"),
        "log_rows",
        F.round("loss_sum", 4).alias("loss_sum"),
        "tokens",
        (start + 86_400 <= F.lit(newest) - 600).alias("closed"),
    )


# --------------------------------------------------------------------------- ids, nesting and run files


@query(
    f"""
select doc_id, {oracle.joined(oracle.toks('text'))} as tokens, len({oracle.toks('text')})::BIGINT as n
from documents where length(text) > 0
"""
)
def decode_ids(spark, sf_dir):
    """Texts to ids and back, through the vocabulary both times."""
    docs = documents(spark, sf_dir).where(F.length("text") > 0)
    words = corpus_vocabulary(spark, sf_dir)
    ids = vocabulary.encode_texts(docs.select(F.col("doc_id").alias("doc"), "text"), words)
    back = vocabulary.decode_arrays(ids, ["doc"], "ids", words)
    return back.select(F.col("doc").alias("doc_id"), digest(F.col("ids")).alias("tokens"), big(F.size("ids")).alias("n"))


@query(
    f"""
with {oracle.NORMALISED}
select conv_id, turn, role, text, starts_turn, starts_conv, ends_conv from piece_
"""
)
def nested_normalised(spark, sf_dir):
    """Conversations as lists of messages, odd ones under the other names; both lists in one table."""
    turns = either_schema(table(spark, sf_dir, "conversations"))
    other = F.col("conv_id") % 2 == 1
    # A conversation as one row is the shape of such input.
    nested = turns.groupBy("conv_id").agg(
        F.array_sort(
            F.collect_list(F.when(~other, F.struct("turn", F.struct("role", "content").alias("m"))))
        ).alias("plain"),
        F.array_sort(F.collect_list(F.when(other, F.struct("turn", F.struct("from", "value").alias("m"))))).alias("named"),
    )
    rows = nested.select(
        "conv_id",
        F.transform("plain", lambda t: t["m"]).alias("messages"),
        F.transform("named", lambda t: t["m"]).alias("conversations"),
    )
    return chat.normalise(chat.explode_messages(rows, "conv_id", ["messages", "conversations"]))


@query(
    f"""
with {oracle.RUN_LOG}
select 'r' || run_id % 3 || '/run' as run_id, step::BIGINT as step, round(wall_s, 6) as wall_s, tokens::BIGINT as tokens,
  loss, round(val_loss, 6) as val_loss from log_
"""
)
def log_round_trip(spark, sf_dir):
    """Run logs written as files, in folders of one name below three others, and read again."""
    from palindra.session import fresh_path, stage
    from palindra.sources import runs

    folder = fresh_path(spark, "run-files")
    log = stage(run_log(spark, sf_dir), "log")
    for k in range(3):
        runs.append_log(log.where(F.col("run_id") % 3 == k), f"{folder}/r{k}/run")
    return runs.read_log(spark, f"{folder}/*/run/*.csv").select(
        "run_id", "step", F.round("wall_s", 6).alias("wall_s"), "tokens", "loss", F.round("val_loss", 6).alias("val_loss")
    )


@query(
    f"""
with {oracle.RUN_LOG},
last_ as (select run_id, max(step) as step, arg_max(loss, step) as loss from log_ group by run_id)
select run_id::VARCHAR as run_id, (case when run_id % 2 = 0 then step + 1 else step end)::BIGINT as step, loss from last_
"""
)
def status_latest(spark, sf_dir):
    """The status of all runs, then once more of every other run; each write keeps the rest."""
    from palindra.session import fresh_path
    from palindra.sources import runs

    folder = fresh_path(spark, "status")
    last = runlog.latest(run_log(spark, sf_dir)).select(F.col("run_id").cast("string").alias("run_id"), "step", "loss")
    runs.write_status(last, folder)
    again = last.where(F.col("run_id").cast("bigint") % 2 == 0).withColumn("step", F.col("step") + 1)
    runs.write_status(again, folder)
    return runs.read_status_table(spark, folder).select("run_id", "step", "loss")


@query(
    f"""
with {LISTING_SQL}
select (row_number() over (order by step desc, kind = 'full' desc, path) - 1)::BIGINT as position, path, step, kind from found_
"""
)
def checkpoint_order(spark, sf_dir):
    found = inventory.parse_checkpoints(checkpoint_listing(spark, sf_dir))
    return dense_index(found, inventory.newest_order(), "position").select("position", "path", "step", "kind")


@query(
    f"""
with {oracle.RUN_LOG},
last_ as (
  select run_id, max(epoch_us(ts)) / 1e6 as heartbeat, case when run_id % 5 = 0 then 'deadline' end as stop_reason,
    case when run_id % 7 = 0 then (run_id % 2)::VARCHAR || chr(10) end as exit_code
  from log_ group by run_id),
now_ as (select max(heartbeat) as now from last_)
select run_id, stop_reason is not null or exit_code is not null as finished,
  case when stop_reason is not null then true when exit_code is not null then run_id % 2 = 0 end as clean,
  now - heartbeat > 900 and now - (now - 3600) > 900 as given_up
from last_, now_
"""
)
def run_finish(spark, sf_dir):
    """Which runs ended, how, and which are taken for dead after an hour of watching."""
    from palindra.streaming import runs

    run = F.col("run_id")
    status = runlog.latest(run_log(spark, sf_dir)).select(
        "run_id",
        (micros("ts") / 1e6).alias("heartbeat"),
        F.when(run % 5 == 0, "deadline").alias("stop_reason"),
        F.when(run % 7 == 0, F.concat((run % 2).cast("string"), F.lit("\n"))).alias("exit_code"),
    )
    now = F.lit(status.agg(F.max("heartbeat")).first()[0])
    ended = runs.finished(status).select("run_id", "clean", F.lit(True).alias("_ended"))
    dead = runs.given_up(status, now, now - 3600).select("run_id", F.lit(True).alias("_dead"))
    return (
        status.join(ended, "run_id", "left")
        .join(dead, "run_id", "left")
        .select(
            "run_id",
            F.col("_ended").isNotNull().alias("finished"),
            "clean",
            F.col("_dead").isNotNull().alias("given_up"),
        )
    )
