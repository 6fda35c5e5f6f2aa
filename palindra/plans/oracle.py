"""SQL building blocks for checking the registered queries in DuckDB.

Each states a result from the definition, with plain global windows or exploded
tokens, and shares no code with the Spark plans.
"""

from __future__ import annotations

from palindra.functions.permute import EPOCH_STEP, MASK32, MULTIPLIERS, ROUND_STEP
from palindra.functions.text import EOS, IM_END, IM_START, TOKEN, TURN, WHITESPACE

BLANKS = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)
TOKENS = f"regexp_extract_all(%s, '{TOKEN}')"
TURN_PATTERN = TURN
SEP = "chr(31)"


def toks(column: str) -> str:
    return TOKENS % column


def strip(column: str) -> str:
    return f"trim({column}, {BLANKS})"


def joined(array: str) -> str:
    return f"md5(array_to_string({array}, {SEP}))"


NORMALISED = f"""
rows_ as (select conv_id, turn, lower(role) as role, {strip('text')} as text from conversations),
kept_ as (select * from rows_ where text <> '' and role in ('user', 'assistant', 'system')),
total_ as (
  select conv_id, min(turn) filter (role = 'user') as asked,
         max(turn) filter (role = 'assistant') as answered
  from kept_ group by conv_id),
seen_ as (
  select k.*, t.answered,
    last_value(case when role <> 'system' then role end ignore nulls) over w as speaker,
    last_value(case when role <> 'assistant' then role end ignore nulls) over w as before_role,
    last_value(case when role <> 'assistant' then text end ignore nulls) over w as before_text
  from kept_ k join total_ t using (conv_id)
  where asked < answered and turn <= answered
  window w as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)),
piece_ as (
  select conv_id, turn, role,
    case when role = 'user' and before_role = 'system'
         then before_text || chr(10) || chr(10) || text else text end as text,
    speaker is distinct from role as starts_turn, speaker is null as starts_conv,
    turn = answered as ends_conv
  from seen_ where role <> 'system'),
markup_ as (
  select *,
    case when starts_conv then '{IM_START}' || role || chr(10)
         when starts_turn then '{IM_END}' || chr(10) || '{IM_START}' || role || chr(10)
         else chr(10) || chr(10) end || text
    || case when ends_conv then '{IM_END}' else '' end as markup
  from piece_)
"""

PIECES = f"""{NORMALISED},
laid_ as (
  select 'web' as source, doc_id as doc, 0 as piece,
    list_concat(list_reverse({toks('text')}), ['{EOS}']) as tokens
  from documents where length(text) > 0
  union all
  select 'chat', conv_id, 2147483647 - turn,
    list_concat(list_reverse({toks('markup')}), case when starts_conv then ['{EOS}'] else [] end)
  from markup_),
span_ as (
  select source, doc, piece, tokens, len(tokens) as n,
    sum(len(tokens)) over (partition by source order by doc, piece) - len(tokens) as start
  from laid_)
"""


def split(num: int, den: int, val_tokens: int, web_target: int, chat_target: int) -> str:
    """Validation and training documents of a corpus."""
    return f"""{PIECES},
doc_ as (select source, doc, min(start) as start, sum(n) as n from span_ group by source, doc),
mixed_ as (
  select *, sum(n) over (order by
      case source when 'web' then {num} * start else {den - num} * start end,
      case when source = 'web' then 1 when start = 0 then 0 else 2 end, doc
    rows between unbounded preceding and current row) - n as val_start
  from doc_),
val_ as (select * from mixed_ where val_start < {val_tokens}),
end_ as (
  select s.source, coalesce(max(v.start + v.n), 0) as val_end
  from (select distinct source from doc_) s left join val_ v using (source) group by s.source),
train_doc_ as (
  select d.source, d.doc from doc_ d join end_ e using (source)
  where d.start >= val_end
    and d.start - val_end < case d.source when 'web' then {web_target} else {chat_target} end),
train_ as (
  select s.source, s.doc, s.piece, s.tokens, s.n, s.start - val_end as start
  from span_ s join train_doc_ using (source, doc) join end_ using (source)),
held_ as (
  select s.source, s.doc, s.piece, s.tokens, s.n, v.val_start + s.start - v.start as start
  from span_ s join val_ v using (source, doc))
"""


def blocks(shard_tokens: int, val_shard: int, block: int) -> str:
    """Whole blocks of both splits, after ``split``: one row per token."""
    return f"""
stream_ as (
  select 'train' as split, source as stream, start, tokens, {shard_tokens} as cap from train_
  union all select 'val', 'val', start, tokens, {val_shard} from held_),
token_ as (
  select split, stream, cap, start + unnest(range(len(tokens))) as pos, unnest(tokens) as token from stream_),
at_ as (select split, stream, pos // cap as shard, pos % cap as ofs, token from token_),
member_ as (
  select split, stream, shard, ofs // {block} as block, ofs, token from at_
  union all
  select split, stream, shard, ofs // {block} - 1, ofs, token from at_ where ofs > 0 and ofs % {block} = 0),
block_ as (
  select split, stream, shard, block, list(token order by ofs) as tokens
  from member_ group by all having count(*) = {block + 1}),
indexed_ as (
  select *, row_number() over (partition by split order by stream = 'chat', shard, block) - 1 as block_idx
  from block_)
"""


def mix(x: str, key: str) -> str:
    """The 32-bit mixer over HUGEINT, so that products cannot overflow."""
    a, b = MULTIPLIERS

    def bound(value: str, body: str) -> str:
        return f"list_transform([{value}], lambda v: {body})[1]"

    out = f"(({x})::HUGEINT + ({key})::HUGEINT) & {MASK32}"
    for body in (
        "xor(v, v >> 16)",
        f"(v * {a}) & {MASK32}",
        "xor(v, v >> 15)",
        f"(v * {b}) & {MASK32}",
        "xor(v, v >> 16)",
    ):
        out = bound(f"({out})::HUGEINT", f"({body})::HUGEINT")
    return out


def permutation(inputs: str) -> str:
    """``image_(i, n, seed, image)`` for the rows (i, n, seed) of ``inputs``."""
    left, right = "l", "r"
    rounds = "select i, n, seed, half, mask, (x >> half) & mask as l, x & mask as r from walk_ where x >= n or not begun"
    for r in range(4):
        key = f"(seed::HUGEINT + {r * ROUND_STEP}) & {MASK32}"
        rounds = (
            f"select i, n, seed, half, mask, r as l, xor(l, {mix('r', key)} & mask)::HUGEINT as r from ({rounds})"
        )
    return f"""
sized_ as (
  select i::HUGEINT as i, n::HUGEINT as n, seed::HUGEINT as seed,
    ((floor(log2(n - 1))::INT + 2) // 2)::HUGEINT as half from ({inputs})),
walk_ as (
  select i, n, seed, half, ((1::HUGEINT << half) - 1)::HUGEINT as mask, i as x, false as begun from sized_
  union all
  select i, n, seed, half, mask, ((l << half) | r)::HUGEINT as x, true as begun from ({rounds})),
image_ as (select i, n, seed, x as image from walk_ where begun and x < n)
"""


RUN_LOG = """
ranked_ as (
  select user_id as run_id, event_id as seq, ts, event_type, value,
    row_number() over (partition by user_id order by event_id) as rn
  from events),
log_ as (
  select run_id, seq, rn, ts, event_type, value, 20 * rn as step, (rn - 1) // 25 as attempt,
    epoch_us(ts) / 1e6 - min(epoch_us(ts) / 1e6) over (partition by run_id, (rn - 1) // 25) as wall_s,
    20 * rn * 131072 as tokens, round(2 + value / 100, 5) as loss,
    case when rn % 5 = 0 then round(2 + value / 100, 5) + 0.1 end as val_loss
  from ranked_)
"""

EPOCH = EPOCH_STEP
