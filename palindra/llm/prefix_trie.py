"""The prefix trie of conversations: what many of them begin with, counted once.

A node is a distinct sequence of first turns (role, text); its members are the
conversations that begin with it, and it goes by its smallest member and its depth.

A conversation is laid out in blocks of ``WIDTH`` turn-id columns. ``GROUP BY block,
..., ROLLUP (t1, ..., t8)`` gives all prefixes of all blocks in one aggregation that
combines before its shuffle; ``grouping_id`` tells how many columns a row keeps. A block
after the first is keyed by the node at which the block before it ends, which is a sum
over the digests of all earlier blocks: no block waits for another, however long a
conversation is.

Sums over subtrees need no walk over the trie. A conversation is the smallest member of
its nodes from some depth ``opens`` on; above it shares each turn with a smaller one.
Hence, over the members c of a node at depth d with smallest member c0:

* childless nodes below: members whose last node is childless and theirs;
* children: members with ``opens = d + 1``, and one if c0 goes on;
* bytes saved: for all but c0, the bytes of c's turns from depth d to ``opens - 1``.

The first ROLLUP finds ``opens``, the second sums these values. Turn ids are MD5 digests
of role and text; block keys are sums of digests, 128 bits and more.

Null roles and texts count as empty. Turns are ordered by number, null first, then by
digest; repeated rows are turns of their own. Rows with a null ``conv_id`` are left out.
Other columns are ignored. An empty table has no node, not even the root, as there is no
smallest member. Turns are numbered by a range sort and joined by parts of 2^16, so a
conversation of any length is spread over tasks. The digest of the ids that end at a
node is one pass by definition: it is fed from sorted pieces and nothing is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palindra.operators.ordered import POSITION_BITS, Running, dense_index, running
from palindra.session import stage

WIDTH = 8
#: Rows of a conversation, and ids that end at a node, that are handled together: 2^16.
PART_BITS = 16
KEYS = ["k1", "k2", "k3", "k4"]
TURNS = [f"t{i}" for i in range(1, WIDTH + 1)]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def own_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, id, n): turns numbered through all conversations, with the digest of
    role and text and the bytes of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    known = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.unhex(F.md5(F.concat_ws(":", F.octet_length(role), role, text))).alias("id"),
        F.octet_length(text).cast("bigint").alias("n"),
    )
    placed = dense_index(known, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("id")], "i")
    return placed.select("conv_id", "i", "id", "n")


def _by_part(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Join conversations to their turns, ``PART_BITS`` of the turns' numbers at a time."""
    part = F.expr(f"explode(sequence(shiftright(first, {PART_BITS}), shiftright(first + size - 1, {PART_BITS})))")
    numbered = turns.withColumn("_part", F.shiftright("i", PART_BITS))
    return numbered.join(convs.withColumn("_part", part), ["conv_id", "_part"]).drop("_part")


def sizes(turns: DataFrame) -> DataFrame:
    """(conv_id, first, size): where a conversation starts and how many turns it has."""
    return turns.groupBy("conv_id").agg(F.min("i").alias("first"), F.count("*").alias("size"))


def as_they_are(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, len, id, n) of conversations as they stand."""
    found = _by_part(turns, stage(sizes(turns), "sizes"))
    return found.select("conv_id", (F.col("i") - F.col("first") + 1).alias("pos"), F.col("size").alias("len"), "id", "n")


def with_shared_heads(turns: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, pos, len, id, n) of rebuilt conversations: the first h turns come from the
    conversation ``conv_id - conv_id % family``, h being a checksum of the id modulo
    ``most``; the conversation's own turns after its first h follow.

    A conversation without turns is one row at position 0.
    """
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = stage(
        sizes(turns).withColumn("h", head).withColumn("lead", F.col("conv_id") - F.col("conv_id") % family), "sizes"
    )
    kids = convs.groupBy(F.col("lead").alias("conv_id")).agg(F.collect_list(F.struct("conv_id", "size", "h")).alias("kids"))
    leads = convs.select(F.col("conv_id").alias("lead"), F.col("size").alias("given"))
    none = F.expr("cast(array() as array<struct<conv_id:bigint,size:bigint,h:bigint>>)")
    plan = (
        convs.join(leads, "lead", "left")
        .join(kids, "conv_id", "left")
        .withColumn("taken", F.least("h", F.coalesce("given", F.lit(0))))
        .withColumn("kids", F.coalesce("kids", none))
    )
    rebuilt = """explode(concat(
        if(pos > h, array(struct(conv_id, pos - h + taken as pos, taken + size - h as len)), array()),
        if(pos = 1 and taken = 0 and size <= h, array(struct(conv_id, 0L as pos, 0L as len)), array()),
        transform(filter(kids, k -> pos <= k.h),
                  k -> struct(k.conv_id as conv_id, pos, least(k.h, size) + greatest(k.size - k.h, 0L) as len))))"""
    rows = _by_part(turns, plan).withColumn("pos", F.col("i") - F.col("first") + 1)
    return rows.select(F.expr(rebuilt).alias("to"), "id", "n").select("to.*", "id", "n")


def _limbs(block: Column, ids: list[Column]) -> list[Column]:
    """128 bits of a full block as four numbers."""
    digest = F.md5(F.concat_ws("|", block, *[F.hex(i) for i in ids]))
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def in_blocks(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, block, len, k1..k4, before, t1..t8): blocks of turn ids, each with the key of
    all earlier blocks and the bytes before it."""
    own = rebuilt.withColumn("block", F.expr(f"greatest(pos - 1, 0L) div {WIDTH}"))
    item = F.when(F.col("pos") > 0, F.struct("pos", F.struct("id", "n").alias("t")))
    gathered = own.groupBy("conv_id", "block", "len").agg(F.sort_array(F.collect_list(item)).alias("a"))
    blocks = gathered.select("conv_id", "block", "len", *[F.get("a", F.lit(i))["t"].alias(t) for i, t in enumerate(TURNS)])
    none = F.lit(0).cast("bigint")
    short = blocks.where(F.col("len") <= WIDTH).select(
        "*", *[none.alias(k) for k in KEYS], none.alias("before")
    )
    limbs = _limbs(F.col("block"), [F.col(t)["id"] for t in TURNS])
    held = sum((F.coalesce(F.col(t)["n"], none) for t in TURNS[1:]), F.coalesce(F.col(TURNS[0])["n"], none))
    sums = [Running("sum", x, k) for k, x in zip([*KEYS, "before"], [*limbs, held])]
    long = running(stage(blocks.where(F.col("len") > WIDTH), "long"), ["conv_id"], ["block"], sums, {"block": POSITION_BITS})
    return short.unionByName(long)


def _rollup(blocks: DataFrame, values: str) -> DataFrame:
    """A row per node with ``values`` over its members, its depth, the bytes before its
    last turn and digests of the prefix that it is and of its parent's."""
    turns, keys = ", ".join(TURNS), ", ".join(KEYS)
    rows = blocks.sparkSession.sql(
        f"""select block, {keys}, before, {turns}, {WIDTH} - bit_count(grouping_id()) as level, {values}
        from {{blocks}} group by block, {keys}, before, rollup ({turns})""",
        blocks=blocks,
    )
    kept = sum((F.col(t).isNotNull().cast("int") for t in TURNS[1:]), F.col(TURNS[0]).isNotNull().cast("int"))
    # A level at which a conversation has already ended is no node, and the top of a
    # later block is the last node of the block before it.
    nodes = rows.where((kept == F.col("level")) & ((F.col("level") > 0) | (F.col("block") == 0)))
    up = [F.when(F.col("level") > i + 1, F.col(t)["n"]).otherwise(0) for i, t in enumerate(TURNS)]
    ids = F.filter(F.array(*[F.hex(F.col(t)["id"]) for t in TURNS]), lambda x: x.isNotNull())
    return (
        nodes.withColumn("depth", (F.col("block") * WIDTH + F.col("level")).cast("bigint"))
        .withColumn("up", F.col("before") + sum(up[1:], up[0]))
        .withColumn("node", _node(F.col("level")))
        .withColumn("parent", F.when(F.col("level") > 0, _digest(F.slice(ids, F.lit(1), F.greatest(F.col("level") - 1, F.lit(0))))))
        .drop("level", "before", *KEYS, *TURNS)
    )


def _digest(ids: Column) -> Column:
    return F.md5(F.concat_ws("|", "block", *KEYS, ids))


def _node(level: Column) -> Column:
    """The digest of the prefix that ends with a block's last turn id; a full block's is
    that of the next block's key."""
    ids = F.filter(F.array(*[F.hex(F.col(t)["id"]) for t in TURNS]), lambda x: x.isNotNull())
    limbs = _limbs(F.col("block"), [F.col(t)["id"] for t in TURNS])
    following = F.md5(F.concat_ws("|", F.col("block") + 1, *[F.col(k) + x for k, x in zip(KEYS, limbs)]))
    return F.when(level == WIDTH, following).otherwise(_digest(ids))


def _sha(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node = running_sha = None
    for batch in batches:
        done: dict[str, str] = {}
        for at, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if at == node:
                running_sha.update(b"," + text.encode())
                continue
            if node is not None:
                done[node] = running_sha.hexdigest()
            node, running_sha = at, hashlib.sha256(text.encode())
        yield pa.RecordBatch.from_pydict({"node": list(done), "ends_sha256": list(done.values())}, _SHA)
    if node is not None:
        yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [running_sha.hexdigest()]}, _SHA)


_SHA = pa.schema([("node", pa.string()), ("ends_sha256", pa.string())])


def ends(last: DataFrame) -> DataFrame:
    """(node, ends_sha256): digest of the ids, in order and joined by commas, of the
    conversations that end at a node."""
    part = F.shiftright("conv_id", PART_BITS).alias("part")
    pieces = last.groupBy("node", part).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    texts = pieces.select("node", "part", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    return texts.repartition("node").sortWithinPartitions("node", "part").mapInArrow(_sha, "node string, ends_sha256 string")


def trie(rebuilt: DataFrame) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. ``rebuilt`` has (conv_id, pos, len, id, n); positions of a
    conversation run from 1 to ``len``, one without turns is a row at position 0."""
    blocks = stage(in_blocks(rebuilt), "blocks")
    first = stage(_rollup(blocks, "min(conv_id) as conv_id, max(len) as longest"), "nodes")
    heads = first.groupBy("conv_id").agg(
        F.min("depth").alias("opens"),
        F.min_by("parent", "depth").alias("parent"),
        F.min_by("up", "depth").alias("shared"),
        F.max((F.col("longest") == F.col("depth")).cast("bigint")).alias("leaf"),
    )
    # A node may have any number of heads below it; the side with one row for each node
    # is repeated where that skews the join.
    parents = first.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    heads = stage(heads, "heads").join(parents, "parent", "left").drop("parent")
    none = F.lit(0).cast("bigint")
    last_block = F.col("block") == F.expr(f"greatest(len - 1, 0L) div {WIDTH}")
    kept = sum((F.col(t).isNotNull().cast("int") for t in TURNS[1:]), F.col(TURNS[0]).isNotNull().cast("int"))
    held = sum((F.coalesce(F.col(t)["n"], none) for t in TURNS[1:]), F.coalesce(F.col(TURNS[0])["n"], none))
    last = blocks.where(last_block).select(
        "conv_id", F.col("len"), (F.col("before") + held).alias("bytes"), _node(kept).alias("node")
    )
    values = last.join(heads, "conv_id", "left").select(
        "conv_id",
        F.coalesce("opens", F.col("len") + 1).alias("opens"),
        F.coalesce("shared", "bytes").alias("shared"),
        F.coalesce("leaf", none).alias("leaf"),
        "above",
    )
    children = ", ".join(
        f"count_if(opens = block * {WIDTH} + {i + 1} and opens <= len) as c{i}" for i in range(WIDTH + 1)
    )
    nodes = _rollup(
        blocks.join(stage(values, "values"), "conv_id"),
        f"""min(conv_id) as conv_id, count(*) as n_convs, sum(leaf) as n_leaves, sum(shared) as shared,
        min_by(shared, conv_id) as shared_first, min_by(opens, conv_id) as opens_first,
        min_by(len, conv_id) as len_first, min_by(above, conv_id) as above_first, {children}""",
    )
    level = (F.col("depth") - F.col("block") * WIDTH).cast("int")
    opened = F.get(F.array(*[f"c{i}" for i in range(WIDTH + 1)]), level)
    return nodes.join(ends(last), "node", "left").select(
        "conv_id",
        "depth",
        F.when(F.col("opens_first") < F.col("depth"), F.col("conv_id"))
        .when(F.col("depth") > 0, F.col("above_first"))
        .alias("parent_conv_id"),
        "n_convs",
        (opened + (F.col("len_first") > F.col("depth")).cast("bigint")).alias("n_children"),
        "n_leaves",
        (F.col("shared") - F.col("shared_first") - (F.col("n_convs") - 1) * F.col("up")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
