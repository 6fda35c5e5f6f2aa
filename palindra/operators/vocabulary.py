"""Vocabulary of a tokenised corpus, and tokens to ids and back."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palindra.functions import text as txt
from palindra.operators.ordered import dense_index
from palindra.session import stage

# The ids of the separator and the two chat markers.
SPECIAL_IDS = {txt.EOS: 0, txt.IM_START: 1, txt.IM_END: 2}

# What of a vocabulary may be sent to every worker: this many of the most frequent
# tokens. Longer ones than HEAD_TOKEN_BYTES go by a digest, so 256 MB bound it all.
HEAD = 1 << 20
HEAD_TOKEN_BYTES = 256
# Parts that one id of a long token is dealt to.
SALTS = 64


def count_tokens(toks: DataFrame, column: str = "tokens") -> DataFrame:
    """(token, n) over an array column; hot tokens combine before the shuffle."""
    return toks.select(F.explode(column).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def build(counts: DataFrame) -> DataFrame:
    """(token, id): the three special tokens, then by falling count and token."""
    spark = counts.sparkSession
    special = spark.createDataFrame(list(SPECIAL_IDS.items()), "token string, id bigint")
    words = counts.where(~F.col("token").isin(*SPECIAL_IDS))
    ranked = dense_index(words, [F.desc("n"), F.asc("token")], "id")
    numbered = ranked.select("token", (F.col("id") + len(SPECIAL_IDS)).alias("id"))
    return stage(numbered.unionByName(special), "vocabulary")


def special_tokens(spark: SparkSession) -> DataFrame:
    """(token, id) that every vocabulary begins with."""
    return spark.createDataFrame(list(SPECIAL_IDS.items()), "token string, id bigint")


def additions(counts: DataFrame, known: DataFrame) -> DataFrame:
    """(token, id) of the tokens that ``known`` lacks, behind its last id, by falling count
    and token. Ids that are out stay as they are."""
    first = known.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
    new = counts.join(known.select("token"), "token", "left_anti")
    return dense_index(new, [F.desc("n"), F.asc("token")], "id").select("token", (F.col("id") + first).alias("id"))


def missing_markers(vocabulary: DataFrame) -> DataFrame:
    """Markers a vocabulary lacks; a usable one gives no rows."""
    wanted = vocabulary.sparkSession.createDataFrame(
        [(txt.IM_START,), (txt.IM_END,)], "token string"
    )
    known = vocabulary.where(F.col("token").isin(txt.IM_START, txt.IM_END))
    return wanted.join(F.broadcast(known), "token", "left_anti")


def separator_id(vocabulary: DataFrame) -> DataFrame:
    """One row: the separator's id, or the end marker's where there is none."""
    found = vocabulary.where(F.col("token").isin(txt.EOS, txt.IM_END))
    return found.agg(F.max_by("id", F.col("token") == txt.EOS).alias("eos_id"))


def _key(token: Column) -> Column:
    """What stands for a token in the head: itself, or a digest of a long one."""
    long = F.concat(F.lit("\x00"), F.sha2(token.cast("binary"), 256))
    return F.when(F.octet_length(token) > HEAD_TOKEN_BYTES, long).otherwise(token)


def _has_tail(vocabulary: DataFrame) -> bool:
    return not vocabulary.where(F.col("id") >= HEAD).isEmpty()


def _known(value: Column, what: str) -> Column:
    """``value``, or an error where a lookup found nothing."""
    return F.coalesce(value, F.raise_error(F.lit(f"{what} is not in the vocabulary")))


def decode(ids: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows with ``token`` in place of ``id``; an id that is none is an error.

    An id joins the short tokens of the head, which are sent to the workers, and
    what they do not hold joins the rest: rare tokens and long ones. Of the latter, ids
    are salted, so that a long token that is frequent is no hot key.
    """
    rest = [c for c in ids.columns if c != "id"]
    short = (F.col("id") < HEAD) & (F.octet_length("token") <= HEAD_TOKEN_BYTES)
    head = F.broadcast(vocabulary.where(short).select("id", F.col("token").alias("_near")))
    salted = vocabulary.where(~short).select("id", F.col("token").alias("_far"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salt = F.pmod(F.xxhash64(*(rest or ["id"])), F.lit(SALTS)).cast("int")
    # rows the head serves get a key of their own and meet nothing
    near = ids.join(head, "id", "left").withColumn("_salt", F.when(F.col("_near").isNull(), salt).otherwise(-1 - salt))
    found = near.join(salted, ["id", "_salt"], "left")
    return found.select(*rest, _known(F.coalesce("_near", "_far"), "an id").alias("token"))


def gather(long: DataFrame, keys: Sequence[str], value: str, into: str) -> DataFrame:
    """Arrays in position order, one per key; a key is one text."""
    items = F.array_sort(F.collect_list(F.struct("pos", value)))
    return long.groupBy(*keys).agg(F.transform(items, lambda s: s[value]).alias(into))


def _head_ids(tokens: Broadcast, ids: Broadcast):
    """Ids of arrays of keys, null for keys that are not in the head."""

    @F.arrow_udf("array<bigint>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = dict(zip(tokens.value.to_pylist(), ids.value.to_pylist()))
        for batch in batches:
            distinct = batch.flatten().dictionary_encode()
            found = pa.array([known.get(t) for t in distinct.dictionary.to_pylist()], pa.int64())
            lengths = pc.fill_null(pc.list_value_length(batch), 0).to_numpy()
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pc.take(found, distinct.indices))

    return ids_of


def encode_arrays(rows: DataFrame, keys: Sequence[str], column: str, vocabulary: DataFrame) -> DataFrame:
    """Replace an array of tokens by its ids; ``keys`` identify a row.

    The most frequent tokens go to the workers, where arrays are looked up in place.
    Of the rest, a row's distinct tokens, not their occurrences, join the rest of the
    vocabulary and are put in where they stand. Arrays keep their lengths; a token that
    the vocabulary lacks is an error, whatever its size.
    """
    head = vocabulary.where(F.col("id") < HEAD).select(_key(F.col("token")).alias("token"), "id").toArrow()
    context = rows.sparkSession.sparkContext
    send = [context.broadcast(head[c].combine_chunks()) for c in ("token", "id")]
    looked = rows.withColumn("_ids", _head_ids(*send)(F.transform(column, _key)))
    if not _has_tail(vocabulary):
        ids = F.transform("_ids", lambda i: _known(i, "a token"))
        return looked.withColumn(column, ids).select(*rows.columns)
    tokens = F.col(column)
    missed = F.array_distinct(F.filter(tokens, lambda t, k: F.get(F.col("_ids"), k).isNull()))
    asked = looked.select(*keys, F.explode(missed).alias("token"))
    tail = vocabulary.where(F.col("id") >= HEAD).select("token", "id")
    told = asked.join(tail, "token").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("token", "id"))).alias("_rare"))
    whole = looked.join(told, list(keys), "left")
    ids = F.zip_with(column, "_ids", lambda t, i: _known(F.coalesce(i, F.try_element_at("_rare", t)), "a token"))
    return whole.withColumn(column, ids).select(*rows.columns)


def _head_tokens(tokens: Broadcast):
    """Tokens of arrays of ids, null for ids that are not in the head; ``tokens`` is indexed by id."""

    @F.arrow_udf("array<string>")
    def tokens_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = tokens.value
        for batch in batches:
            flat = batch.flatten()
            inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(table)))
            found = pc.if_else(inside, pc.take(table, pc.if_else(inside, flat, 0)), pa.scalar(None, pa.string()))
            lengths = pc.fill_null(pc.list_value_length(batch), 0).to_numpy()
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found)

    return tokens_of


def decode_arrays(rows: DataFrame, keys: Sequence[str], column: str, vocabulary: DataFrame) -> DataFrame:
    """Replace an array of ids by its tokens; ``keys`` identify a row.

    The short tokens of the head go to the workers, where arrays are looked up in
    place. Of the rest, a row's distinct ids, not their occurrences, join the rest of
    the vocabulary, salted so that a frequent long token is no hot key, and are put in
    where they stand. An id that is none is an error.
    """
    short = (F.col("id") < HEAD) & (F.octet_length("token") <= HEAD_TOKEN_BYTES)
    head = vocabulary.where(short).select("id", "token").toArrow()
    # one null at least, so that an empty head still takes
    at = np.full(max(HEAD, 1), -1, np.int64)
    at[head["id"].to_numpy()] = np.arange(head.num_rows)
    table = pc.take(head["token"].combine_chunks(), pa.array(at, mask=at < 0))
    lookup = _head_tokens(rows.sparkSession.sparkContext.broadcast(table))
    rest = vocabulary.where(~short)
    if rest.isEmpty():
        tokens = F.transform(lookup(column), lambda t: _known(t, "an id"))
        return rows.withColumn(column, tokens).select(*rows.columns)
    looked = rows.select(*keys, column, lookup(column).alias("_toks"))
    missed = F.array_distinct(F.filter(column, lambda i, k: F.get(F.col("_toks"), k).isNull()))
    salt = F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int")
    asked = looked.select(*keys, salt.alias("_salt"), F.explode(missed).alias("id"))
    salted = rest.select("id", "token", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    told = asked.join(salted, ["id", "_salt"]).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("id", "token"))).alias("_rare")
    )
    # the rows meet the map holding ids only; the head is looked up again behind the join
    whole = rows.join(told, list(keys), "left").withColumn("_toks", lookup(column))
    tokens = F.zip_with(column, "_toks", lambda i, t: _known(F.coalesce(t, F.try_element_at("_rare", i)), "an id"))
    return whole.withColumn(column, tokens).select(*rows.columns)


def encode_texts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc, ids) of (doc, text)."""
    toks = docs.select("doc", txt.tokens(F.col("text")).alias("ids"))
    return encode_arrays(toks, ["doc"], "ids", vocabulary)


def outside(docs: DataFrame, vocab_size: int) -> DataFrame:
    """Rows holding an id that is not inside the vocabulary."""
    return docs.where((F.array_max("ids") >= vocab_size) | (F.array_min("ids") < 0))
