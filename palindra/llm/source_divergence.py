"""How the sources of a language differ in their words: divergences of all pairs, and
the terms that mark a source.

A term is a run of letters A-Z (lower-cased), a-z and characters beyond ASCII. A
language keeps the terms of at least ``min_docs`` of its documents. Source and language
give every kept term a share in billionths, ``p = 1 + (SCALE * (n + 1)) div (N + V)``;
``f(p, q) = (p - q)^2 div q`` is what a term adds to the divergence of p from q.

Most terms are absent from most sources, and an absent term has the same share z in all
of a source. So a pair starts from ``V * f(z, z')``, and only terms that one or both
sources have correct that. Terms that one source has are corrected by the source's
distinct shares. Terms that both have are read off a frequent-pattern tree:

1. A term's row lists its nonzero counts in the order of its language's sources. Equal
   rows are counted first, which gives each its multiplicity.
2. Rows are sorted by range, so the rows of a task are a tree in depth-first order: a
   row opens the nodes below the path that it shares with the row before.
3. Each node corrects its pair with each ancestor once, by its multiplicity. A node that
   a batch or task boundary cuts is two nodes, whose sums add up.

Everything is exact: products beyond 64 bits are decimals, and sums inside tasks are
Python integers.

Null texts, languages and sources count as empty; an empty text has no term, its group
is reported all the same. Every row is a document, repeated ids too; ``doc_id`` is not
read. Other columns are ignored. An empty table gives no rows. A term's row has at most
as many counts as its language has sources, whose square the result lists anyway.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palindra.llm.words import slices, texts_of, words
from palindra.operators.ordered import newest
from palindra.session import stage

SCALE = 1_000_000_000
#: Bytes of documents whose terms are counted together before Spark adds them up.
SLICE = 1 << 24
#: Pairs of a node and an ancestor that are worked on at once.
PAIRS = 1 << 21
#: Groups (language, source) up to which their table is broadcast.
FEW_GROUPS = 100_000
COUNTED = "lang string, source string, term string, n bigint, docs bigint"
SUMS = "lang string, one int, two int, high bigint, low bigint, high_back bigint, low_back bigint"
_lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def counted_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term of a
    group. A group has a row without term too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pa.table({"lang": batch.column(0), "source": batch.column(1)})
            groups = names.group_by(["lang", "source"]).aggregate([])
            at = {k: i for i, k in enumerate(zip(groups["lang"].to_pylist(), groups["source"].to_pylist()))}
            group = np.array([at[k] for k in zip(names["lang"].to_pylist(), names["source"].to_pylist())], np.int64)
            yield from _rows(groups, np.arange(len(groups)), pa.nulls(len(groups), pa.string()), 0, 0)
            texts = texts_of(batch.column(2))
            for lo, hi in slices(texts, SLICE):
                found = words(texts, lo, hi, letters=True)
                if not len(found.hash):
                    continue
                _, first, term = np.unique(found.hash, return_index=True, return_inverse=True)
                size = len(first)
                pair, n = np.unique(found.doc * size + term, return_counts=True)
                key = group[lo + pair // size] * size + pair % size
                order = np.argsort(key, kind="stable")
                begins = np.flatnonzero(np.diff(key[order], prepend=-1))
                key = key[order][begins]
                spelled = pa.array(
                    [texts.bytes_of(s, e).translate(_lower) for s, e in zip(found.start[first], found.end[first])], pa.binary()
                ).cast(pa.string())
                docs = np.diff(begins, append=len(order))
                yield from _rows(groups, key // size, spelled.take(pa.array(key % size)), np.add.reduceat(n[order], begins), docs)

    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return (
        named.mapInArrow(run, COUNTED)
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )


def _rows(groups: pa.Table, group: np.ndarray, term: pa.Array, n, docs) -> Iterator[pa.RecordBatch]:
    own = groups.take(pa.array(group))
    full = lambda x: pa.array(np.broadcast_to(x, len(group)).astype(np.int64))
    found = pa.table({"lang": own["lang"], "source": own["source"], "term": term, "n": full(n), "docs": full(docs)})
    yield from found.combine_chunks().to_batches(max_chunksize=50_000)


def share(n: Column, total: Column, terms: Column) -> Column:
    """Billionths of a term with ``n`` of ``total`` occurrences, one added to each."""
    wide = (n + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(total + terms > 0, F.call_function("div", wide, (total + terms).cast("decimal(20,0)")) + 1).cast("bigint")


def gap(p: Column, q: Column) -> Column:
    """What a term with these shares adds to the divergence of p from q."""
    return F.call_function("div", (p - q) * (p - q), q)


def beside(df: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Join a staged table of groups, by broadcast if it is small."""
    return df.join(F.broadcast(few) if few.count() <= FEW_GROUPS else few, keys)


class Audit:
    """The tables of one audit, written once; the reports are lazy."""

    def __init__(self, docs: DataFrame, min_docs: int = 3):
        counts = stage(counted_terms(docs), "term-counts")
        of_term = Window.partitionBy("lang", "term")
        self.kept = stage(
            counts.where("term is not null")
            .withColumn("in_docs", F.sum("docs").over(of_term))
            .withColumn("in_lang", F.sum("n").over(of_term))
            .withColumn("first", F.row_number().over(of_term.orderBy("source")) == 1)
            .where(F.col("in_docs") >= min_docs)
            .select("lang", "source", "term", "n", "in_lang", "first"),
            "kept-terms",
        )
        sizes = self.kept.groupBy("lang").agg(F.count_if("first").alias("terms"), F.sum("n").alias("lang_total"))
        totals = self.kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        none = F.lit(0).cast("bigint")
        self.groups = stage(
            counts.where("term is null")
            .select("lang", "source")
            .join(totals, ["lang", "source"], "left")
            .join(sizes, "lang", "left")
            .select(
                "lang",
                "source",
                F.row_number().over(Window.partitionBy("lang").orderBy("source")).alias("sid"),
                *[F.coalesce(c, none).alias(c) for c in ("total", "terms", "lang_total")],
            )
            .withColumn("z", share(none, F.col("total"), F.col("terms"))),
            "groups",
        )
        self.shares = beside(self.kept, self.groups, ["lang", "source"]).withColumn(
            "p", share(F.col("n"), F.col("total"), F.col("terms"))
        )

    def marking_terms(self, top: int = 200) -> DataFrame:
        """(lang, source, item, value, rank): terms a source has more often than its
        language, by what they add to its divergence."""
        q = share(F.col("in_lang"), F.col("lang_total"), F.col("terms"))
        rows = (
            self.shares.withColumn("q", q)
            .where("p > q")
            .select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
        )
        order = [F.col("value").desc(), F.col("item")]
        return newest(rows, ["lang", "source"], order, top, F.pmod(F.xxhash64("item"), F.lit(64)))

    def patterns(self) -> DataFrame:
        """(lang, row, times): the distinct term rows of at least two counts."""
        item = F.struct("sid", "n", "p", "z")
        rows = self.shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(item)).alias("row"))
        return rows.where(F.size("row") > 1).groupBy("lang", "row").agg(F.count("*").alias("times"))

    def both_have(self) -> DataFrame:
        """(lang, one, two, there, back): corrections by terms that both sources have."""
        rows = stage(self.patterns(), "patterns")
        tree = rows.repartitionByRange("lang", "row").sortWithinPartitions("lang", "row")
        flat = tree.select("lang", "times", "row.sid", "row.n", "row.p", "row.z")
        word = F.lit(1 << 40).cast("decimal(14,0)")
        sums = flat.mapInArrow(_walk, SUMS).groupBy("lang", "one", "two").agg(
            *[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low", "high_back", "low_back")]
        )
        return sums.select(
            "lang", "one", "two",
            (F.col("high").cast("decimal(20,0)") * word + F.col("low")).cast("bigint").alias("there"),
            (F.col("high_back").cast("decimal(20,0)") * word + F.col("low_back")).cast("bigint").alias("back"),
        )

    def divergences(self) -> DataFrame:
        """(lang, source, item, value): of every source from every other one."""
        wide = lambda c: c.cast("decimal(38,0)")
        here = self.groups.select("lang", F.col("sid").alias("one"), F.col("z").alias("z1"), "terms")
        there = self.groups.select("lang", F.col("sid").alias("two"), F.col("z").alias("z2"))
        apart = F.col("one") != F.col("two")
        z1, z2, p = F.col("z1"), F.col("z2"), F.col("p")
        base = beside(here, there, ["lang"]).where(apart).select(
            "lang", "one", "two", F.when(F.col("terms") > 0, wide(F.col("terms")) * gap(z1, z2).cast("decimal(19,0)")).otherwise(0).cast("decimal(38,0)").alias("v")
        )
        seen = self.shares.groupBy("lang", F.col("sid").alias("one"), F.col("z").alias("z1"), "p").agg(F.count("*").alias("times"))
        alone = beside(seen, there, ["lang"]).where(apart).groupBy("lang", "one", "two").agg(
            F.sum(wide(F.col("times")) * (gap(p, z2) - gap(z1, z2)).cast("decimal(19,0)")).cast("decimal(38,0)").alias("there"),
            F.sum(wide(F.col("times")) * (gap(z2, p) - gap(z2, z1)).cast("decimal(19,0)")).cast("decimal(38,0)").alias("back"),
        )
        parts = [base]
        for found in (alone, self.both_have()):
            parts.append(found.select("lang", "one", "two", wide(F.col("there")).alias("v")))
            parts.append(found.select("lang", F.col("two").alias("one"), F.col("one").alias("two"), wide(F.col("back")).alias("v")))
        total = parts[0]
        for part in parts[1:]:
            total = total.unionByName(part)
        total = total.groupBy("lang", "one", "two").agg(F.sum("v").cast("bigint").alias("value"))
        named = self.groups.select("lang", "sid", "source")
        total = beside(total, named.select("lang", F.col("sid").alias("one"), "source"), ["lang", "one"])
        total = beside(total, named.select("lang", F.col("sid").alias("two"), F.col("source").alias("item")), ["lang", "two"])
        return total.select("lang", "source", "item", "value")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the corrections of the tree that the sorted rows are."""
    sums: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
    for batch in batches:
        times = batch.column(1).to_numpy()
        lists = batch.column(2)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        base, offsets = offsets[0], offsets - offsets[0]
        sid, n, p, z = (
            batch.column(i).values.slice(int(base), int(offsets[-1])).to_numpy().astype(np.int64) for i in range(2, 6)
        )
        coded = pc.dictionary_encode(batch.column(0))
        lang, langs = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        first, parent, weight = tree_nodes(lang, offsets, sid, n, times)
        size = int(sid.max(initial=0)) + 1
        for lo, hi in _bounded(first - parent, PAIRS):
            depth = (first - parent)[lo:hi]
            two = np.repeat(first[lo:hi], depth)
            one = np.repeat(parent[lo:hi], depth) + np.arange(len(two)) - np.repeat(np.cumsum(depth) - depth, depth)
            row = np.searchsorted(offsets, two, "right") - 1
            key = (lang[row] * size + sid[one]) * size + sid[two]
            order = np.argsort(key, kind="stable")
            begins = np.flatnonzero(np.diff(key[order], prepend=-1))
            m = np.repeat(weight[lo:hi], depth)
            for way, (a, b) in enumerate(((one, two), (two, one))):
                low, high = _corrections(p[a], p[b], z[a], z[b], m)
                low, high = np.add.reduceat(low[order], begins), np.add.reduceat(high[order], begins)
                for k, x, y in zip(key[order][begins].tolist(), low.tolist(), high.tolist()):
                    sums[langs[k // size // size], k // size % size, k % size][way] += (y << 31) + x
    rows = [(*k, a >> 40, a & (1 << 40) - 1, b >> 40, b & (1 << 40) - 1) for k, (a, b) in sums.items()]
    names = [x.split()[0] for x in SUMS.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
    for at in range(0, len(rows), 50_000):
        columns = zip(*rows[at : at + 50_000])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def tree_nodes(lang, offsets, sid, n, times) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every node below the first level: the place of its count, the place at which
    its row begins, and how many terms pass it.

    Rows follow each other in depth-first order; a node stands where a row leaves the
    path of the row before.
    """
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    depth = np.arange(len(row)) - offsets[row]
    before = np.maximum(row - 1, 0)
    other = offsets[before] + depth
    same = (row > 0) & (depth < sizes[before]) & (lang[row] == lang[before])
    other = np.where(same, other, 0)
    same &= (sid == sid[other]) & (n == n[other])
    leaves = np.where(same, np.iinfo(np.int64).max, depth)
    left = np.minimum.reduceat(leaves, offsets[:-1]) if len(sizes) else leaves
    fresh = depth >= left[row]
    order = np.argsort(depth, kind="stable")
    begins = np.flatnonzero(fresh[order])
    weight = np.add.reduceat(times[row[order]], begins) if len(begins) else begins
    first = order[begins]
    below = depth[first] > 0
    return first[below], offsets[row[first[below]]], weight[below]


def _bounded(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` in sum."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        done = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield lo, hi
        lo = hi


def _corrections(p1, p2, z1, z2, times) -> tuple[np.ndarray, np.ndarray]:
    """What both having a term changes beyond what each alone does, in two words of 31 bits and more."""
    f = lambda p, q: (p - q) * (p - q) // q
    one = f(p1, p2) - f(p1, z2) - f(z1, p2) + f(z1, z2)
    return (one & (1 << 31) - 1) * times, (one >> 31) * times


def report(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source of
    the language, part ``term`` the ``top`` terms that mark the source. Ranks start at 1,
    the largest value first, equal ones by the item's UTF-8 bytes."""
    audit = Audit(docs, min_docs)
    ranks = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = audit.divergences().withColumn("rank", F.row_number().over(ranks)).withColumn("part", F.lit("pair"))
    terms = audit.marking_terms(top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
