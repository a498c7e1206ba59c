"""N-gram Jaccard self-join by token-combination prefixes.

Documents are sets of hashed word shingles.  Equal sets become one node (the
least id of the class), so copies cost one row each and no pairs.  Shingles that
many nodes share are *frequent*; the global order puts rare shingles first.

A node of n shingles can lack at most tau = n - ceil(t n) of a partner's, so of
any tau + 1 rare shingles one is shared.  Its prefix is its first tau + 1 rare
shingles, each indexed alone.  Where it has too few, the prefix is extended by
frequent shingles that are dealt to classes by hash; a class of m of them
withstands m - 1 losses, so pairs of one class are indexed until the classes
together outlast tau.  The number of classes follows the set's size (in bands of
powers of two; a node also serves the next band if a partner may lie there), so
the indexed combinations stay in proportion to the set.

Buckets with the same members count once.  A bucket of up to BUCKET nodes is
searched pair by pair; size and a parity bitmap (the bits on which two bitmaps
differ never outnumber the shingles on which the sets differ) drop hopeless pairs
inside the join.  In a larger bucket the combination is extended by a further
token instead, so that no large bucket is ever paired: against the core, which is the
shingles that most members have, every member x has the difference D(x), and x and y
link exactly if D(x) and D(y) differ in at most c (n(x) + n(y)) shingles, c = (1 - t) /
(1 + t).  With e(x) = |D(x)| - c n(x), pairs of e(x) + e(y) <= 0 link whatever they
hold, and all of them link with the member of least e: one star connects them.  All
others share a shingle of D: of the one with the lower e among its first c n + 1, of
the other among its first (1 / t - 1) n + 1, in order of how many members have it
there.  These are the next buckets.  Their members agree on that shingle, so it is in
none of the next differences, and this ends.

The search finds what is connected, not every pair: members of one component
are not compared again.  Candidates are verified on the full sets under a hash
that is independent of the index's.

Rows with a null key get no component and link with nothing; null and wordless
texts have empty sets and are their own component.  Rows that repeat a key are one
document with several texts.  Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, ship
from .components import connected_components

#: A shingle in the searched part of more nodes than this is frequent.
FREQUENT = 32
#: A set's searched part is its prefix and a further 1 / SLACK of it, for frequent shingles among them.
SLACK = 3
#: Bits of a shingle's hash that the index leaves out; shingles that then agree only add candidates.
SHORTER = 16
#: Fewest bits of a parity bitmap; a set of n gets the next power of two from n / 2 on.
BITMAP = 512
#: Rows of a list of ids up to which it is broadcast (24 MB at most); beyond it a shuffled join is used.
BROADCAST_IDS = 1_000_000
#: Nodes up to which a bucket is searched pair by pair, and an extended one, where whole bitmaps decide inside the join.
BUCKET, EXTENDED_BUCKET = 64, 512
#: Shingles of cores up to which these are broadcast (32 MB).
BROADCAST_SHINGLES = 4_000_000
#: Seed of the hash that verifies; the index has seed 0.
VERIFIER = 1
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of many texts at once, from Arrow's buffers."""

    def __init__(self, words: int, seed: int = 0):
        self.words = words
        self.seed = np.uint64(seed << 56)
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.blank = np.zeros(256, bool)
        self.blank[[32, *range(9, 14)]] = True
        self.factor = _mix((np.arange(words, dtype=np.uint64) + np.uint64(1000 + seed)) * _GOLD) | np.uint64(1)

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        n = len(column)
        if not n:
            return
        column = column.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
        start = 0
        while start < n:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + CHUNK, "right")) - 1)
            size = int(offsets[end] - offsets[start])
            data = np.frombuffer(column.buffers()[2], np.uint8, size, int(offsets[start])) if size else np.zeros(0, np.uint8)
            yield from self._chunk(data, offsets[start : end + 1] - offsets[start])
            start = end

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        data = self.lower[data]
        inside = ~self.blank[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.concatenate([inside[1:], [False]]) if len(data) else inside
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        # A word's hash adds up one mixed number for each of its bytes and their places in it.
        place = np.arange(len(data), dtype=np.uint64)
        place[inside] -= np.repeat(starts, ends - starts).astype(np.uint64)
        total = np.concatenate([[np.uint64(0)], np.cumsum(_mix((place << np.uint64(8) | data | self.seed) * _GOLD), dtype=np.uint64)])
        word = _mix(total[ends] - total[starts] + (ends - starts).astype(np.uint64) * _GOLD)
        k, first = self.words, np.searchsorted(starts, offsets)
        m = max(0, len(word) - k + 1)
        rolled = np.zeros(m, np.uint64)
        for j in range(k):
            rolled += word[j : j + m] * self.factor[j]
        rolled = _mix(rolled).view(np.int64)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(rolled[a : b - k + 1])
            elif b > a:
                short = (word[a:b] * self.factor[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield _mix(np.array([short], np.uint64)).view(np.int64)
            else:
                yield np.zeros(0, np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    sizes = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(values.astype(np.int64)))


class Threshold:
    """Integer forms of the Jaccard bound t = num / den."""

    def __init__(self, num: int, den: int):
        t = Fraction(num, den)
        self.num, self.den = t.numerator, t.denominator
        if not 2 * self.num > self.den:
            raise ValueError("the threshold must be above one half")
        #: The smallest set that can link with a different one.
        self.least = -(-self.num // (self.den - self.num))

    def loss(self, n):
        """Most shingles of a set of n that a partner may lack; for numbers or arrays."""
        return n - -(-(n * self.num) // self.den)

    def searched(self, n):
        """Shingles of a set that are looked at first."""
        need = self.loss(n) + 1
        return np.minimum(n, need + np.maximum(8, need // SLACK))


def _signed(docs: DataFrame, key: str, text: str, words: int, bound: Threshold) -> DataFrame:
    """key, n, fp1, fp2, region (its first shingles by hash), bitmap, m0 and m1 (the bitmap folded to 128 bits): all that the search needs, from one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            n, fp1, fp2, region, bits, m0, m1 = [], [], [], [], [], [], []
            for s in shingler.sets(batch.column(1)):
                n.append(len(s))
                a, b = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                fp1.append(a)
                fp2.append(b)
                linked = len(s) >= bound.least
                region.append(s[: int(bound.searched(len(s)))] >> SHORTER if linked else s[:0])
                width = max(BITMAP, 1 << (max(len(s), 2) // 2 - 1).bit_length())
                bits.append(np.packbits((np.bincount(s & (width - 1), minlength=width) & 1).astype(np.uint8)).view(np.int64) if linked else s[:0])
                short = np.bitwise_xor.reduce(bits[-1].reshape(-1, 2), 0) if linked else (0, 0)
                m0.append(short[0])
                m1.append(short[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64()), _lists(region), _lists(bits), pa.array(m0, pa.int64()), pa.array(m1, pa.int64())], names=["key", "n", "fp1", "fp2", "region", "bitmap", "m0", "m1"])

    source = docs.select(docs[key].alias("key"), docs[text].alias("t"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n long, fp1 long, fp2 long, region array<long>, bitmap array<long>, m0 long, m1 long")


def _bounded(df: DataFrame) -> DataFrame:
    """``df``, broadcast if it has at most BROADCAST_IDS rows (of up to three numbers)."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _full_sets(docs: DataFrame, key: str, text: str, words: int, ids: DataFrame, seed: int = 0) -> DataFrame:
    """key, shingles (hashed under ``seed``) of the documents whose key is in ids(node)."""
    source = docs.select(docs[key].alias("key"), docs[text].alias("t"))
    source = source.join(_bounded(ids), source["key"] == ids["node"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(list(shingler.sets(b.column(1))))], names=["key", "shingles"])

    return source.mapInArrow(run, T.StructType([T.StructField("key", source.schema[0].dataType), T.StructField("shingles", T.ArrayType(T.LongType()))]))


def _band(n: int) -> int:
    return max(4, n.bit_length())


def combination_prefix(tokens: np.ndarray, frequent: np.ndarray, bound: Threshold, n: int) -> np.ndarray:
    """Signatures of one set of n shingles: its rare prefix alone, and combinations of two frequent shingles of a class where those don't suffice."""
    need = int(bound.loss(n)) + 1
    rare, often = np.sort(tokens[~frequent]), np.sort(tokens[frequent])
    out = [rare[:need]]
    if len(rare) < need:
        for band in {_band(n), _band(n * bound.den // bound.num)}:
            classes = max(1, (1 << band) // 64)
            of = (_mix(often.view(np.uint64) + _GOLD) % np.uint64(classes)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            place = np.empty(len(often), np.int64)  # place of a shingle in its class, by the global order
            begins = np.searchsorted(of[order], np.arange(classes))
            place[order] = np.arange(len(often)) - begins[of[order]]
            covered = np.cumsum(place > 0)
            take = min(len(often), int(np.searchsorted(covered, need - len(rare))) + 1)
            used, where = often[:take].view(np.uint64), of[:take]
            for c in np.unique(where):
                own = used[where == c]
                i, j = np.triu_indices(len(own), 1)
                out.append(_mix(own[i] * _M1 + own[j] * _M2 + np.uint64(band)).view(np.int64))
    return np.unique(np.concatenate(out))


def _signatures(docs: DataFrame, key: str, text: str, words: int, bound: Threshold, nodes: DataFrame) -> DataFrame:
    """(sig, node) under which every two nodes that link meet."""
    postings = nodes.select("node", "n", F.posexplode("region").alias("pos", "tok"))
    shared = postings.groupBy("tok").agg(F.count("*").alias("df")).filter("df >= 2")
    seen = cut(postings.join(shared, "tok").select("node", "n", "pos", "tok", "df"), "postings")
    need = F.expr(f"n - (n * {bound.num} + {bound.den - 1}) div {bound.den} + 1")
    looked = F.least(F.col("n"), need + F.greatest(F.lit(8), F.expr(f"(n - (n * {bound.num} + {bound.den - 1}) div {bound.den} + 1) div {SLACK}")))
    often = F.col("df") > FREQUENT
    short = cut(seen.groupBy("node", "n").agg(F.count(F.when(often, 1)).alias("often")).filter(looked - F.col("often") < need).select("node").distinct(), "short", small=True)
    upto = Window.partitionBy("node").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ranked = seen.withColumn("rank", F.col("pos") - F.count(F.when(often, 1)).over(upto)).filter(~often & (F.col("rank") < need))
    simple = ranked.join(short, "node", "left_anti").select(F.col("tok").alias("sig"), "node")

    sets = _full_sets(docs, key, text, words, short).select(F.col("key").alias("node"), F.explode(F.transform("shingles", lambda x: F.shiftright(x, SHORTER))).alias("tok"))
    flags = cut(seen.filter(often).select("tok").distinct().withColumn("often", F.lit(True)), "flags", small=True)
    flagged = sets.join(_bounded(flags), "tok", "left").groupBy("node").agg(F.collect_list("tok").alias("toks"), F.collect_list(F.coalesce("often", F.lit(False))).alias("flags"))
    kind = flagged.schema["node"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, toks, marks in zip(b.column(0), b.column(1), b.column(2), strict=True):
                t, at = np.unique(toks.values.to_numpy(zero_copy_only=False), return_index=True)
                sigs = combination_prefix(t, marks.values.to_numpy(zero_copy_only=False).astype(bool)[at], bound, len(toks))
                yield pa.RecordBatch.from_arrays([pa.array(sigs), pa.array([node.as_py()] * len(sigs), b.column(0).type)], names=["sig", "node"])

    extended = flagged.mapInArrow(run, T.StructType([T.StructField("sig", T.LongType()), T.StructField("node", kind)]))
    return cut(simple.unionByName(extended).distinct(), "signatures")


def _apart(a: Column, b: Column) -> Column:
    """Bits on which two whole bitmaps differ; that of the larger set is folded to the other's width."""
    def differing(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, p: s + p)

    def folded(x: Column) -> Column:  # sizes within the bound differ by one power of two at most
        half = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    return F.when(F.size(a) > F.size(b), differing(folded(a), b)).when(F.size(a) < F.size(b), differing(a, folded(b))).otherwise(differing(a, b))


def _verified(docs: DataFrame, key: str, text: str, words: int, bound: Threshold, info: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets link."""
    left = info.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("ba"))
    right = info.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("bb"))
    size_ok = F.least("na", "nb") * bound.den >= F.greatest("na", "nb") * bound.num

    near = _apart(F.col("ba"), F.col("bb")) * (bound.num + bound.den) <= (F.col("na") + F.col("nb")) * (bound.den - bound.num)
    hopeful = cut(pairs.distinct().join(left, "a").join(right, "b").filter(size_ok & near).select("a", "b").distinct(), "candidates", small=True)
    ids = cut(hopeful.select(F.col("a").alias("node")).union(hopeful.select("b")).distinct(), "ids", small=True)
    sets = cut(_full_sets(docs, key, text, words, ids, VERIFIER), "sets")
    both = hopeful.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return cut(both.withColumn("c", common).filter(F.col("c") * bound.den >= (F.size("sa") + F.size("sb") - F.col("c")) * bound.num).select("a", "b").distinct(), "links", small=True)


def _may_link(rows: DataFrame, other: DataFrame, bound: Threshold, whole: bool) -> Column:
    """Join condition of two rows of a bucket: different components, sizes and folded (or ``whole``) bitmaps within the bound.

    Hopeless pairs so end inside the join and are never rows."""
    n, m = rows["n"], other["n_2"]
    apart = F.bit_count(rows["m0"].bitwiseXOR(other["m0_2"])) + F.bit_count(rows["m1"].bitwiseXOR(other["m1_2"]))
    near = apart * (bound.num + bound.den) <= (n + m) * (bound.den - bound.num)
    if whole:
        near = near & (_apart(rows["bitmap"], other["bitmap_2"]) * (bound.num + bound.den) <= (n + m) * (bound.den - bound.num))
    return (rows["sig"] == other["sig_2"]) & (rows["comp"] != other["comp_2"]) & (F.least(n, m) * bound.den >= F.greatest(n, m) * bound.num) & near


def _buckets(sigs: DataFrame, info: DataFrame, whole: bool = False) -> DataFrame:
    """(sig, node, m, n, m0, m1, and bitmap if ``whole``): the buckets of two nodes or more with their size m, one of those with the same nodes."""
    has = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"has{i}") for i in (1, 2)]
    sized = sigs.groupBy("sig").agg(F.count("*").alias("m"), *has).filter("m > 1")
    once = cut(sized.groupBy("m", "has1", "has2").agg(F.min("sig").alias("sig")).select("sig", "m"), "once", small=True)
    return cut(sigs.join(_bounded(once), "sig").join(info if whole else info.drop("bitmap"), "node"), "buckets", small=True)


def _labelled(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """``rows`` with the component of their node so far."""
    if comps is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(_bounded(comps), "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")


def _paired(rows: DataFrame, bound: Threshold, extended: bool = False) -> DataFrame:
    """Candidates (a, b) of rows (sig, node, comp, n, m0, m1) that share a bucket; of an ``extended`` one, where one is in the short prefix."""
    carried = ["sig", "node", "comp", "n", "m0", "m1", *(["bitmap"] if extended else [])]
    other = rows.select([F.col(c).alias(f"{c}_2") for c in carried])
    mine = rows.filter("short") if extended else rows
    once = mine["node"] != other["node_2"] if extended else mine["node"] < other["node_2"]
    return mine.join(other, _may_link(mine, other, bound, extended) & once).select(F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b"))


def _undecided(rows: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component."""
    mixed = rows.groupBy("sig").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x != y").select("sig")
    return rows.join(mixed, "sig", "left_semi")


def _differences(large: DataFrame, sets: DataFrame) -> DataFrame:
    """(row, hub, node, n, diff): members of large buckets and what tells their sets from the core of their group.

    Buckets with the same node of least hash, their hub, are one group: mostly these overlap.
    A node that has several sets has a row for each."""
    hubs = large.groupBy("sig").agg(F.min_by("node", F.struct(F.xxhash64("node"), F.col("node"))).alias("hub"))
    members = large.join(_bounded(hubs), "sig").select("hub", "node").distinct()
    rows = members.join(sets.select(F.col("key").alias("node"), "shingles"), "node")
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "hub", "node", "shingles"), "members")
    held = rows.select("hub", F.explode("shingles").alias("tok")).groupBy("hub", "tok").agg(F.count("*").alias("df"))
    most = held.join(_bounded(rows.groupBy("hub").agg(F.count("*").alias("m"))), "hub").filter(F.col("df") * 2 > F.col("m"))
    core = cut(most.groupBy("hub").agg(F.collect_list("tok").alias("core")), "cores", small=True)
    size = core.agg(F.coalesce(F.sum(F.size("core")), F.lit(0))).first()[0]
    rows = rows.join(F.broadcast(core) if size <= BROADCAST_SHINGLES else core, "hub", "left").withColumn("core", F.coalesce("core", F.array().cast("array<long>")))
    diff = F.concat(F.array_except("shingles", "core"), F.array_except("core", "shingles"))
    return cut(rows.select("row", "hub", "node", F.size("shingles").alias("n"), diff.alias("diff")), "differences")


def _stars(diffs: DataFrame, bound: Threshold) -> DataFrame:
    """Links (a, b) with the member of least e, where these follow from the sizes of the differences."""
    e = F.size("diff") * (bound.num + bound.den) - F.col("n") * (bound.den - bound.num)
    rows = diffs.select("hub", "node", e.alias("e"))
    least = rows.groupBy("hub").agg(F.min(F.struct("e", "node")).alias("x"))
    stars = rows.join(_bounded(least), "hub").filter((F.col("e") + F.col("x.e") <= 0) & (F.col("node") != F.col("x.node")))
    return cut(stars.select(F.least("node", "x.node").alias("a"), F.greatest("node", "x.node").alias("b")).distinct(), "stars", small=True)


def _extended(diffs: DataFrame, bound: Threshold) -> DataFrame:
    """(sig, node, short): the next signatures, of hub and token; ``short`` where the token is in the shorter prefix."""
    tokens = diffs.select("row", "hub", "node", "n", F.explode("diff").alias("tok"))
    shared = tokens.groupBy("hub", "tok").agg(F.count("*").alias("df")).filter("df > 1")
    counted = tokens.join(shared, ["hub", "tok"], "left").groupBy("row", "hub", "node", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "tok"))).alias("toks"))
    short = F.expr(f"n * {bound.den - bound.num} div {bound.num + bound.den} + 1")
    upto = F.expr(f"n * {bound.den - bound.num} div {bound.num} + 1")
    prefix = counted.select("hub", "node", short.alias("short"), F.posexplode(F.slice("toks", F.lit(1), upto.cast("int"))).alias("pos", "t")).filter("t.df > 1")
    return cut(prefix.select(F.xxhash64("hub", "t.tok").alias("sig"), "node", (F.col("pos") < F.col("short")).alias("short")).groupBy("sig", "node").agg(F.max("short").alias("short")), "extended")


def _links(docs: DataFrame, key: str, text: str, words: int, bound: Threshold, info: DataFrame, sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that connect all that links connect, and the components (node, component) they make."""

    def verified(pairs: DataFrame) -> DataFrame:
        return _verified(docs, key, text, words, bound, info, pairs)

    live = _buckets(sigs, info)
    links = verified(_paired(_labelled(live.filter(F.col("m") <= BUCKET), None), bound))
    comps = cut(connected_components(links), "components", small=True)
    large = cut(_undecided(_labelled(live.filter(F.col("m") > BUCKET), comps)), "large", small=True)
    sets = None
    while not large.isEmpty():
        if sets is None:
            sets = cut(_full_sets(docs, key, text, words, large.select("node").distinct(), VERIFIER), "sets")
        diffs = _differences(large, sets)
        links = links.unionByName(_stars(diffs, bound))
        comps = cut(connected_components(links), "components", small=True)
        groups = _undecided(_labelled(diffs.withColumnRenamed("hub", "sig"), comps)).withColumnRenamed("sig", "hub").drop("comp")
        extended = _extended(groups, bound)
        dealt = _buckets(extended.select("sig", "node"), info, whole=True).join(extended, ["sig", "node"])
        dealt = cut(_undecided(_labelled(dealt, comps)), "dealt", small=True)
        links = links.unionByName(verified(_paired(dealt.filter(F.col("m") <= EXTENDED_BUCKET), bound, extended=True)))
        comps = cut(connected_components(links), "components", small=True)
        large = cut(_undecided(_labelled(dealt.filter(F.col("m") > EXTENDED_BUCKET).drop("comp", "bitmap"), comps)), "large", small=True)
    return links, comps


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``key``, n_shingles, component_id for each row: the least key reachable by links of Jaccard >= num / den."""
    ship(docs.sparkSession)
    bound = Threshold(num, den)
    base = cut(_signed(docs, key, text, words, bound), "signed")
    classes = base.filter("key IS NOT NULL AND n > 0").groupBy("fp1", "fp2").agg(F.min("key").alias("node"))
    mine = base.select("key", "n", "fp1", "fp2").join(classes, ["fp1", "fp2"], "left")
    # Few rows are copies of another: their list stays small where it may be sent, and the wide rows needn't move.
    copies = cut(mine.filter("key != node").select("key", "fp1", "fp2").distinct(), "copies", small=True)
    linked = base.filter((F.col("n") >= bound.least) & F.col("key").isNotNull())
    nodes = linked.join(_bounded(copies), ["key", "fp1", "fp2"], "left_anti").withColumnRenamed("key", "node")
    info = cut(nodes.select("node", "n", "bitmap", "m0", "m1"), "info")
    _, comps = _links(docs, key, text, words, bound, info, _signatures(docs, key, text, words, bound, nodes))
    out = mine.select("key", "n", F.coalesce("node", "key").alias("node")).join(_bounded(comps), "node", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.coalesce("component", "node")).alias("component_id"))
