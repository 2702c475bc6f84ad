"""Near-duplicate groups by circulant MinHash.

A document's set: its distinct shingles of ``WORDS`` words, as 64-bit hashes.
Signature: a first permutation scatters the shingles over 2^32 places, a second
one ranks the places; coordinate k ranks them after a circular shift by k, so
two permutations serve all coordinates. Bands of ``ROWS`` coordinates give the
buckets. Whatever shares a bucket is a candidate. Two bits of each of ``COORDINATES`` coordinates
reject pairs that are far apart; exact Jaccard similarity on whole sets confirms
or rejects the others.

Copies are folded first: documents with equal sets are one class, and only
classes are compared. In a first round each bucket's members are compared with
its most central class (the one with the fullest buckets, such as the text that
the others were made from). The second round takes the buckets that confirmed
links have not connected yet: their members are dealt into groups of ``GROUP``,
and each pair of groups is compared as arrays in one place, which emits only near
pairs that no link connects. So candidate search has no cap, and no task holds a
whole bucket. The least similarity of a link is a parameter, and ``similarity``
derives the bands and the signature check from it: a link of similarity s is
missed with (1 - s^ROWS)^bands, at most ``MISSED`` (8e-6 at 0.85, 1e-5 at 0.8),
or if more than ``most_apart`` coordinates differ, at most ``MISSED_APART``.

What is shuffled are keys and sketches: first bare band keys, to find those that
several classes share, then the rows of those keys alone. Filters of bounded size
(``bloom``) find rows in place, so whole texts are never shuffled, at any size.
Comparisons stream: a leader's set is held while its members pass, in groups
that are salted to ``GROUP`` members. Components come from alternating large
and small stars over staged edge tables; nothing about documents is collected.

Null or empty text, or no words: an empty set, linked with nothing. Fewer than
``WORDS`` words: one shingle of all of them. Rows without a doc_id link with
nothing and are kept. Rows that repeat a doc_id: each is judged by its text; of
rows that repeat both, ``first_of_each`` keeps one. Empty table: no rows.
Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom, without
from .common import chunks, staged
from .textscan import join

WORDS = 5
ROWS, MOST_BANDS = 5, 512
#: Coordinates of which two bits are compared.
COORDINATES = 128
#: Share of the union that a link shares at least, unless another is asked for.
LEAST = 0.85
#: Coordinates of which four bits are compared in open buckets.
FINE_COORDINATES = 256
#: Bounds on the links of the least similarity that bands and the signature check miss.
MISSED, MISSED_APART = 1e-5, 1e-7
#: Members that are compared with one leader in one stream, and of one group of an open bucket.
GROUP = 256
#: Bytes of sets of one group of an open bucket, on average.
GROUP_BYTES = 8 << 20

_rng = np.random.default_rng(20240601)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_STEP = _rng.integers(1, 1 << 63, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BAND = _rng.integers(1, 1 << 63, (MOST_BANDS, ROWS + 1), dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True

BITS = [f"bits{i}" for i in range(2 * COORDINATES // 64)]
MARKS = [f"mark{i}" for i in range(4 * FINE_COORDINATES // 64)]
SKETCH = "doc_id long, text_hash long, n_shingles long, node binary, bands array<long>, " + ", ".join(f"{b} long" for b in BITS)


@dataclass(frozen=True)
class Similarity:
    """A link: ``numerator / denominator`` of the union at least is shared."""

    numerator: int
    denominator: int
    bands: int
    most_apart: int
    marks_apart: int


@functools.lru_cache
def similarity(least: float) -> Similarity:
    """The fewest bands and the narrowest signature check within the bounds. Two
    bits of a coordinate differ with 3/4 (1 - least), so 14.4 of 128 on average
    at 0.85 (deviation 3.6) and 19.2 at 0.8 (4.0); four bits with 15/16, so 36 of
    256 at 0.85 (5.6)."""
    share = Fraction(str(least))
    if not 0 < share <= 1:
        raise ValueError("the least similarity must be in (0, 1]")
    bands = 1 if share == 1 else math.ceil(math.log(MISSED) / math.log1p(-(float(share) ** ROWS)))
    if bands > MOST_BANDS:
        raise ValueError(f"a similarity of {least} needs {bands} bands; there are {MOST_BANDS}")
    apart = 1 - float(share)
    return Similarity(share.numerator, share.denominator, bands, _most_apart(COORDINATES, 3 / 4 * apart), _most_apart(FINE_COORDINATES, 15 / 16 * apart))


def _most_apart(coordinates: int, p: float) -> int:
    """The fewest coordinates that a link differs in more of with at most ``MISSED_APART``."""
    chance = [math.comb(coordinates, n) * p**n * (1 - p) ** (coordinates - n) for n in range(coordinates + 1)]
    return next(n for n in range(coordinates + 1) if math.fsum(chance[n + 1 :]) <= MISSED_APART)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation of the 32-bit integers; works in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def _rank(x: np.ndarray) -> np.ndarray:
    """The second one, with other steps; works in place."""
    x ^= np.uint32(0x5BD1E995)
    x ^= x >> np.uint32(17)
    x *= np.uint32(0xED5AD4BB)
    x ^= x >> np.uint32(11)
    x *= np.uint32(0xAC4C1B51)
    x ^= x >> np.uint32(15)
    return x


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    data, starts = join(texts)
    space = _SPACE[data]
    space[starts - 1] = True
    first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not len(first):
        return [np.zeros(0, np.uint64) for _ in texts]
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    size = end - first
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(size.max()), _STEP)]))
    at = np.flatnonzero(~space)
    value = _BYTE[data[at]]
    value *= power[at - np.repeat(first, size)]
    word = _mix64(np.add.reduceat(value, np.cumsum(size) - size) + size.astype(np.uint64) * _PLACE[63])
    bounds = np.searchsorted(first, starts)
    rolled = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for j in range(words):
        rolled += word[j : j + len(rolled)] * _PLACE[j]
    rolled = _mix64(rolled)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= words:
            out.append(np.unique(rolled[lo : hi - words + 1]))
        elif hi > lo:
            out.append(_mix64((word[lo:hi] * _PLACE[: hi - lo]).sum(keepdims=True) + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], k: int = COORDINATES) -> np.ndarray:
    """The k coordinates of each non-empty set."""
    every = np.concatenate(sets)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    scattered = _scatter((every >> np.uint64(32)).astype(np.uint32))
    out = np.empty((len(sets), k), np.uint32)
    for shift in range(k):
        out[:, shift] = np.minimum.reduceat(_rank(scattered + np.uint32(shift)), at)
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    rows = signature[:, : bands * ROWS].reshape(len(signature), bands, ROWS).astype(np.uint64)
    return _mix64((rows * _BAND[:bands, :ROWS]).sum(2) + _BAND[:bands, ROWS]).view(np.int64)


def two_bits(signature: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, 32 coordinates to an integer."""
    part = (signature & np.uint32(3)).astype(np.uint64).reshape(len(signature), -1, 32)
    return (part << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(2).view(np.int64)


def four_bits(signature: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, 16 coordinates to an integer."""
    part = (signature & np.uint32(15)).astype(np.uint64).reshape(len(signature), -1, 16)
    return (part << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(2).view(np.int64)


def _near(a: str, b: str, most_apart: int) -> Column:
    """Whether few enough coordinates of ``a``bits and ``b``bits differ."""
    apart = F.lit(0)
    for name in BITS:
        x = F.col(a + name).bitwiseXOR(F.col(b + name))
        apart = apart + F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(0x5555555555555555)))
    return apart <= most_apart


def _node(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def sketch(docs: DataFrame, bands: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (128-bit hash of the set; null: empty) and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            sets = shingle_sets(texts)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            bits = np.zeros((len(sets), len(BITS)), np.int64)
            if full:
                signed = signatures([sets[i] for i in full], max(COORDINATES, bands * ROWS))
                bits[full] = two_bits(signed[:, :COORDINATES])
                for i, key in zip(full, band_keys(signed, bands)):
                    keys[i] = key
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64())), *(pa.array(np.ascontiguousarray(b)) for b in bits.T)],
                names=["doc_id", "text_hash", "n_shingles", "node", "bands", *BITS],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_hash().alias("text_hash")).mapInArrow(run, SKETCH)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _texts_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """The texts of the classes (node, doc_id, text_hash) of ``nodes``, and a few
    more, found in place by a filter."""
    wanted = staged(classes.join(nodes.distinct(), "node", "left_semi").select(F.xxhash64("doc_id", "text_hash").alias("h")), "wanted")
    narrow = docs.select("text", F.xxhash64(F.col("doc_id").cast("long"), _text_hash()).alias("h"))
    return Bloom.of(wanted, F.col("h")).flagged(narrow, F.col("h"), "wanted").filter("wanted").select("text")


def _sets_of(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """node and its whole set (packed), for the classes of ``pairs`` and a few
    more; staged. What counts is the text that is read, so a repeated doc_id
    can't stand in for another text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            found = {_node(s): s.tobytes() for s in shingle_sets(texts) if len(s)}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["node", "shingles"])

    nodes = pairs.select(F.col("leader").alias("node")).unionByName(pairs.select(F.col("member").alias("node")))
    return staged(_texts_of(docs, classes, nodes).mapInArrow(run, "node binary, shingles binary"), "sets")


def _details_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, four bits of each of ``FINE_COORDINATES`` and the whole set (packed), of
    ``nodes`` and a few more; staged. Rows that repeat doc_id and text repeat theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            found = {_node(s): s for s in shingle_sets(texts) if len(s)}
            if found:
                marks = four_bits(signatures(list(found.values()), FINE_COORDINATES))
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), *(pa.array(np.ascontiguousarray(m)) for m in marks.T), pa.array([s.tobytes() for s in found.values()], pa.binary())], names=["node", *MARKS, "shingles"])

    rows = _texts_of(docs, classes, nodes).mapInArrow(run, "node binary, " + ", ".join(f"{m} long" for m in MARKS) + ", shingles binary")
    return staged(rows, "details")


def _linked_sets(a: np.ndarray, b: np.ndarray, link: Similarity) -> bool:
    """Whether two sets, sorted and not empty, share enough of their union."""
    shared = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return link.denominator * shared >= link.numerator * (len(a) + len(b) - shared)


def _links(pairs: DataFrame, sets: DataFrame, link: Similarity) -> DataFrame:
    """The pairs (leader, member) whose whole sets share enough; staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_set = None, np.zeros(0, np.uint64)
        for batch in batches:
            leaders, members, packed = (batch.column(i) for i in range(3))
            out = []
            for i, (leader, member) in enumerate(zip(leaders.to_pylist(), members.to_pylist())):
                s = np.frombuffer(packed[i].as_buffer(), np.uint64)
                if member is None:  # the leader itself comes first
                    held, held_set = leader, s
                    continue
                if leader != held:
                    raise RuntimeError("a member without its leader")
                if _linked_sets(held_set, s, link):
                    out.append((leader, member))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], names=["a", "b"])

    groups = pairs.groupBy("leader").agg(F.ceil(F.count("*") / GROUP).alias("salts"))
    salted = pairs.join(groups, "leader").withColumn("salt", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int"))
    members = salted.join(sets.withColumnRenamed("node", "member"), "member").select("leader", "member", "shingles", "salt")
    leaders = salted.select("leader", "salt").distinct().join(sets.withColumnRenamed("node", "leader"), "leader").select("leader", F.lit(None).cast("binary").alias("member"), "shingles", "salt")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    streams = leaders.unionByName(members).repartition(n, "leader", "salt").sortWithinPartitions("leader", "salt", F.col("member").asc_nulls_first())
    return staged(streams.select("leader", "member", "shingles").mapInArrow(run, "a binary, b binary"), "links")


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) for every node of ``edges``
    (a, b), by alternating large and small stars until nothing changes."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = staged(large, "large_star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = staged(small, "small_star")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        state = now


def _classes(sketches: DataFrame) -> DataFrame:
    """node, doc_id (the smallest), text_hash, n, bands and bits of every class; staged.
    Most sets are one document's own: only sketches of the others are shuffled."""
    named = sketches.filter("doc_id is not null and node is not null")
    own = F.xxhash64("node")
    shared = staged(named.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select("node"), "shared_sets")
    wide = named.select("node", "doc_id", "text_hash", F.col("n_shingles").alias("n"), "bands", *BITS)
    columns = wide.columns[1:]
    wide = Bloom.of(shared, own).flagged(wide, own, "several")
    folded = wide.filter("several").groupBy("node").agg(F.min(F.struct(*columns)).alias("x")).select("node", *(F.col(f"x.{c}").alias(c) for c in columns))
    return staged(wide.filter("not several").select("node", *columns).unionByName(folded), "classes")


def _buckets(classes: DataFrame) -> DataFrame:
    """key, size, node, n and bits of classes in buckets that they share, and how
    central they are (the sum of their buckets' sizes); staged."""
    keys = classes.select(F.explode("bands").alias("key"))
    shared = staged(keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "shared_keys")
    known = Bloom.of(shared, F.col("key"))
    placed = known.flagged(classes.select("node", F.explode("bands").alias("key")), F.col("key"), "held").filter("held").drop("held")
    placed = staged(placed.join(shared, "key"), "placed")
    central = staged(placed.groupBy("node").agg(F.sum("size").alias("central")), "central")
    own = F.xxhash64("node")
    some = Bloom.of(central, own).flagged(classes.select("node", "n", *BITS), own, "placed").filter("placed").drop("placed")
    return staged(placed.join(some.join(central, "node"), "node").select("key", "node", "n", "central", *BITS), "buckets")


def _stars(rows: DataFrame, link: Similarity) -> DataFrame:
    """leader, member: each bucket's members that may be near its most central class; staged."""
    leader = rows.groupBy("key").agg(F.max(F.struct("central", "node", "n", *BITS)).alias("x"))
    leader = staged(leader.select("key", F.col("x.node").alias("leader"), F.col("x.n").alias("n_leader"), *(F.col(f"x.{b}").alias(f"to_{b}") for b in BITS)), "leaders")
    fits = link.denominator * F.least("n", "n_leader") >= link.numerator * F.greatest("n", "n_leader")
    near = rows.join(leader, "key").filter((F.col("node") != F.col("leader")) & fits & _near("", "to_", link.most_apart))
    return staged(near.select("leader", F.col("node").alias("member")).distinct(), "stars")


_FOURTH_BITS = np.uint64(0x1111111111111111)


def _fours_apart(x: np.ndarray) -> np.ndarray:
    """For rows of exclusive ors the number of groups of four bits that differ."""
    x = x | (x >> np.uint64(1))
    x |= x >> np.uint64(2)
    return np.bitwise_count(x & _FOURTH_BITS).sum(1, dtype=np.int64)


def _open_links(docs: DataFrame, named: DataFrame, rows: DataFrame, root: DataFrame, link: Similarity) -> DataFrame:
    """The links (a, b) between different components in buckets that the stars'
    links have not connected; staged. A bucket's members are dealt into groups of at most
    about ``GROUP`` sets and ``GROUP_BYTES``; each pair of groups is a cell, in
    which one group is held while the other passes. Marks reject pairs that are
    far apart, whole sets decide: they move once for each cell, not for each pair."""
    placed = staged(rows.select("key", "node", "n").join(root, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root")), "rooted")
    groups = F.ceil(F.greatest(F.count("*") / GROUP, F.sum("n") * 8 / GROUP_BYTES)).cast("int")
    open_ = staged(placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), groups.alias("groups")).filter("lo <> hi").select("key", "groups"), "open_keys")
    some = staged(Bloom.of(open_, F.col("key")).flagged(placed, F.col("key"), "held").filter("held").drop("held").join(open_, "key"), "open")
    some = some.withColumn("own", F.pmod(F.xxhash64("node"), F.col("groups")).cast("int"))
    held = some.withColumns({"i": F.col("own"), "j": F.explode(F.sequence(F.col("own"), F.col("groups") - 1)), "side": F.lit(0)})
    passing = some.filter("own > 0").withColumns({"i": F.explode(F.sequence(F.lit(0), F.col("own") - 1)), "j": F.col("own"), "side": F.lit(1)})
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = held.unionByName(passing).join(_details_of(docs, named, some.select("node")), "node")
    cells = cells.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "side")

    def arrays(part: pa.RecordBatch) -> tuple:
        marks = np.stack([part.column(m).to_numpy().view(np.uint64) for m in MARKS], 1)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("shingles")]
        return np.array(part.column("node").to_pylist(), object), np.array(part.column("root").to_pylist(), object), marks, part.column("n").to_numpy(), sets

    def near(a: tuple, b: tuple) -> Iterator[tuple[bytes, bytes]]:
        x, y = a[3][:, None], b[3][None, :]
        ok = link.denominator * np.minimum(x, y) >= link.numerator * np.maximum(x, y)
        p, q = np.nonzero(ok & (a[1][:, None] != b[1][None, :]))
        close = _fours_apart(a[2][p] ^ b[2][q]) <= link.marks_apart
        for u, v in zip(p[close].tolist(), q[close].tolist()):
            if a[0][u] < b[0][v] and _linked_sets(a[4][u], b[4][v], link):
                yield a[0][u], b[0][v]
            elif a[0][u] > b[0][v] and a is not b and _linked_sets(b[4][v], a[4][u], link):
                yield b[0][v], a[0][u]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, group = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j", "side")], 1)
            cuts = [0, *(1 + np.flatnonzero((np.diff(place, axis=0) != 0).any(1))).tolist(), batch.num_rows]
            pairs: set[tuple[bytes, bytes]] = set()
            for lo, hi in zip(cuts, cuts[1:]):
                *here, side = place[lo].tolist()
                if here != cell:
                    cell, group = here, []
                for at in range(lo, hi, GROUP):
                    part = arrays(batch.slice(at, min(GROUP, hi - at)))
                    inside = here[1] == here[2]  # a group against itself
                    if side or inside:
                        pairs.update(*(near(other, part) for other in group))
                    if inside:
                        pairs.update(near(part, part))
                    if not side:
                        group.append(part)
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in pairs], pa.binary()), pa.array([v for _, v in pairs], pa.binary())], names=["a", "b"])

    return staged(cells.select("key", "i", "j", "side", "n", "node", "root", *MARKS, "shingles").mapInArrow(compare, "a binary, b binary").distinct(), "open_links")


def _linked(docs: DataFrame, sketches: DataFrame, link: Similarity) -> DataFrame:
    """node and component_id of every class that has links or several rows; staged."""
    classes = _classes(sketches)
    rows = _buckets(classes)
    stars = _stars(rows, link)
    named = classes.select("node", "doc_id", "text_hash")
    links = _links(stars, _sets_of(docs, named, stars), link)
    root = components(links)
    more = _open_links(docs, named, rows, root, link)
    if not more.isEmpty():
        root = staged(components(links.unionByName(more)), "roots")
    smallest = named.join(root, "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = root.join(smallest, "root").select("node", "component_id")
    several = sketches.filter("doc_id is not null and node is not null").groupBy("node").agg(F.min("doc_id").alias("own_id"), F.count("*").alias("n")).filter("n > 1")
    return staged(several.select("node", "own_id").join(linked, "node", "full_outer").select("node", F.coalesce("component_id", "own_id").alias("component_id")), "by_class")


def _decisions(docs: DataFrame, least: float) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id of every row."""
    link = similarity(least)
    sketches = staged(sketch(docs, link.bands), "sketches")
    by_class = _linked(docs, sketches, link)
    out = sketches.select("doc_id", "text_hash", "n_shingles", "node").join(by_class, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"))


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links of ``least``
    similarity reach) and kept (the document that stays for its component), for
    every row."""
    return _decisions(docs, least).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def first_of_each(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows, all columns as they are, that stay for their component; of rows
    that repeat doc_id and text one. Rows without a doc_id stay, each of them."""
    named = docs.filter(F.col("doc_id").isNotNull())
    kept = F.col("doc_id") == F.col("component_id")
    rows = _decisions(named, least).groupBy(F.col("doc_id").alias("k0"), F.col("text_hash").alias("k1")).agg(F.bool_and(kept).alias("kept"), F.count("*").alias("times"))
    key = lambda df: [F.col("doc_id").cast("long"), _text_hash()]
    return without(docs, key, staged(rows, "decided"), F.col("doc_id").isNotNull())
