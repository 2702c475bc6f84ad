"""Blocked Bloom filters in DataFrame operations, and exact removal of rows by them.

A filter has blocks of 32,768 bits, a row for each block; a key has one block and
sets ``PROBES`` bits of it. Its size follows the number of keys and never exceeds
``MOST_BLOCKS`` blocks (128 MB), so it may always be broadcast. More keys than
that mean more false positives, never a missed key.

``Cascade`` tells two disjoint sets of keys apart without error: the first filter
holds the dropped keys, the second one the kept keys that the first lets through,
the third one the dropped keys that the second lets through, and so on until
nothing is left. What filters at their bound can't tell is joined exactly."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

BLOCK_BITS, MOST_BLOCKS, PROBES = 1 << 15, 1 << 15, 3
#: Bits for each key, below the bound; 0.07 % false positives.
KEY_BITS = 32
#: Filters of a cascade; each one is to leave a thousandth.
LEVELS = 6


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


@dataclass(frozen=True)
class Bloom:
    bits: DataFrame | None  # block, bits; None: no key
    blocks: int
    seed: int

    @staticmethod
    def of(keys: DataFrame, key: Column, seed: int = 0) -> Bloom:
        """The filter of ``key`` (a 64-bit hash) over all rows of ``keys``,
        which should be a staged table: it is counted, then read once."""
        n = keys.count()
        if not n:
            return Bloom(None, 1, seed)
        blocks = min(MOST_BLOCKS, 1 << max(0, (-(-n * KEY_BITS // BLOCK_BITS) - 1).bit_length()))
        block, places = _places(key, blocks, seed)
        shuffles = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = keys.select(block.alias("block"), F.explode(F.array(*places)).alias("place")).repartition(min(blocks, shuffles), "block")
        return Bloom(staged(rows.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits")), "bloom"), blocks, seed)

    def flagged(self, df: DataFrame, key: Column, name: str) -> DataFrame:
        """``df`` and whether the filter may hold ``key``; null keys aren't held."""
        if self.bits is None:
            return df.withColumn(name, F.lit(False))
        block, places = _places(key, self.blocks, self.seed)
        b, own = fresh(df, "__block", "__bits")
        right = F.broadcast(self.bits.select(F.col("block").alias(b), F.col("bits").alias(own)))  # MOST_BLOCKS blocks at most
        rows = df.join(right, block == F.col(b), "left")
        held = F.col(own).isNotNull()
        for p in places:
            held = held & _bit(own, p)
        return rows.withColumn(name, held).drop(b, own)


def _places(key: Column, blocks: int, seed: int) -> tuple[Column, list[Column]]:
    block = F.pmod(F.xxhash64(key, F.lit(2 * seed)), F.lit(blocks))
    mixed = F.xxhash64(key, F.lit(2 * seed + 1))
    places = [F.shiftrightunsigned(mixed, 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(PROBES)]
    return F.when(key.isNotNull(), block), places


def _bit(bits: str, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    mask = F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), (place.bitwiseAND(F.lit(7)) + 1).cast("int"))
    return byte.bitwiseAND(mask) != 0


def without(docs: DataFrame, key: Callable[[DataFrame], Sequence[Column]], decided: DataFrame, within: Column | None = None) -> DataFrame:
    """The rows of ``docs``, columns as they are, whose key ``decided`` keeps;
    of rows with equal keys one. ``key`` gives the columns k0, k1, ... of a row;
    ``decided`` is a staged table with k0, k1, ..., kept (a boolean) and times, a row for
    each distinct key of ``docs``. Rows where ``within`` doesn't hold have
    keys that aren't in ``decided``; they stay.

    Texts aren't shuffled, except those of keys that rows repeat and of those
    that full filters can't tell apart."""
    names = [c for c in decided.columns if c not in ("kept", "times")]
    h = F.xxhash64(*names)
    # of repeated keys all rows are dropped at first, and one comes back
    gone, stay = decided.filter("not kept or times > 1"), decided.filter("kept and times = 1")
    filters: list[Bloom] = []
    sides = [gone, stay]
    rest = gone
    while len(filters) < LEVELS:
        level = Bloom.of(rest, h, len(filters))
        filters.append(level)
        if level.bits is None:
            break
        # the other side's keys that every filter so far lets through
        other = level.flagged(sides[len(filters) % 2], h, "__in").filter("__in").drop("__in")
        sides[len(filters) % 2] = rest = staged(other, "let_through")
    told_apart = filters[-1].bits is None
    filters = [f for f in filters if f.bits is not None]
    hashed, = fresh(docs, "__key")
    columns = list(docs.columns)
    own = F.xxhash64(*key(docs))
    rows = docs.withColumn(hashed, own if within is None else F.when(within, own))
    flags = []
    for f in filters:
        flag, = fresh(rows, "__in")
        rows = f.flagged(rows, F.col(hashed), flag)
        flags.append(flag)
    # the first filter that a key isn't in tells its side: dropped keys begin
    verdict = F.lit("unknown" if not told_apart else "dropped" if len(flags) % 2 else "kept")
    for n, flag in reversed(list(enumerate(flags))):
        verdict = F.when(F.col(flag), verdict).otherwise("dropped" if n % 2 else "kept")
    out = rows.filter(verdict == "kept").select(*columns)
    if not told_apart:
        open_ = rows.filter(verdict == "unknown").select(*columns)
        out = out.unionByName(_joined(open_, key, gone.select(*names), "left_anti").select(*columns))
    again = decided.filter("kept and times > 1").select(*names)
    if not again.isEmpty():
        held, = fresh(docs, "__again")
        some = Bloom.of(again, h, LEVELS).flagged(docs.withColumn(hashed, own), F.col(hashed), held).filter(F.col(held)).select(*columns)
        twice = _joined(some, key, again, "left_semi")
        out = out.unionByName(twice.dropDuplicates([c for c in twice.columns if c not in columns]).select(*columns))
    return out


def _joined(rows: DataFrame, key: Callable[[DataFrame], Sequence[Column]], keys: DataFrame, how: str) -> DataFrame:
    names = fresh(rows, *(f"__k{i}" for i in range(len(keys.columns))))
    marked = rows.withColumns(dict(zip(names, key(rows))))
    right = keys.toDF(*(f"{n}r" for n in names))
    on = [marked[n].eqNullSafe(right[f"{n}r"]) for n in names]
    return marked.join(right, on, how)
