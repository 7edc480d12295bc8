"""Percentiles per group from dyadic Count-sketches: mergeable by addition, with deletions and a bounded error."""

from __future__ import annotations

import random
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1


@dataclass(frozen=True)
class Shape:
    """bits: leading binary digits kept of a value, so a decoded value is off by at most 2**-bits of itself (values up to 2**(bits+1) are exact).
    width, depth: counters in a row and rows of a level's Count-sketch. A level with at most width nodes is counted exactly in one row.

    The universe is the codes below 2**levels. A rank's error is at most about levels * sqrt(F2 / width) for the squared counts F2 of a
    group's codes on a level, with a probability of failure that falls exponentially with depth.
    """

    bits: int = 11
    width: int = 1024
    depth: int = 5
    seed: int = 7
    levels: int = field(init=False)

    def __post_init__(self):
        # 64 exponents of 2**bits codes each, for either sign
        object.__setattr__(self, "levels", self.bits + 7)

    def sketched(self) -> list[int]:
        return [lv for lv in range(self.levels) if 1 << (self.levels - lv) > self.width]

    def hashes(self) -> dict[tuple[int, int], tuple[int, int, int, int]]:
        """Multipliers and offsets of the bucket and sign hashes of each sketched level and row."""
        draw = random.Random(self.seed)
        return {(lv, r): tuple(draw.randrange(1, PRIME) for _ in range(4)) for lv in self.sketched() for r in range(self.depth)}


def encode(value: Column, shape: Shape) -> Column:
    """Order-preserving code of a whole number."""
    size = F.least(F.abs(value), F.lit((1 << 62) - 1))
    shift = F.greatest(F.length(F.bin(size)) - 1 - shape.bits, F.lit(0))
    code = shift.cast("long") * (1 << shape.bits) + F.call_function("shiftright", size, shift)
    half = 1 << (shape.levels - 1)
    return F.when(value < 0, half - 1 - code).otherwise(half + code)


def decode(code: int, shape: Shape) -> int:
    """The middle of the values with this code."""
    half = 1 << (shape.levels - 1)
    c = half - 1 - code if code < half else code - half
    shift = max(0, (c >> shape.bits) - 1)
    size = ((c - (shift << shape.bits)) << shift) + ((1 << shift) >> 1)
    return -size if code < half else size


def _packed(counters: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(counters, np.int64).tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.int64)


def slots(nodes: np.ndarray, numbers: tuple[int, int, int, int], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of nodes in the row with these multipliers and offsets."""
    a, b, c, e = numbers
    return (a * nodes + b) % PRIME % shape.width, 1 - 2 * ((c * nodes + e) % PRIME % 2)


def sketch(df: DataFrame, keys: list[str], value: str, shape: Shape = Shape(), weight: str | None = None) -> DataFrame:
    """One sketch per value of keys: rows (keys, level, sign, counters), all counters of a level packed in one value; sign -1 takes them away.

    weight: a whole-number column, negative for deletions; every row counts 1 without it. Null values (or weights) add nothing; a null in a key
    is a group of its own; further columns are not read. Frequencies of codes are summed first, so a task gets at most a group's codes, which the
    universe bounds at 2**levels, and what is shuffled are sums and packed counters. An empty table gives no sketch.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    counts = (
        df.where(F.col(value).isNotNull())
        .select(*keys, encode(F.col(value).cast("long"), shape).alias("_code"), w.cast("long").alias("_w"))
        .groupBy(*keys, "_code")
        .agg(F.sum("_w").alias("_w"))
        .where("_w <> 0")
    )
    hashes, sketched, levels = shape.hashes(), set(shape.sketched()), shape.levels
    schema = df.select(*keys).schema.add("level", "integer").add("sign", "integer").add("counters", "binary")

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        codes, weights = pdf["_code"].to_numpy(np.int64), pdf["_w"].to_numpy(np.int64)
        out = []
        for level in range(levels + 1):
            nodes = codes >> level
            if level in sketched:
                rows = np.zeros((shape.depth, shape.width), np.int64)
                for r in range(shape.depth):
                    at, sign = slots(nodes, hashes[level, r], shape)
                    np.add.at(rows[r], at, sign * weights)
            else:
                rows = np.zeros(1 << (levels - level), np.int64)
                np.add.at(rows, nodes, weights)
            out.append((*key, level, 1, _packed(rows)))
        return pd.DataFrame(out, columns=[*keys, "level", "sign", "counters"])

    # The sums are small, but each group is work: with the number given, adaptive execution doesn't put them all into one task.
    spread = counts.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    return spread.groupBy(*keys).applyInPandas(build, schema)


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of the same shape added up to those of the coarser keys: of days, partitions, or of insertions and deletions.

    A group is a level of one key's sketches: as many rows as sketches are added, each of at most depth * width counters.
    """
    schema = sketches.select(*keys).schema.add("level", "integer").add("sign", "integer").add("counters", "binary")

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = 0
        for sign, packed in zip(pdf["sign"], pdf["counters"]):
            total = total + sign * _unpacked(packed)
        return pd.DataFrame([(*key, 1, _packed(total))], columns=[*keys, "level", "sign", "counters"])

    return sketches.select(*keys, "level", "sign", "counters").groupBy(*keys, "level").applyInPandas(add, schema)


def negate(sketches: DataFrame) -> DataFrame:
    """What has to be added to take these rows away again."""
    return sketches.withColumn("sign", -F.col("sign"))


def percentiles(sketches: DataFrame, keys: list[str], shares: list[float], shape: Shape = Shape()) -> DataFrame:
    """Rows (keys, share, n, estimate): the value whose rank is about ceil(share * n), found by descending from the root to a leaf.

    sketches hold one sketch per key (merge). A group without values has no row. A group is one sketch, whatever its rows.
    """
    hashes, top, sketched = shape.hashes(), shape.levels, set(shape.sketched())
    schema = sketches.select(*keys).schema.add("share", "double").add("n", "long").add("estimate", "double")

    def descend(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tables = {level: sign * _unpacked(packed) for level, sign, packed in zip(pdf["level"], pdf["sign"], pdf["counters"])}

        def count(level: int, node: int) -> int:
            if level not in sketched:
                return int(tables[level][node])
            rows = tables[level].reshape(shape.depth, shape.width)
            found = []
            for r in range(shape.depth):
                at, sign = slots(np.int64(node), hashes[level, r], shape)
                found.append(int(sign) * int(rows[r, at]))
            return int(np.median(found))

        n, out = count(top, 0), []
        for share in shares if n > 0 else []:
            rank, node, inside = max(1, int(np.ceil(round(share * n, 6)))), 0, n
            for level in range(top - 1, -1, -1):
                left = min(max(count(level, 2 * node), 0), inside)
                if rank <= left:
                    node, inside = 2 * node, left
                else:
                    node, inside, rank = 2 * node + 1, inside - left, rank - left
            out.append((*key, share, n, float(decode(node, shape))))
        return pd.DataFrame(out, columns=[*keys, "share", "n", "estimate"])

    return sketches.groupBy(*keys).applyInPandas(descend, schema)
