"""A table on the shared folder that grows by batches and is read by key.

A batch becomes a segment: a folder whose parts hold the rows by the leading bits of
their key's hash, with so many bits that a part has about ``part_rows`` rows. A lookup
opens the parts of the keys asked for and no others, so what it reads is bounded by the
keys, however large the table is. When ``fan_in`` segments of a tier have come together
they are merged into one of the next tier: the number of segments stays logarithmic, and
a row is copied once a tier. Hot keys do no harm: where a part is much larger than the
others, adaptive execution writes it as several files.

Which segments make up the table is written to a manifest (see ``History``); what no
manifest names does not exist.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.session import delete, names

PART_ROWS, FAN_IN = 1 << 18, 8


@dataclass(frozen=True)
class Segment:
    """``parts`` lists the parts that have rows, of ``2 ** bits`` possible ones."""

    name: str
    bits: int
    rows: int
    tier: int
    parts: tuple[int, ...]

    def plain(self) -> dict:
        return asdict(self)


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """An empty table that costs no task."""
    return spark.range(0).select(F.from_json(F.lit("{}"), schema).alias("r")).select("r.*")


def _part(key: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits) if bits else F.lit(0).cast("bigint")


class Parted:
    """Rows of ``schema`` at ``path``, found by their column ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, part_rows: int = PART_ROWS, fan_in: int = FAN_IN):
        self.spark, self.path, self.schema, self.key, self.part_rows, self.fan_in = spark, path, schema, key, part_rows, fan_in

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return no_rows(self.spark, self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(*paths)

    def lookup(self, keys: DataFrame, segments: list[Segment]) -> DataFrame:
        """All rows of ``keys`` (a column named as the key, repeats allowed), among others of the same parts."""
        bits = max((s.bits for s in segments), default=0)
        asked = None
        if bits:
            asked = [r[0] for r in keys.select(_part(self.key, bits)).distinct().collect()]  # numbers of parts, not keys
        paths = []
        for s in segments:
            root = f"{self.path}/{s.name}"
            if asked is None:
                paths.append(root)
                continue
            wanted = {a >> (bits - s.bits) for a in asked}
            found = [p for p in s.parts if p in wanted]
            paths += [root] if len(found) == len(s.parts) and found else [f"{root}/part={p}" for p in found]
        return self._read(paths)

    def write(self, rows: DataFrame, about: int, tier: int = 0) -> Segment:
        """A new segment of about so many rows; it counts once a manifest names it."""
        bits = max(0, (about // self.part_rows).bit_length())
        name = uuid.uuid4().hex
        root = f"{self.path}/{name}"
        placed = rows.withColumn("part", _part(self.key, bits))
        # a single part is one file; more of them are spread, the large ones over several tasks
        (placed.hint("rebalance", "part") if bits else placed.coalesce(1)).write.partitionBy("part").parquet(root)
        parts = sorted(int(n.removeprefix("part=")) for n in names(self.spark, root) if n.startswith("part="))
        return Segment(name, bits, about, tier, tuple(parts))

    def merged(self, segments: list[Segment]) -> list[Segment]:
        """The segments after merging all tiers that are full."""
        out = [s for s in segments if s.parts]
        tier = 0
        while tier <= max((s.tier for s in out), default=-1):
            full = [s for s in out if s.tier == tier]
            if len(full) >= self.fan_in:
                one = self.write(self._read([f"{self.path}/{s.name}" for s in full]), sum(s.rows for s in full), tier + 1)
                out = [s for s in out if s.tier != tier] + [one]
            tier += 1
        return out

    def forget(self, kept: list[Segment]) -> None:
        """Delete the segments that are not among ``kept``: merged ones, and those of attempts that failed."""
        have = {s.name for s in kept}
        for n in names(self.spark, self.path):
            if n not in have:
                delete(self.spark, f"{self.path}/{n}")
