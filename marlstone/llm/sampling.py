"""A sample with target proportions: divisor-method priorities over random ranks.

Method. Each category's records are ranked in random order; the record of rank r has
the priority ``(r - 0.5) / target``, the records within the category's minimum come
first, and the smallest priorities of all make the sample (Sainte-Lague's divisor
method). An exhausted category simply has no further priorities, so its seats go to
the others.

Ranks need no single ordered task per category: a random value cuts every category
into many ranges, counted ahead, and only the rank inside a range is a window. Which
priority is the last one drawn follows from the categories' counts alone, so nothing
is sorted globally. The driver sees one row per target category.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one range of a category has on average at most, while there are no more than MOST_RANGES.
RANGE_ROWS, MOST_RANGES = 50_000, 1 << 20


def category_key(c: Column) -> Column:
    """Categories are equal when letter case and all white space are ignored."""
    return F.lower(F.regexp_replace(c, r"(?U)\s+", ""))


def seats(counts: dict[str, int], targets: dict[str, tuple[float, int]], size: int) -> dict[str, int]:
    """Seats by category: minimum floors first (by priority, where even they exceed the size), then the smallest priorities.

    Ties are broken by category name. Priorities are compared as exact fractions.
    """
    from fractions import Fraction

    total = min(size, sum(counts.get(c, 0) for c in targets))
    floors = {c: min(counts.get(c, 0), m) for c, (_, m) in targets.items()}

    def fill(start: dict[str, int], most: dict[str, int], n: int) -> dict[str, int]:
        """Add n seats, each to the smallest next priority; a bisection over the priority, then the last few one by one."""
        weight = {c: Fraction(targets[c][0]).limit_denominator(10**9) for c in targets}
        open_ = [c for c in targets if weight[c] > 0 and most[c] > start[c]]
        got = dict(start)

        def at(p: Fraction) -> dict[str, int]:
            return {c: min(most[c], max(start[c], math.floor(p * weight[c] + Fraction(1, 2)))) for c in open_}

        lo, hi = Fraction(0), Fraction(1)
        while open_ and sum(at(hi).values()) - sum(start[c] for c in open_) < n and any(at(hi)[c] < most[c] for c in open_):
            hi *= 2
        for _ in range(80):
            mid = (lo + hi) / 2
            if sum(at(mid).values()) - sum(start[c] for c in open_) <= n:
                lo = mid
            else:
                hi = mid
        if open_:
            got |= at(lo)
        left = n - (sum(got.values()) - sum(start.values()))
        # the bisection leaves fewer seats than there are categories
        while left > 0 and (rest := [c for c in open_ if got[c] < most[c]]):
            got[min(rest, key=lambda x: (Fraction(2 * got[x] + 1, 2) / weight[x], x))] += 1
            left -= 1
        for c in sorted(targets):  # categories without a target share come last
            more = min(left, most[c] - got[c])
            got[c] += more
            left -= more
        return got

    none = dict.fromkeys(targets, 0)
    if sum(floors.values()) >= total:
        return fill(none, floors, total)
    return fill(floors, {c: counts.get(c, 0) for c in targets}, total - sum(floors.values()))


def _records(df: DataFrame, key: str, category: str) -> DataFrame:
    """(record_key, ckey): one row per record; a record given more than once keeps its least category."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("bigint").alias("record_key")).agg(F.min(category_key(F.col(category))).alias("ckey"))


class ProportionalSample:
    """The plan of a sample: who is drawn, and which targets cannot be met.

    ``targets`` has (category, target_permille, min_rows), one row per category, and is
    small (it is collected). ``share`` of the distinct keys, rounded up, is the size.
    Records with a null or unlisted category are never drawn but count towards the size.
    Null keys are no records. An empty table gives an empty sample, and every target missed
    that asks for at least one record.
    """

    def __init__(self, df: DataFrame, targets: DataFrame, *, key: str = "qa_id", category: str = "category", share: tuple[int, int] = (1, 4), seed: str = "1"):
        self.seed = seed
        self.spark = df.sparkSession
        self.records = _records(df, key, category)
        rows = targets.select("category", category_key(F.col("category")).alias("ckey"), F.col("target_permille").alias("permille"), "min_rows").collect()
        self.targets = {r["ckey"]: (r["category"], int(r["permille"]), int(r["min_rows"])) for r in rows if r["ckey"] is not None}
        listed = F.when(F.col("ckey").isin(list(self.targets)), F.col("ckey"))
        counted = self.records.groupBy(listed.alias("ckey")).agg(F.count("*").alias("n")).collect()
        self.counts = {r["ckey"]: r["n"] for r in counted if r["ckey"] is not None}
        self.size = -(-sum(r["n"] for r in counted) * share[0] // share[1])
        self.seats = seats(self.counts, {c: (p, m) for c, (_, p, m) in self.targets.items()}, self.size)

    def report(self) -> DataFrame:
        """(category, available, wanted, minimum, drawn, missed_share, missed_minimum), a row per target category.

        ``drawn`` counts the rows of the sample; where they are not as many as planned, it raises.
        """
        rows = []
        for c, (name, permille, least) in sorted(self.targets.items()):
            n, wanted = self.counts.get(c, 0), -(-permille * self.size // 1000)
            rows.append((name, n, wanted, least, self.seats.get(c, 0), n < wanted, n < least))
        plan = self.spark.createDataFrame(rows, "category string, available bigint, wanted bigint, minimum bigint, seats bigint, short_share boolean, short_minimum boolean")
        drawn = self.rows().groupBy("category").agg(F.count("*").alias("n"))
        r = plan.join(drawn, "category", "left").withColumn("drawn", F.coalesce("n", F.lit(0)))
        as_planned = F.col("drawn") == F.col("seats")
        said = F.concat(F.lit("rows drawn and planned differ in "), "category")

        def checked(c: str) -> Column:
            return F.when(as_planned, F.col(c)).otherwise(F.raise_error(said).cast("boolean"))

        return r.select("category", "available", "wanted", "minimum", "drawn", checked("short_share").alias("missed_share"), checked("short_minimum").alias("missed_minimum"))

    def missed(self) -> DataFrame:
        """(category, missed): one row per category and miss."""
        kinds = F.array(F.when(F.col("missed_share"), F.lit("share")), F.when(F.col("missed_minimum"), F.lit("minimum")))
        return self.report().select("category", F.explode(F.array_compact(kinds)).alias("missed"))

    def rows(self) -> DataFrame:
        """(record_key, category, rank, priority): the records drawn."""
        quota = self.spark.createDataFrame([(c, name, p, m, self.seats.get(c, 0)) for c, (name, p, m) in self.targets.items()], "ckey string, category string, permille bigint, min_rows bigint, seats bigint")
        draw = F.md5(F.concat(F.lit(self.seed + "|"), F.col("record_key").cast("string")))
        drawn = self.records.join(F.broadcast(quota), "ckey").withColumn("draw", draw)  # a row per target
        # the first hexadecimal digits of the random value name its range
        ranges = min(MOST_RANGES, 1 + max(self.counts.values(), default=0) // RANGE_ROWS)
        ranged = drawn.withColumn("range", F.floor(F.conv(F.substring("draw", 1, 6), 16, 10).cast("bigint") * ranges / F.lit(1 << 24)).cast("int"))
        sizes = ranged.groupBy("ckey", "range").agg(F.count("*").alias("n"))
        before = sizes.select("ckey", "range", (F.sum("n").over(Window.partitionBy("ckey").orderBy("range")) - F.col("n")).alias("before"))  # a row per category and range
        ranked = (
            ranged.join(before, ["ckey", "range"])
            .where(F.col("before") < F.col("seats"))
            .withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("ckey", "range").orderBy("draw", "record_key")))
            .where(F.col("rank") <= F.col("seats"))
        )
        return ranked.select("record_key", "category", "rank", F.when(F.col("permille") > 0, F.round((F.col("rank") - F.lit(0.5)) / F.col("permille"), 6)).alias("priority"))
