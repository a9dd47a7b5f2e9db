"""Variable-capacity best-fit packing of items into containers.

Items are whole numbers no larger than the largest permitted capacity, so a
packing is a function of the histogram of sizes alone.  The driver gets only
that histogram (at most one entry for each possible size, whatever the number of
items), packs equal items together by best fit in falling order, opens the bin
size that a look ahead over the remaining sizes finds to waste the least share,
and finally gives every bin the smallest permitted capacity that holds its
contents.  The result is a short list of bin patterns.  Executors then rank the
items of each size and look up the place of each rank in that list.

Ranks need no gathering of a size, which may be that of a third of all items:
items are spread over salts, counted for each salt, ranked within salt and size,
and shifted by the running count of the salts before.

Defined results: an item above the largest permitted capacity is cut into pieces
of that capacity and a rest; no other item is cut.  An item of size 0 comes out
with null ``bin_id``.  Null sizes count as 0.  Repeated rows are items of their own.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.session import checkpointed

#: Rows of one size that one task ranks, about.
RANKED_AT_ONCE = 500_000
#: Entries of the list of patterns up to which it is broadcast.
BROADCAST_SLOTS = 200_000


def _waste(capacity: int, size: int, count: int, rest: list[tuple[int, int]]) -> float:
    """The share of a bin left unused if it is filled from ``size`` downwards."""
    left = capacity - size * min(count, capacity // size)
    for s, n in rest:
        if left <= 0:
            break
        if s <= left:
            left -= s * min(n, left // s)
    return left / capacity


def plan_bins(histogram: dict[int, int], capacities: list[int]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Patterns ``(capacity, bins, [(size, items in each bin), ...])`` that hold all items."""
    caps = sorted(set(capacities))
    groups: list[list] = []  # [opened capacity, bins, contents]
    at: dict[int, list[int]] = {}  # groups by what is left in their bins
    lefts: list[int] = []
    sizes = sorted(((s, n) for s, n in histogram.items() if s > 0 and n > 0), reverse=True)

    def put(group: int, left: int) -> None:
        if left not in at:
            at[left] = []
            insort(lefts, left)
        at[left].append(group)

    for i, (size, n) in enumerate(sizes):
        while n:
            j = bisect_left(lefts, size)
            if j == len(lefts):  # no open bin holds it
                fits = [c for c in caps if c >= size]
                cap = min(fits, key=lambda c: (_waste(c, size, n, sizes[i + 1 :]), -c)) if len(fits) > 1 else fits[0]
                k = min(n, cap // size)
                m = n // k
                groups.append([cap, m, [(size, k)]])
                put(len(groups) - 1, cap - k * size)
            else:  # the fullest bin that holds it
                left = lefts[j]
                g = at[left].pop()
                if not at[left]:
                    del at[left]
                    lefts.pop(j)
                k = min(n, left // size)
                m = min(groups[g][1], n // k)
                if m < groups[g][1]:
                    groups[g][1] -= m
                    put(g, left)
                    groups.append([groups[g][0], m, [*groups[g][2], (size, k)]])
                    g = len(groups) - 1
                else:
                    groups[g][2].append((size, k))
                put(g, left - k * size)
            n -= k * m
    out = []
    for _, m, content in groups:
        used = sum(s * k for s, k in content)
        out.append((next(c for c in caps if c >= used), m, content))
    return out


def _slots(spark: SparkSession, histogram: DataFrame, plans: dict[str, list[int]]) -> tuple[DataFrame, int, dict[str, int]]:
    counts: dict[str, dict[int, int]] = {p: {} for p in plans}
    for r in histogram.collect():  # bounded by the capacities, not by the items
        counts[r["plan"]][r["n_tokens"]] = r["n"]
    places: dict[tuple[str, int], list[tuple[int, int, int, int]]] = {}
    for plan, caps in plans.items():
        rank: dict[int, int] = {}
        base = 0
        for cap, m, content in plan_bins(counts[plan], caps):
            for size, k in content:
                first = rank.get(size, 0)
                places.setdefault((plan, size), []).append((first, k, base, cap))
                rank[size] = first + k * m
            base += m
    rows = [(p, s, v) for (p, s), v in places.items()]
    schema = "plan string, n_tokens int, places array<struct<first:bigint, k:int, base:bigint, capacity:int>>"
    return spark.createDataFrame(rows, schema), sum(len(v) for _, _, v in rows), {p: max(c.values(), default=0) for p, c in counts.items()}


def pack(items: DataFrame, id_col: str, size_col: str, plans: dict[str, list[int]]) -> DataFrame:
    """Every piece of every item for each plan (a name and its permitted capacities).

    Columns: ``plan, id_col, piece_no, first_token, n_tokens, bin_id,
    capacity_tokens``.  Bins are numbered from 0 within a plan.
    """
    spark = items.sparkSession
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("bigint")
    pieces = (
        items.select(id_col, size.alias("_size"))
        .select(id_col, "_size", F.explode(F.array(*[F.struct(F.lit(p).alias("plan"), F.lit(max(c)).alias("_max")) for p, c in plans.items()])).alias("_p"))
        .select("_p.plan", "_p._max", id_col, "_size", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("_size") / F.col("_p._max")).cast("int") - 1))).alias("piece_no"))
        .select("plan", id_col, "piece_no", (F.col("piece_no").cast("bigint") * F.col("_max")).alias("first_token"), F.least(F.col("_max").cast("bigint"), F.col("_size") - F.col("piece_no").cast("bigint") * F.col("_max")).cast("int").alias("n_tokens"))
    )
    pieces = checkpointed(pieces)  # sizes cost Python; the histogram and the placing both read them
    held = pieces.where("n_tokens > 0")
    histogram = held.groupBy("plan", "n_tokens").agg(F.count("*").alias("n"))
    slots, n_slots, hottest = _slots(spark, histogram, plans)
    if n_slots <= BROADCAST_SLOTS:
        slots = F.broadcast(slots)
    salts = max(1, -(-max(hottest.values(), default=0) // RANKED_AT_ONCE))
    salted = held.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece_no"), F.lit(salts)).cast("int"))
    within = Window.partitionBy("plan", "n_tokens", "_salt").orderBy(id_col, "piece_no")
    ranked = salted.withColumn("_rank", F.row_number().over(within).cast("bigint") - 1)
    if salts > 1:
        before = Window.partitionBy("plan", "n_tokens").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
        shift = salted.groupBy("plan", "n_tokens", "_salt").agg(F.count("*").alias("_n"))
        shift = shift.select("plan", "n_tokens", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
        ranked = ranked.join(shift, ["plan", "n_tokens", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_shift"))
    placed = ranked.join(slots, ["plan", "n_tokens"])
    place = F.element_at(F.filter("places", lambda x: x["first"] <= F.col("_rank")), -1)
    placed = placed.withColumn("_at", place).select(
        "plan", id_col, "piece_no", "first_token", "n_tokens",
        (F.col("_at.base") + F.floor((F.col("_rank") - F.col("_at.first")) / F.col("_at.k"))).cast("bigint").alias("bin_id"),
        F.col("_at.capacity").alias("capacity_tokens"),
    )
    empty = pieces.where("n_tokens = 0").withColumns({"bin_id": F.lit(None).cast("bigint"), "capacity_tokens": F.lit(None).cast("int")})
    return placed.unionByName(empty)


def fill_report(packed: DataFrame) -> DataFrame:
    """Bins, tokens and unused tokens of each plan and capacity."""
    bins = packed.where("bin_id is not null").groupBy("plan", "bin_id").agg(F.max("capacity_tokens").alias("capacity_tokens"), F.sum("n_tokens").alias("used"))
    return bins.groupBy("plan", "capacity_tokens").agg(
        F.count("*").alias("n_bins"), F.sum("used").alias("tokens"), F.sum(F.col("capacity_tokens") - F.col("used")).alias("unused"), F.max(F.col("used") - F.col("capacity_tokens")).alias("overflow")
    )
