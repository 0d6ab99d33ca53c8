"""Filling fixed-capacity containers with texts (problem 6)."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.tokens import TOKENIZER, token_count
from docquarry.session import materialise

#: Largest capacity for which recipes are made: it bounds the sizes that are counted.
MAX_CAPACITY = 1 << 20
#: Records of one size are numbered in parts, each by one task; there are as many as keep a part of a size that all records share under this.
PART_ROWS = 100_000


def recipes(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins by recipe: (number of bins, [(size, items of that size in each bin)]).

    Sizes go from large to small. A size belongs to the harmonic class j = capacity // size, and each
    bin of the class gets a fixed number of its items, j; the room that stays is topped up with the
    largest sizes that fit, a fixed number each, so that all bins of a recipe are alike. A recipe is
    used as often as every size in it lasts; a smaller recipe takes what is left of them.
    """
    left = dict(counts)
    sizes = sorted(left)
    out: list[tuple[int, list[tuple[int, int]]]] = []
    while sizes:
        room, recipe = capacity, []
        at = len(sizes) - 1
        while at >= 0:
            size = sizes[at]
            n = min(room // size, left[size])
            if n:
                recipe.append((size, n))
                room -= n * size
            at = min(at, bisect.bisect_right(sizes, room)) - 1
        bins = min(left[size] // n for size, n in recipe)
        out.append((bins, recipe))
        for size, n in recipe:
            left[size] -= bins * n
            if not left[size]:
                del left[size]
                sizes.pop(bisect.bisect_left(sizes, size))
    return out


def pack(df: DataFrame, row_id: str, text: str, specs: DataFrame, spec_id: str, capacity: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(spec_id, row_id, piece, token_start, token_end, class, container): every text in containers of every spec.

    class is the reciprocal class of a piece, how many of its size a container holds; null for no tokens.

    Containers of a spec are numbered from 0. A text over the capacity is split into pieces of exactly
    the capacity, each a container of its own, and a rest that is packed like any other text; no other
    text is split. Texts of no tokens (null, empty) take no room: one row, container null. Repeated
    rows are packed as often as they come; a spec without a positive capacity packs nothing; empty
    tables give an empty result; other columns aren't read.

    Items of one size are alike, and sizes are whole tokens within the capacity. So the plan needs the
    number of items per size only (at most capacity rows a spec, whatever the number of texts), and
    says for each size which of its items, by number, go to which container. Items are numbered within
    their size in parts by hash, so a size that a third of all texts share is no single task.
    """
    spark = df.sparkSession
    wanted = [(x["spec_id"], x["capacity"]) for x in specs.select(F.col(spec_id).alias("spec_id"), F.col(capacity).cast("long").alias("capacity")).where("spec_id is not null and capacity > 0").distinct().limit(1001).collect()]
    if len(wanted) > 1000 or any(c > MAX_CAPACITY for _, c in wanted):
        raise ValueError(f"at most 1000 containers of at most {MAX_CAPACITY} tokens can be planned")
    sized = materialise(df.select(F.col(row_id).alias("row_id"), token_count(F.col(text), tokenizer).alias("n")), "sizes")
    kinds = F.array(*(F.struct(F.lit(s).alias("spec_id"), F.lit(c).cast("long").alias("capacity")) for s, c in wanted)) if wanted else F.array().cast("array<struct<spec_id:int,capacity:bigint>>")
    each = sized.select("row_id", "n", F.explode(kinds).alias("k")).select("row_id", "n", "k.*")
    parts = F.greatest(F.ceil(F.col("n") / F.col("capacity")), F.lit(1))
    items = each.withColumn("piece", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))).withColumn("token_start", F.col("piece") * F.col("capacity"))
    items = items.withColumn("token_end", F.least("n", F.col("token_start") + F.col("capacity"))).withColumn("size", F.col("token_end") - F.col("token_start"))
    items = items.withColumn("class", F.when(F.col("size") > 0, F.floor(F.col("capacity") / F.col("size"))))
    part = F.pmod(F.xxhash64("row_id", "piece"), F.lit(-(-sized.count() // PART_ROWS) or 1)).cast("int")
    items = items.withColumn("part", part).select("spec_id", "size", "part", "row_id", "piece", "token_start", "token_end", "class")
    counted = materialise(items.groupBy("spec_id", "size", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram: dict[int, dict[int, int]] = {}
    for x in counted.where("size > 0").groupBy("spec_id", "size").agg(F.sum("n").alias("n")).collect():
        histogram.setdefault(x["spec_id"], {})[x["size"]] = x["n"]
    plan, capacities = [], dict(wanted)
    for spec, counts in sorted(histogram.items()):
        bin_, seen = 0, dict.fromkeys(counts, 0)
        for bins, recipe in recipes(counts, capacities[spec]):
            for size, n in recipe:
                plan.append((spec, size, seen[size], seen[size] + bins * n, n, bin_))
                seen[size] += bins * n
            bin_ += bins
    slots = spark.createDataFrame(plan, "spec_id int, size long, low long, high long, each_bin long, first_bin long")
    order = Window.partitionBy("spec_id", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    # each part gets the slots that its numbers fall into: no more of them than it has items, and one
    near = before.join(slots, ["spec_id", "size"], "left").where("size = 0 or (low < before + n and high > before)")
    near = near.groupBy("spec_id", "size", "part", "before").agg(F.array_sort(F.collect_list(F.struct("low", "high", "each_bin", "first_bin"))).alias("slots"))
    numbered = items.withColumn("number", F.row_number().over(Window.partitionBy("spec_id", "size", "part").orderBy("row_id", "piece")) - 1)
    placed = numbered.join(near, ["spec_id", "size", "part"]).withColumn("number", F.col("number") + F.col("before"))
    slot = F.get(F.filter("slots", lambda s: (s["low"] <= F.col("number")) & (F.col("number") < s["high"])), F.lit(0))
    placed = placed.withColumn("slot", slot).withColumn("container", (F.col("slot.first_bin") + F.floor((F.col("number") - F.col("slot.low")) / F.col("slot.each_bin"))).cast("long"))
    return placed.select("spec_id", "row_id", "piece", "token_start", "token_end", "class", "container")


def fill_report(packed: DataFrame, specs: DataFrame, spec_id: str, capacity: str) -> DataFrame:
    """(spec_id, containers, tokens, fill, class_containers, class_fill): how full the containers of each spec are, and how full they would be if each held only pieces of one class, a fixed number each."""
    size = F.col("token_end") - F.col("token_start")
    classes = packed.groupBy("spec_id", "class").agg(F.max("container").alias("last"), F.sum(size).alias("tokens"), F.when(F.col("class") > 0, F.ceil(F.count(F.lit(1)) / F.col("class"))).alias("own"))
    totals = classes.groupBy("spec_id").agg(F.coalesce(F.max("last") + 1, F.lit(0)).alias("containers"), F.sum("tokens").alias("tokens"), F.coalesce(F.sum("own"), F.lit(0)).alias("class_containers"))
    room = lambda c: F.col("tokens") / (F.col(c) * F.col("capacity"))
    joined = totals.join(specs.select(F.col(spec_id).alias("spec_id"), F.col(capacity).alias("capacity")), "spec_id")
    return joined.select("spec_id", "containers", "tokens", room("containers").alias("fill"), "class_containers", room("class_containers").alias("class_fill"))
