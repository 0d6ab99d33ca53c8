"""Train, validation and test splits that keep related records together (problem 2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.operators.components import connected_components
from docquarry.session import broadcast_if_small, materialise

SPLITS = ("train", "validation", "test")
#: A component with at least this share of all records is placed by weight; there are at most 1 / share of them.
HEAVY = 1 / 2000
#: Most categories for which coverage of every split is arranged.
MAX_CATEGORIES = 1000


def entity_name(c: Column) -> Column:
    """An entity's name without letter case, blanks and punctuation; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(c), r"[\s\p{Z}\p{P}\p{S}]+", ""), F.lit(""))


def entity_components(entities: DataFrame, name: str, former: str) -> DataFrame:
    """(entity, component): names tied directly or over others by a former name; component is the least name.

    Null names are left out, an unknown former name is an entity like any other, repeated rows and
    cycles of renamings change nothing. Only distinct ties are linked, so an entity that a third of all
    records share costs no more than any other.
    """
    ties = entities.select(entity_name(F.col(name)).alias("a"), entity_name(F.col(former)).alias("b"))
    links = ties.select("a", F.coalesce("b", "a").alias("b"))
    return connected_components(links, "a", "b").select(F.col("node").alias("entity"), "component")


def records_with_component(records: DataFrame, row_id: str, key: str, components: DataFrame) -> DataFrame:
    """(row_id, entity, component): component is null for a record whose key names no known entity."""
    rows = components.count()
    asked = records.select(F.col(row_id).alias("row_id"), entity_name(F.col(key)).alias("entity"))
    return asked.join(broadcast_if_small(components, rows, 200), "entity", "left")


def _place(weights: list[tuple[str, int, list[str]]], targets: dict[str, float]) -> dict[str, str]:
    """Components to splits: first one of every category to each split, then the heaviest to the split with most room."""
    room, placed = dict(targets), {}
    by_category: dict[str, list[tuple[int, str]]] = {}
    for component, n, categories in weights:
        for category in categories:
            by_category.setdefault(category, []).append((n, component))
    sizes, kinds = {c: n for c, n, _ in weights}, {c: set(k) for c, _, k in weights}

    def put(component: str, split: str) -> None:
        placed[component] = split
        room[split] -= sizes[component]

    for category, members in sorted(by_category.items(), key=lambda x: (len(x[1]), x[0])):
        for split in sorted(SPLITS, key=lambda s: targets[s]):
            if not any(placed.get(c) == split and category in kinds[c] for _, c in members):
                free = [(n, c) for n, c in sorted(members) if c not in placed]
                if free:
                    # the small splits get the heaviest component that leaves half their share of this category, else the lightest
                    share = targets[split] / sum(targets.values()) * sum(n for n, _ in members)
                    fitting = [x for x in free if x[0] <= share]
                    put((fitting[-1] if fitting else free[0])[1], split)
    for component, n, _ in sorted(weights, key=lambda x: (-x[1], x[0])):
        if component not in placed:
            put(component, max(SPLITS, key=lambda s: room[s]))
    return placed


def grouped_splits(records: DataFrame, row_id: str, group: str, category: str, shares: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 17, earlier: DataFrame | None = None) -> DataFrame:
    """(row_id, split) with all records of one group in the same split and every category in each split, where it has three groups.

    A group's hash decides by proportional ranges. Hash ranges alone can't keep the proportions where
    single groups hold a large part of the records, nor promise every category in each split; so the
    groups over HEAVY of all records (at most 1 / HEAVY) and the three with the least hash of each
    category (at most MAX_CATEGORIES) are placed first by weight, and the ranges take up what is left.
    Placement by weight looks at all groups, so a group may lie elsewhere when the data have grown;
    earlier, a frame (group, split) of placements to keep, each group once, fixes those groups first.
    A null group makes the record its own group, a null category counts for none; an empty table gives
    an empty result. Repeated rows of one group go the same way.
    """
    r = records.select(F.col(row_id).alias("row_id"), F.coalesce(F.concat(F.lit("g:"), F.col(group).cast("string")), F.concat(F.lit("r:"), F.col(row_id).cast("string"))).alias("g"), F.col(category).alias("c"))
    spot = F.xxhash64(F.col("g"), F.lit(seed))
    targets = dict.fromkeys(SPLITS, 0.0)
    if earlier is not None:
        kept = earlier.where(F.col("group").isNotNull() & F.col("split").isin(*SPLITS)).select(F.concat(F.lit("g:"), F.col("group").cast("string")).alias("g"), F.col("split").alias("kept"))
        r = materialise(r.join(kept, "g", "left"), "kept")
        for x in r.where("kept is not null").groupBy("kept").agg(F.count(F.lit(1)).alias("n")).collect():
            targets[x["kept"]] -= x["n"]
    else:
        r = r.withColumn("kept", F.lit(None).cast("string"))
    counted = materialise(r.where("kept is null").groupBy("g", "c").agg(F.count(F.lit(1)).alias("n")), "groups")
    sized = counted.groupBy("g").agg(F.sum("n").alias("n"), F.array_sort(F.collect_set("c")).alias("cs"))
    total = (counted.agg(F.sum("n")).first()[0] or 0) - sum(targets.values())
    if counted.select("c").distinct().limit(MAX_CATEGORIES + 1).count() > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories to cover")
    # the least hash three times over; each round is a map-side combined minimum per category
    reserved = None
    left = counted.where("c is not null").select("g", "c")
    for _ in range(3):
        least = left.groupBy("c").agg(F.min_by("g", F.struct(spot, "g")).alias("g"))
        reserved = least if reserved is None else reserved.unionByName(least)
        left = left.join(F.broadcast(least.select("g")), "g", "left_anti")
    chosen = sized.where(F.col("n") >= max(2.0, total * HEAVY)).select("g").unionByName(reserved.select("g")).distinct()
    weights = [(x["g"], x["n"], list(x["cs"])) for x in sized.join(F.broadcast(chosen), "g", "left_semi").collect()]
    targets = {s: share * total + targets[s] for s, share in zip(SPLITS, shares, strict=True)}
    placed = _place(sorted(weights), targets) if weights else {}
    for component, n, _ in weights:
        targets[placed[component]] -= n
    rest = [max(0.0, targets[s]) for s in SPLITS]
    rest = rest if sum(rest) else list(shares)
    edges = [sum(rest[: i + 1]) / sum(rest) for i in range(2)]
    unit = F.pmod(spot, F.lit(1 << 40)) / F.lit(float(1 << 40))
    by_range = F.when(unit < edges[0], SPLITS[0]).when(unit < edges[1], SPLITS[1]).otherwise(SPLITS[2])
    fixed = records.sparkSession.createDataFrame(list(placed.items()), "g string, fixed string")
    return r.join(F.broadcast(fixed), "g", "left").select("row_id", F.coalesce("kept", "fixed", by_range).alias("split"))
