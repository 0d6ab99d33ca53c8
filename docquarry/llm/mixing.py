"""Mixing sources to target shares (problem 7)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.tokens import TOKENIZER, token_count
from docquarry.session import materialise

#: Records rounded in one task of the first level, and residuals combined in one of each further level.
BUCKET_ROWS = 20_000
FAN_IN = 256
#: Most targets: they are planned on the driver.
MAX_TARGETS = 10_000


def source_name(c: Column) -> Column:
    """A source's name without letter case and outer blanks, blanks and underscores as hyphens; null for none."""
    return F.nullif(F.regexp_replace(F.trim(F.lower(F.regexp_replace(c, r"[\s\p{Z}]+", " "))), "[ _-]+", "-"), F.lit(""))


def allot(held: dict[str, int], share: dict[str, float], repeats: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Tokens of each source: its share of the total, no more than it holds times its repeats.

    What a source can't supply is shared by the others in proportion to their targets, so that the
    total is met if it can be. The default total is what the targeted sources hold.
    """
    most = {s: held.get(s, 0) * max(0, repeats[s]) for s in share}
    total = float(sum(held.get(s, 0) for s in share)) if total is None else float(total)
    given, open_ = dict.fromkeys(share, 0.0), {s for s in share if share[s] > 0 and most[s] > 0}
    left = total
    while open_ and left > 1e-9:
        weight = sum(share[s] for s in open_)
        full = {s for s in open_ if most[s] <= left * share[s] / weight}
        for s in full or open_:
            given[s] = float(most[s]) if full else left * share[s] / weight
        if not full:
            break
        left -= sum(most[s] for s in full)
        open_ -= full
    return given


def pivotal(chance: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Chances moved to 0 or 1 but for at most one; the sum of size times chance stays, and each expectation too.

    Two fractional records at a time: weight goes from one to the other, or back, by a draw that keeps
    both expectations, until one of them is integral.
    """
    p = chance.tolist()
    w = size.tolist()
    draws = rng.random(len(p)).tolist()
    k = None
    for i, x in enumerate(p):
        if not 1e-12 < x < 1 - 1e-12:
            p[i] = round(x)
            continue
        if k is None:
            k = i
            continue
        up = min((1 - p[k]) * w[k], p[i] * w[i])  # to k from i
        down = min(p[k] * w[k], (1 - p[i]) * w[i])  # from k to i
        move = up if draws[i] * (up + down) < down else -down
        p[k] += move / w[k]
        p[i] -= move / w[i]
        done_k = not 1e-12 < p[k] < 1 - 1e-12
        done_i = not 1e-12 < p[i] < 1 - 1e-12
        if done_k:
            p[k] = round(p[k])
        if done_i:
            p[i] = round(p[i])
        k = None if done_k and done_i else i if done_k else k
    return np.array(p)


def _round(seed: int, last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row_key", kind="stable")
        rng = np.random.default_rng([seed, *np.frombuffer(repr(tuple(map(str, key))).encode(), np.uint8).tolist()])
        p = pivotal(rows["chance"].to_numpy(), rows["n"].to_numpy().astype(float), rng)
        if last:
            p = np.where((p > 0) & (p < 1), (rng.random(p.size) < p).astype(float), p)
        return rows.assign(chance=p)

    return run


def mix_sources(df: DataFrame, row_id: str, source: str, text: str, targets: DataFrame, target_source: str, target_share: str, max_repeats: str, total: float | None = None, tokenizer: str = TOKENIZER, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(uses, shares): how often each record is used, and what share each source really reaches.

    uses has (row_id, source, n, copies) for every record, n in tokens, copies 0 to the source's most
    repeats; shares has (source, target_share, held, used, records, actual_share), one row for each
    target and for each source without one (target null, unused). A record without a source, of a
    source without target, or of no tokens has 0 copies. Targets of one name, spelled alike, are added
    up, the least of their repeats holds; null shares and repeats count as 0. Repeated rows are
    records of their own; empty tables give no uses, and shares of 0; other columns aren't read.

    Every record of a source gets the same expected copies: whole ones, and a chance of one more. The
    chances are rounded by pivotal sampling in buckets of bounded size, weighted by tokens; what each
    bucket leaves unresolved, at most one record, is combined in a tree of further rounds, so each
    source misses its tokens by less than its largest record.
    """
    listed = targets.select(source_name(F.col(target_source)).alias("source"), F.coalesce(F.col(target_share), F.lit(0.0)).cast("double").alias("share"), F.coalesce(F.col(max_repeats), F.lit(0)).cast("int").alias("repeats")).where("source is not null").groupBy("source").agg(F.sum("share").alias("share"), F.min("repeats").alias("repeats")).limit(MAX_TARGETS + 1).collect()
    if len(listed) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    share, repeats = {x["source"]: x["share"] for x in listed}, {x["source"]: x["repeats"] for x in listed}
    spark = df.sparkSession
    sized = materialise(df.select(F.col(row_id).alias("row_id"), source_name(F.col(source)).alias("source"), token_count(F.col(text), tokenizer).alias("n")), "sizes")
    names = F.broadcast(spark.createDataFrame([(s,) for s in share], "source string"))
    sums = sized.where("n > 0").join(names, "source").groupBy("source").agg(F.sum("n").alias("held"), F.count(F.lit(1)).alias("rows")).collect()  # one row a target
    held, counted = {x["source"]: x["held"] for x in sums}, {x["source"]: x["rows"] for x in sums}
    given = allot(held, share, repeats, total)
    plan = [(s, math.floor(given[s] / held[s] + 1e-12), max(0.0, given[s] / held[s] - math.floor(given[s] / held[s] + 1e-12)), math.ceil(counted[s] / BUCKET_ROWS)) for s in held]
    levels = max([1, *(1 + math.ceil(math.log(b, FAN_IN)) for *_, b in plan if b > 1)])
    rated = sized.join(F.broadcast(spark.createDataFrame(plan, "source string, whole int, chance double, buckets int")), "source", "left")
    # a repeated row is told apart by its number among equal ids, so that each is rounded once
    live = rated.where("n > 0 and chance > 0").select("row_id", "source", "n", "chance", F.pmod(F.xxhash64("row_id", "n"), F.col("buckets").cast("long")).alias("bucket"))
    live = live.withColumn("row_key", F.concat_ws(":", F.col("row_id").cast("string"), F.monotonically_increasing_id().cast("string")))
    schema = f"row_id {dict(df.select(F.col(row_id).alias('x')).dtypes)['x']}, source string, n bigint, chance double, bucket bigint, row_key string"
    settled, open_ = None, live
    for level in range(levels):
        done = materialise(open_.groupBy("source", "bucket").applyInPandas(_round(seed + level, level == levels - 1), schema), "rounded")
        part = done.where("chance = 0 or chance = 1").select("row_id", "source", "n", "chance")
        settled = part if settled is None else settled.unionByName(part)
        open_ = done.where("chance > 0 and chance < 1").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
    extra = settled.join(F.broadcast(spark.createDataFrame([(s, w) for s, w, *_ in plan], "source string, whole int")), "source").select("row_id", "source", "n", (F.col("whole") + F.col("chance")).cast("int").alias("copies"))
    rest = rated.where("not (n > 0 and coalesce(chance, 0) > 0)").select("row_id", "source", "n", F.when(F.col("n") > 0, F.coalesce("whole", F.lit(0))).otherwise(0).cast("int").alias("copies"))
    uses = materialise(extra.unionByName(rest), "uses")
    wanted = spark.createDataFrame([(s, share[s]) for s in share], "source string, target_share double")
    reached = uses.groupBy("source").agg(F.sum("n").alias("held"), F.sum(F.col("n") * F.col("copies")).alias("used"), F.sum("copies").alias("records"))
    whole = uses.agg(F.sum(F.col("n") * F.col("copies")).alias("whole"))
    both = wanted.join(reached, wanted.source.eqNullSafe(reached.source), "full").select(F.coalesce(wanted.source, reached.source).alias("source"), "target_share", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("held", "used", "records")))
    shares = both.join(F.broadcast(whole), F.lit(True), "cross").select("source", "target_share", "held", "used", "records", F.coalesce(F.col("used") / F.nullif("whole", F.lit(0)), F.lit(0.0)).alias("actual_share"))
    return uses, shares
