"""Splits that keep related records together: hash-to-min components, then weighted rendezvous hashing.

Components: the state is a table of pairs (node, member of its cluster), never an array, so that a component that holds a
third of all nodes is spread like any other rows. Each round every node sends its cluster to the smallest member and the
smallest member to its cluster, until nothing changes; the number of rounds grows with the logarithm of the largest
distance. Each round is checkpointed.

Assignment: every component draws, for each split, a number from a hash of its name and a fixed seed; the split with the
smallest -ln(u) / weight takes it. The weights are the shares, times factors that balance the strata: each round adds up
what every stratum has in every split and raises the factors of what it lacks; a component uses, of each kind of strata
(all records, species), the mean of its strata's factors. The draws never change, so that a round moves only components near the margin. ``rounds=0`` is the plain hash:
no component ever moves, and the shares deviate by chance. With ``previous``, a table of records and their splits, every
component that holds one of them keeps its split (that of its smallest such record), and the factors place the others
only: with it no record moves when others come, and what comes makes up for what is out of balance.

Defined results: null keys tie nothing; a node without ties is its own component; ties to absent nodes are left out by the
caller's join; repeated edges count once; strata without weight count for nothing; records of ``previous`` that are no
more, or whose split is unknown, are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeframe.session import broadcast_if_small, checkpointed

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
SEED = 0
#: Rounds in which the factors are fitted, and how far the first goes (1: by the whole ratio of what is wanted to what is
#: there); the others go less and less far, by the root of their number, since all strata move at once.
ROUNDS, PACE = 10, 0.4


def code_key(code: Column) -> Column:
    """Letters in upper case and number without leading zeros; null for text without a number."""
    digits = F.regexp_replace(F.regexp_extract(code, "([0-9]+)", 1), "^0+(?=.)", "")
    return F.when(digits != "", F.concat_ws("#", F.upper(F.regexp_replace(code, "[^\\p{L}]", "")), digits))


def scene_number(reference: Column) -> Column:
    """The number after ``scene``, without leading zeros; null if there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(reference, "(?i)scene[^0-9A-Za-z]*([0-9]+)", 1), "^0+(?=.)", ""), F.lit(""))


def star_edges(members: DataFrame, key: str, node: str) -> DataFrame:
    """a, b: every node tied to the smallest node of its key. As many edges as nodes, however large the group."""
    members = members.where(F.col(key).isNotNull()).select(key, node).distinct()
    first = members.groupBy(key).agg(F.min(node).alias("a"))
    return members.join(first, key).where(F.col("a") != F.col(node)).select("a", F.col(node).alias("b"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) of every node with an edge to another one."""
    pair = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("v"), F.col(b).alias("u"))
    both = pair.union(pair.select("u", "v"))
    state = checkpointed(both.union(both.select("v", F.col("v").alias("u"))).distinct())
    mark = None
    while True:
        low = state.groupBy("v").agg(F.min("u").alias("m"))
        sent = state.join(low, "v")
        state = checkpointed(sent.select(F.col("m").alias("v"), "u").union(sent.select(F.col("u").alias("v"), F.col("m").alias("u"))).distinct())
        now = state.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == mark:
            return state.groupBy("v").agg(F.min("u").alias("component")).select(F.col("v").alias("node"), "component")
        mark = now


def scene_ties(scenes: DataFrame, mapping: DataFrame) -> DataFrame:
    """a, b: scenes with the same session, with mapping entries of the same specimen, or named as a recapture."""
    named = scenes.where("scene IS NOT NULL").select("scene", code_key(F.col("session_code")).alias("session"), scene_number(F.col("recapture_of")).alias("ref"))
    number = named.select(F.col("scene").alias("b"), scene_number(F.col("scene")).alias("ref")).where("ref IS NOT NULL").distinct()
    recaptures = named.where("ref IS NOT NULL").join(number, "ref").where(F.col("scene") != F.col("b")).select(F.col("scene").alias("a"), "b")
    specimens = mapping.select("scene", code_key(F.col("specimen")).alias("specimen")).join(named.select("scene").distinct(), "scene", "left_semi")
    return star_edges(named, "session", "scene").union(star_edges(specimens, "specimen", "scene")).union(recaptures)


def rendezvous(key: Column, seed: int, shares: dict[str, float | Column]) -> Column:
    """The split of a key: smallest -ln(u) / share, u from a hash of key, split and seed."""

    def draw(name: str, share: float | Column) -> Column:
        u = (F.pmod(F.xxhash64(key, F.lit(name), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.struct((-F.log(u) / (share if isinstance(share, Column) else F.lit(share))).alias("draw"), F.lit(name).alias("name"))

    return F.array_min(F.array(*(draw(n, s) for n, s in shares.items() if isinstance(s, Column) or s > 0)))["name"]


def split_groups(groups: DataFrame, strata: DataFrame, shares: dict[str, float] = SHARES, seed: int = SEED, rounds: int = ROUNDS, previous: DataFrame | None = None) -> DataFrame:
    """groups (record, component) with split; strata: component, stratum, weight to be spread as the shares say, and kind if there are several.

    The kinds count alike, within a kind deviations are measured by the roots of the weights, the size at which chance
    deviations stand. Of all rounds the one is taken whose strata come nearest to the shares. previous: record, split.
    """
    shares = {n: v for n, v in shares.items() if v > 0}
    if "kind" not in strata.columns:
        strata = strata.withColumn("kind", F.lit(""))
    weights = strata.where("component IS NOT NULL AND stratum IS NOT NULL").groupBy("component", F.coalesce("kind", F.lit("")).alias("kind"), "stratum")
    weights = checkpointed(weights.agg(F.sum("weight").alias("weight")).where("weight > 0"))
    weights = weights.join(weights.groupBy("kind", "stratum").agg(F.sum("weight").alias("whole")), ["kind", "stratum"])
    weights = checkpointed(weights.join(weights.groupBy("component", "kind").agg(F.sum("weight").alias("_of")), ["component", "kind"]).withColumn("counts", F.col("weight") / F.col("_of")).drop("_of"))
    held = groups.select("component").where("false").withColumn("held", F.lit(None).cast("string"))
    if previous is not None:
        known = previous.where(F.col("split").isin(*shares)).select(F.col("record").alias("_r"), F.col("split").alias("_s"))
        held = checkpointed(groups.join(known, F.col("record") == F.col("_r")).groupBy("component").agg(F.min_by("_s", "record").alias("held")))
    factors = checkpointed(weights.select("kind", "stratum").distinct().select("kind", "stratum", *(F.lit(0.0).alias(n) for n in shares)))
    n_strata = factors.count()

    def assigned(factors: DataFrame) -> DataFrame:
        """component, split of the components in a stratum."""
        mean = weights.join(broadcast_if_small(factors, n_strata, 100), ["kind", "stratum"]).groupBy("component")
        mean = mean.agg(*(F.sum(F.col("counts") * F.col(n)).alias(n) for n in shares)).join(held, "component", "left")
        weighted = {n: F.lit(v) * F.exp(F.col(n)) for n, v in shares.items()}
        return mean.select("component", F.coalesce("held", rendezvous(F.col("component"), seed, weighted)).alias("split"))

    best, best_off = factors, None
    for k in range(rounds + 1 if n_strata else 0):
        there = weights.join(assigned(factors), "component").groupBy("kind", "stratum").agg(F.first("whole").alias("whole"), *(F.sum(F.when(F.col("split") == n, F.col("weight")).otherwise(0)).alias(n) for n in shares))
        there = checkpointed(there)
        away = reduce(lambda p, q: p + q, (F.abs(F.col(n) - F.col("whole") * v) for n, v in shares.items()))
        off = there.groupBy("kind").agg((F.sum(away) / F.sum(F.sqrt("whole"))).alias("off")).agg(F.sum("off")).first()[0]
        if best_off is None or off < best_off:
            best, best_off = factors, off
        if k < rounds:
            lacks = {n: F.lit(PACE / (k + 1) ** 0.5) * F.log((F.col("whole") * v + F.sqrt("whole")) / (F.col(n) + F.sqrt("whole"))) for n, v in shares.items()}
            factors = checkpointed(factors.join(there.select("kind", "stratum", *(x.alias(f"_{n}") for n, x in lacks.items())), ["kind", "stratum"]).select("kind", "stratum", *((F.col(n) + F.col(f"_{n}")).alias(n) for n in shares)))
    out = groups.join(assigned(best).withColumnRenamed("split", "_split"), "component", "left").join(held, "component", "left")
    return out.select(*groups.columns, F.coalesce("held", "_split", rendezvous(F.col("component"), seed, shares)).alias("split"))


def scene_groups(scenes: DataFrame, mapping: DataFrame) -> DataFrame:
    """record, component: every scene once, with the smallest scene of its group."""
    tied = components(scene_ties(scenes, mapping))
    every = scenes.where("scene IS NOT NULL").select(F.col("scene").alias("record")).distinct()
    return every.join(tied, every["record"] == tied["node"], "left").select("record", F.coalesce("component", "record").alias("component"))
