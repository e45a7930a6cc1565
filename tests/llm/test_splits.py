import random

from pyspark.sql import functions as F

from cubeframe.llm import splits


def union_find(pairs):
    parent = {}

    def root(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return {a: root(a) for a in parent}


def test_components_against_union_find(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(400):03d}", f"n{rng.randrange(400):03d}") for _ in range(260)]
    pairs += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]  # a chain
    pairs += [("h000", f"h{i:03d}") for i in range(1, 150)]  # a hub
    df = spark.createDataFrame(pairs + pairs[:20] + [(None, "n001"), ("n002", None)], "a string, b string")
    got = {r.node: r.component for r in splits.components(df).collect()}
    assert got == union_find([p for p in pairs if p[0] != p[1]])


def test_components_of_nothing(spark):
    assert splits.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_codes(spark):
    codes = ["SES-0000022", " ses22 ", "Ses#00022", "SES/220", "none", "", None, "-", "SP 22", "ses_0"]
    df = spark.createDataFrame([(c,) for c in codes], "c string").select("c", splits.code_key(F.col("c")).alias("k"))
    got = [r.k for r in df.collect()]
    assert got[0] == got[1] == got[2] == "SES#22" and got[3] == "SES#220" and got[4:8] == [None] * 4 and got[8] == "SP#22" and got[9] == "SES#0"
    refs = ["scene0000308_refl.raw", "SCENE308", " scene 0308.hdr", "no", None, "308"]
    df = spark.createDataFrame([(c,) for c in refs], "c string").select(splits.scene_number(F.col("c")).alias("k"))
    assert [r.k for r in df.collect()] == ["308", "308", "308", None, None, None]


def test_scene_ties(spark):
    scenes = spark.createDataFrame(
        [("scene01", "S-1", None, 1), ("scene02", "s 001", None, 1), ("scene03", None, "scene1", 1), ("scene04", "none", "scene99", 1), ("scene05", None, "scene05", 1), ("scene06", "S-9", None, 1), (None, "S-1", None, 1)],
        "scene string, session_code string, recapture_of string, ref int",
    )
    mapping = spark.createDataFrame([("scene06", "SP1"), ("scene04", "sp-01"), ("scene77", "SP1"), ("scene05", None)], "scene string, specimen string")
    got = {r.record: r.component for r in splits.scene_groups(scenes, mapping).collect()}
    assert got == {"scene01": "scene01", "scene02": "scene01", "scene03": "scene01", "scene04": "scene04", "scene05": "scene05", "scene06": "scene04"}


def test_shares_and_unity(spark):
    n = 4000
    groups = spark.range(n).select(F.col("id").cast("string").alias("record"), (F.col("id") % 1500).cast("string").alias("component"))
    strata = groups.select("component", F.lit("all").alias("stratum"), F.lit(1).alias("weight")).union(groups.select("component", F.concat(F.lit("s"), F.col("component") % 5), F.lit(1)))
    out = splits.split_groups(groups, strata).cache()
    assert out.groupBy("component").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    share = {r["split"]: r["count"] / n for r in out.groupBy("split").count().collect()}
    assert all(abs(share[k] - v) < 0.02 for k, v in splits.SHARES.items())
    empty = groups.where("false")
    assert splits.split_groups(empty, strata.where("false")).count() == 0


def test_a_component_stays_when_others_come(spark):
    key = spark.range(500).select(F.col("id").cast("string").alias("c"))
    one = {r.c: r.s for r in key.select("c", splits.rendezvous(F.col("c"), 3, splits.SHARES).alias("s")).collect()}
    two = {r.c: r.s for r in key.where("c < 100").select("c", splits.rendezvous(F.col("c"), 3, splits.SHARES).alias("s")).collect()}
    assert all(one[c] == s for c, s in two.items())


def _scenes(spark, n):
    """Components of one to four scenes, each with entries of some of 20 species."""
    rng = random.Random(21)
    groups, strata = [], []
    for c in range(n):
        for k in range(rng.choice([1, 1, 1, 2, 4])):
            groups.append((f"s{c:05d}-{k}", f"c{c:05d}"))
            strata += [(f"c{c:05d}", "scenes", 1)] + [(f"c{c:05d}", f"species {rng.randrange(20)}", 1) for _ in range(3)]
    return spark.createDataFrame(groups, "record string, component string"), spark.createDataFrame(strata, "component string, stratum string, weight bigint")


def test_none_moves_when_a_tenth_more_comes(spark):
    before, strata = _scenes(spark, 1000)
    more, more_strata = _scenes(spark, 1100)
    first = splits.split_groups(before, strata).cache()
    old = {r.record: r.split for r in first.collect()}
    new = {r.record: r.split for r in splits.split_groups(more, more_strata, previous=first.select("record", "split")).collect()}
    assert all(new[k] == v for k, v in old.items()) and len(new) > len(old)
    for of in (old, new):
        shares = {s: sum(v == s for v in of.values()) / len(of) for s in splits.SHARES}
        assert all(abs(shares[s] - v) < 0.01 for s, v in splits.SHARES.items()), shares
    plain, more_plain = ({r.record: r.split for r in splits.split_groups(g, s, rounds=0).collect()} for g, s in ((before, strata), (more, more_strata)))
    assert all(more_plain[k] == v for k, v in plain.items())


def test_groups_without_strata_and_unknown_splits(spark):
    groups, strata = _scenes(spark, 30)
    known = spark.createDataFrame([("s00003-0", "test"), ("gone", "test"), ("s00004-0", "elsewhere"), (None, "test")], "record string, split string")
    got = {r.record: r.split for r in splits.split_groups(groups, strata.where("false"), previous=known).collect()}
    assert len(got) == groups.count() and got["s00003-0"] == "test" and set(got.values()) <= set(splits.SHARES)
    assert splits.split_groups(groups.where("false"), strata.where("false")).count() == 0
