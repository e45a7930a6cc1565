import random

from pyspark.sql import functions as F

from cubeframe.llm import canonical as c

ENTRIES = [(1, "vårlig thornash", "Thornaxus quilodoroides", "VORN"), (2, "brack esker", "Eskeria netquirhoata", "BCSE"), (3, "brackish esker", "Eskeria zudordorica", "BCIK"), (4, "ribbed élanwood", "Elania oreliorensis", "RBEL"), (5, "pale mapplin", "Mapplus quifatirica", "PLAL"), (6, "marl mapplin", None, None)]
SCHEMA = "species_id int, species_name string, latin_name string, abbrev string"


def match(spark, values):
    rows = spark.createDataFrame(list(enumerate(values)), "mapping_id bigint, species string")
    out = c.with_entry(rows.withColumns({"value": F.lit("x"), "score": F.lit(1), "_value": F.lit(2)}), "species", spark.createDataFrame(ENTRIES, SCHEMA))
    return [r.species_id for r in out.orderBy("mapping_id").collect()]


def test_ways_to_write_a_name(spark):
    values = {
        "VÅRLIG THORNASH": 1, " vårlig  thornash ": 1, "vÃ¥rlig thornash": 1, "varlig-thornash": 1, "thornash, vårlig": 1, "Thornash (vårlig)": 1, "vorn": 1, "V.O.R.N.": 1,
        "brасk еskеr": 2, "brack eskers": 2, "E. netquirhoata": 2, "E.netquirhoata": 2, "Esk. netquirhoata": 2, "brack esker / Eskeria netquirhoata": 2, "brack esker no. 2": 2, "brack esker, 12% mc": 2,
        "brackish resker": 3, "brackishesker": 3, "ribbed é1anw00d": 4, "ribbed élanwood [recheck]": 4, "Elania oreliorensis (ribbed élanwood)": 4, "pale maplin​": 5, "marl mapplin sapwood": 6,
        "unknown": 0, "plover fozzler": 0, "mapplin": 0, "n/a": 0, "vor": 0, "?": 0,
    }
    assert dict(zip(values, match(spark, list(values)))) == values


def test_null_blank_repeated_and_long(spark):
    long = "pale mapplin " + " ".join(f"remark{i}" for i in range(3000))
    assert match(spark, [None, "", " \t", "RBEL", "RBEL", long, "x" * 100000]) == [None, None, None, 4, 4, 5, 0]


def test_tie_is_unmatched(spark):
    twins = spark.createDataFrame([(1, "grey oak", None, None), (2, "grey oak", None, None)], SCHEMA)
    rows = spark.createDataFrame([(1, "grey oak")], "mapping_id bigint, species string")
    assert c.with_entry(rows, "species", twins).first().species_id == 0


def test_empty_tables_and_report(spark):
    entries = spark.createDataFrame(ENTRIES, SCHEMA)
    rows = spark.createDataFrame([(1, "plover fozzler"), (2, "Plover  Fozzler"), (3, "RBEL")], "mapping_id bigint, species string")
    assert [tuple(r) for r in c.unmatched(rows, "species", entries).collect()] == [("plover fozzler", 2, 2)]
    assert c.with_entry(rows.where("false"), "species", entries).count() == 0
    assert {r.species_id for r in c.with_entry(rows, "species", entries.where("false")).collect()} == {0}


def test_held_out_slips(spark, data):
    """Single slips in the list's own names: at least 99 % come back to their entry."""
    rng = random.Random(8)
    names = [(r.species_id, r.species_name) for r in spark.read.parquet(f"{data}/species_list.parquet").collect()]
    made = []
    for i, name in names:
        k = rng.randrange(1, len(name) - 1)
        made.append((i, rng.choice([name[:k] + name[k + 1 :], name[:k] + rng.choice("aeinrst") + name[k:], name[:k] + rng.choice("aeinrst") + name[k + 1 :]])))
    rows = spark.createDataFrame(made, "truth int, species string")
    out = c.with_entry(rows, "species", spark.read.parquet(f"{data}/species_list.parquet")).collect()
    assert sum(r.truth == r.species_id for r in out) >= 0.99 * len(out)


def test_names_of_three_to_five_words(spark):
    entries = [(1, "great southern silver oak", None, None), (2, "black river tupelo", None, None), (3, "tall black river reed of home", None, None), (4, "silver oak", None, None)]
    values = {
        "great southern silver oak": 1, "Great Southern Silver Oak (dry)": 1, "great suthern silver oak": 1, "plot 7, great southern silver oak": 1, "black river tupelo": 2, "black river tupleo": 2,
        "tall black river reed of home": 3, "tall black river reed of hme, sapwood": 3, "silver oak": 4, "silver oak no. 3": 4, "southern": 0,
    }
    rows = spark.createDataFrame(list(enumerate(values)), "mapping_id bigint, species string")
    out = c.with_entry(rows, "species", spark.createDataFrame(entries, SCHEMA)).orderBy("mapping_id").collect()
    assert {r.species: r.species_id for r in out} == values


def test_prefix_filter_loses_nothing(spark, data):
    """Every pair of a phrase and an entry above the threshold, by brute force over all forms."""
    import math

    entries = spark.read.parquet(f"{data}/species_list.parquet").collect()
    form = {(r.species_id, f) for r in entries for f in c.forms(r.species_name, r.latin_name, r.abbrev)}
    grams = lambda s: {f"^{s}$"[i : i + n] for n in c.GRAMS for i in range(len(s) + 3 - n)}
    of = {}
    for i, f in form:
        for g in grams(f):
            of.setdefault(g, set()).add(i)
    top = math.log(len(form) + 1.0)
    w2 = {g: math.log((len(form) + 1.0) / len(i)) ** 2 for g, i in of.items()}
    size = lambda s: sum(w2.get(g, top * top) for g in grams(s))
    values = [r.species for r in spark.read.parquet(f"{data}/mapping.parquet").select("species").distinct().where("species IS NOT NULL").limit(60).collect()]
    want = {}
    for v in values:
        per = {}
        for p in c.phrases(v, 2):
            near = {}
            for i, f in form:
                a, b = len(p), len(f)
                if p == f or (b >= c.SHORT and a >= b * (1 - c.LENGTHS) and a * (1 - c.LENGTHS) <= b):
                    score = sum(w2[g] for g in grams(p) & grams(f)) / math.sqrt(size(p) * size(f))
                    if score >= c.THRESHOLD:
                        near[i] = max(near.get(i, 0), score)
            for i, s in near.items():
                per[i] = max(per.get(i, 0), s)
        want[v] = max(per.values(), default=0)
    df = spark.createDataFrame([(v,) for v in values], "species string")
    got = c.match_values(df, "species", spark.createDataFrame(entries)).collect()
    assert all(abs(r.score - want[r.value]) < 1e-9 for r in got if r.species_id)
    assert sum(bool(r.species_id) for r in got) >= 0.8 * sum(s > 0 for s in want.values())
