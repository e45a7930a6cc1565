"""Mapping free-entered values to a canonical list.

Values are brought to their distinct spellings, normalised, and cut into phrases: windows of up to as many words as the
longest form of the list has. A character n-gram inverted index over the list's forms gives the candidates of each
distinct phrase, and their weighted cosine decides. A phrase stands for its best entry if that is above a threshold and
ahead of any other entry by a margin (of candidates within two edits, fewer edits decide); a value takes the entry of
its best phrase by the same rule, where a phrase within a longer one that also stands for an entry (within two edits)
does not count; else it is unmatched (id 0) and reported.

Candidates come from the rarest n-grams of a phrase only (prefix filter). A shared n-gram has the same weight on both
sides, so the most frequent ones are left out as long as their squared weights together cannot reach what the threshold
asks of the phrase and the least form of a fitting length; a candidate whose rare n-grams fall short by more than the
light ones could add is dropped before it is scored. No candidate above the threshold is lost, and the long postings of
frequent n-grams are never read. Distinct phrases are spread over the shuffle's partitions once; n-grams, candidates and
scores of a phrase stay where it is.

All joins are plain equi-joins on n-grams or phrases; the index is broadcast only while its size is known to be small.

Defined results: null and blank values have no row in ``match_values`` (an outer join leaves them null); a value that two
entries claim within the margin is unmatched; an empty list leaves every value unmatched; repeated rows keep their count
and get the same entry.
"""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeframe.session import broadcast_if_small, checkpointed

THRESHOLD, MARGIN = 0.4, 0.05
GRAMS = (2, 3)
#: Forms of fewer letters must be met exactly; a phrase's length may differ from the form's by this share.
SHORT, LENGTHS = 6, 0.25
#: Up to so many edits, fewer edits count before the cosine.
EDITS = 2

#: Letters that look like Latin ones (fixed values).
LOOKALIKES = str.maketrans("аеорсухкмтнвіѕјһԁԛԝαεορτυχκνιøłđðı", "aeopcyxkmthbisjhdqwaeoptuxkviolddi")


def normalise(text: str) -> str:
    """Lower case without accents, invisible characters, look-alikes, digits for letters and wrongly decoded UTF-8."""
    text = "".join(c for c in text if c < "\u0100" or unicodedata.category(c) != "Cf")
    if "Ã" in text or "Â" in text:
        for code in ("cp1252", "latin-1"):
            try:
                text = text.encode(code).decode("utf-8")
                break
            except UnicodeError:
                pass
    text = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    text = text.translate(LOOKALIKES).replace("æ", "ae").replace("œ", "oe")
    text = re.sub(r"\b(?:[a-z]\.){2,}[a-z]?\b", lambda m: m.group().replace(".", ""), text)
    return re.sub(r"[^\W_]+", lambda m: m.group().replace("0", "o").replace("1", "l") if re.search(r"[^\W\d_]", m.group()) else m.group(), text)


def _words(text: str | None) -> list[str]:
    return re.findall(r"[^\W_]+", normalise(text or ""))


def phrases(text: str, longest: int) -> list[str]:
    """All windows of up to ``longest`` words, written together."""
    words = _words(text)
    return list(dict.fromkeys("".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)))


def forms(name: str | None, latin: str | None, abbrev: str | None) -> list[str]:
    """Spellings of an entry: its names, the common name turned round, the Latin one shortened, the abbreviation."""
    out = []
    common, lat = _words(name), _words(latin)
    if common:
        out += ["".join(common), "".join(common[-1:] + common[:-1])]
    if lat:
        out.append("".join(lat))
    if len(lat) > 1:
        out += [lat[0][0] + "".join(lat[1:]), lat[0][:3] + "".join(lat[1:])]
    return [x for x in dict.fromkeys([*out, "".join(_words(abbrev))]) if x]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _grams(text: pd.Series) -> pd.Series:
    return text.map(lambda s: list({f"^{s}$"[i : i + n] for n in GRAMS for i in range(len(s) + 3 - n)}))


def _gram_ids(text: str) -> Column:
    return F.transform(_grams(text), lambda g: F.xxhash64(g))


@F.pandas_udf(T.StructType([T.StructField("forms", T.ArrayType(T.StringType())), T.StructField("words", T.IntegerType())]))
def _forms(name: pd.Series, latin: pd.Series, abbrev: pd.Series) -> pd.DataFrame:
    """The entry's spellings and the words of its longest name."""
    rows = [[None if pd.isna(v) else v for v in x] for x in zip(name, latin, abbrev)]
    return pd.DataFrame({"forms": [forms(*x) for x in rows], "words": [max(len(_words(v)) for v in x) for x in rows]})


def _index(entries: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """(fid, species_id, form, form2, grams of every form; gram, fid, length, form2, w2 of every n-gram; n-grams; words of the longest phrase).

    n-grams, forms and phrases are numbered by their 64-bit hashes.
    """
    spelt = entries.where("species_id IS NOT NULL").select("species_id", _forms("species_name", "latin_name", "abbrev").alias("f"))
    form = spelt.select("species_id", "f.words", F.explode("f.forms").alias("form")).groupBy("species_id", "form").agg(F.max("words").alias("words"))
    form = checkpointed(form.withColumns({"fid": F.xxhash64("species_id", "form"), "grams": _gram_ids("form")}))
    n_forms, longest, size = form.agg(F.count("*"), F.coalesce(F.max("words"), F.lit(1)), F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()
    gram = form.select("fid", "species_id", F.length("form").alias("length"), F.explode("grams").alias("gram"))
    w = F.log(F.lit(n_forms + 1.0) / F.col("df"))
    weight = gram.groupBy("gram").agg(F.count_distinct("species_id").alias("df")).select("gram", (w * w).alias("w2"))
    gram = gram.join(weight, "gram").withColumn("form2", F.sum("w2").over(Window.partitionBy("fid"))).select("gram", "fid", "length", "form2", "w2")
    return form.select("fid", "species_id", "form", "grams"), checkpointed(gram), size, longest


def _lengths(form: Column) -> tuple[Column, Column]:
    """Least and largest length of a phrase that may stand for a form of so many letters."""
    short = form < SHORT
    return F.when(short, form).otherwise(F.ceil(form * (1 - LENGTHS) - 1e-9)).cast("int"), F.when(short, form).otherwise(F.floor(form / (1 - LENGTHS) + 1e-9)).cast("int")


def match_values(values: DataFrame, column: str, entries: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """value, species_id (0: none), score: one row per distinct non-blank value of a column."""
    forms_, index, size, longest = _index(entries)
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def windows(text: pd.Series) -> pd.Series:
        return text.map(lambda t: phrases(t, longest))

    # spread by number: a small table may be long work, so it must not be put together into one partition
    distinct = values.select(F.col(column).alias("value")).where(F.regexp("value", F.lit(r"[^\s\u200b\u00a0\ufeff]"))).distinct().repartition(n)
    of_value = checkpointed(distinct.withColumn("phrase", F.explode_outer(windows("value"))).withColumn("ph", F.xxhash64("phrase")))
    phrase = of_value.where("phrase IS NOT NULL").select("ph", "phrase").distinct()
    phrase = checkpointed(phrase.withColumn("grams", _gram_ids("phrase")))

    # the n-grams of a phrase from the lightest to the heaviest; one that no form has weighs most and matches nothing
    least = index.select("length", "form2").distinct().select(F.explode(F.sequence(*_lengths(F.col("length")))).alias("letters"), "form2").groupBy("letters").agg(F.min("form2").alias("least2"))
    weight = index.groupBy("gram").agg(F.first("w2").alias("w2"))
    top = F.lit(math.log(forms_.count() + 1.0) ** 2)
    spread = phrase.repartition(n, "ph").withColumn("letters", F.length("phrase"))
    spread = spread.join(F.broadcast(least), "letters")  # one row per length; a length that no form comes near ends here
    gram = spread.select("ph", "letters", "least2", F.explode("grams").alias("gram")).join(broadcast_if_small(weight, size, 40), "gram", "left")
    one = F.struct(F.coalesce("w2", top).alias("w2"), "gram", F.col("w2").isNotNull().alias("known"))
    per = gram.groupBy("ph", "letters", "least2").agg(F.array_sort(F.collect_list(one)).alias("g"))
    per = per.withColumn("phrase2", F.aggregate("g", F.lit(0.0), lambda s, x: s + x["w2"]))
    asked = lambda other: F.lit(threshold * (1 - 1e-9)) * F.sqrt(F.col("phrase2") * other)
    per = per.withColumn("need", asked(F.greatest(F.col("least2"), F.lit(threshold**2) * F.col("phrase2"))))

    def further(s: Column, x: Column) -> Column:
        upto = s["upto"] + F.when(x["known"], x["w2"]).otherwise(0.0)
        light = upto < F.col("need")
        return F.struct(upto.alias("upto"), F.when(light, upto).otherwise(s["light2"]).alias("light2"), F.when(light, s["k"] + 1).otherwise(s["k"]).alias("k"))

    per = per.withColumn("cut", F.aggregate("g", F.struct(F.lit(0.0).alias("upto"), F.lit(0.0).alias("light2"), F.lit(0).alias("k")), further))
    known = lambda part: F.transform(F.filter(part, lambda x: x["known"]), lambda x: x["gram"])
    per = per.select("ph", "letters", "phrase2", F.col("cut.light2").alias("light2"), known(F.slice("g", F.lit(1), F.col("cut.k"))).alias("light"), known(F.slice("g", F.col("cut.k") + 1, F.size("g"))).alias("rare"))
    per = checkpointed(per).repartition(n, "ph")

    rare = per.select("ph", "letters", "phrase2", "light2", F.explode("rare").alias("gram")).join(broadcast_if_small(index, size, 80), "gram")
    shortest, longest_ = _lengths(F.col("length"))
    rare = rare.where((F.col("letters") >= shortest) & (F.col("letters") <= longest_))
    met = rare.groupBy("ph", "fid").agg(F.sum("w2").alias("dot"), *(F.max(c).alias(c) for c in ("phrase2", "light2", "form2")))
    met = met.where(F.col("dot") + F.least(F.col("light2"), F.col("form2") - F.col("dot")) >= asked(F.col("form2")))

    # the candidates' light n-grams
    listed = broadcast_if_small(forms_, size, 60)
    shared = F.explode_outer(F.array_intersect("light", "grams")).alias("gram")
    more = met.join(per.select("ph", "light"), "ph").join(listed, "fid").select("ph", "fid", "species_id", "form", "dot", "phrase2", "form2", shared)
    more = more.join(broadcast_if_small(weight, size, 40), "gram", "left").groupBy("ph", "fid", "species_id").agg((F.max("dot") + F.coalesce(F.sum("w2"), F.lit(0.0))).alias("dot"), F.max("phrase2").alias("phrase2"), F.max("form2").alias("form2"))
    scored = (
        more.withColumn("score", F.col("dot") / F.sqrt(F.col("phrase2") * F.col("form2")))
        .where(F.col("score") >= threshold)
        .join(phrase.select("ph", "phrase"), "ph").join(broadcast_if_small(forms_.select("fid", "form"), size, 20), "fid")
        .where((F.length("form") >= SHORT) | (F.col("phrase") == F.col("form")))  # a form too short to tell a slip from another word must be met exactly
        .withColumn("edits", F.least(F.levenshtein("phrase", "form"), F.lit(EDITS + 1)))
        .groupBy("ph", "species_id")
        .agg(F.max("score").alias("score"), F.min("edits").alias("edits"))
    )
    # a phrase that two entries share (one word of a name) says nothing
    kept = _ahead(scored, "ph", margin)
    claims = checkpointed(of_value.join(kept, "ph"))
    # a claim within a longer one gives way to it: of "silver oak" and "great southern silver oak" the latter is meant
    long = claims.where(F.col("edits") <= EDITS).groupBy("value").agg(F.collect_list("phrase").alias("long"))
    outer = F.exists("long", lambda p: (F.length(p) > F.length("phrase")) & F.contains(p, F.col("phrase")))
    claims = claims.join(long, "value", "left").where(~F.coalesce(outer, F.lit(False)))
    best = claims.groupBy("value", "species_id").agg(F.max("score").alias("score"), F.min("edits").alias("edits"))
    taken = _ahead(best, "value", margin)
    every = of_value.select("value").distinct()
    return every.join(taken, "value", "left").select("value", F.coalesce("species_id", F.lit(0)).cast("int").alias("species_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _ahead(scored: DataFrame, key: str, margin: float) -> DataFrame:
    """The best entry of each key if no other comes near: fewer edits, when they are few, or a score ahead by the margin."""
    order = Window.partitionBy(key).orderBy("edits", F.desc("score"), "species_id")
    ranked = scored.withColumns({"r": F.row_number().over(order), "next_edits": F.lead("edits", 1, EDITS + 2).over(order), "next": F.lead("score", 1, 0.0).over(order)})
    clear = ((F.col("edits") <= EDITS) & (F.col("edits") < F.col("next_edits"))) | (F.col("score") - F.col("next") >= margin)
    return ranked.where((F.col("r") == 1) & clear).drop("r", "next", "next_edits")


def with_entry(rows: DataFrame, column: str, entries: DataFrame) -> DataFrame:
    """rows with species_id: 0 where the list has no such entry, null where the value is null or blank."""
    found = match_values(rows, column, entries).select(F.col("value").alias("_cf_value"), F.col("species_id").alias("_cf_id"))
    return rows.join(found, rows[column] == F.col("_cf_value"), "left").withColumn("species_id", F.col("_cf_id")).drop("_cf_value", "_cf_id")


def unmatched(rows: DataFrame, column: str, entries: DataFrame) -> DataFrame:
    """The values that the list lacks, normalised, with their rows and spellings."""
    none = with_entry(rows, column, entries).where("species_id = 0")
    return none.groupBy(_normalised(F.col(column)).alias("entry")).agg(F.count("*").alias("n"), F.count_distinct(column).alias("spellings"))


@F.pandas_udf(T.StringType())
def _normalised(text: pd.Series) -> pd.Series:
    return text.map(lambda t: " ".join(re.findall(r"[^\W_]+", normalise(t))))
