"""Rows that fail to parse: load what can be loaded, set the rest apart with the reason.

Every line is cut into nullable text fields; all rules are evaluated as columns into an array of reasons; a line is
good if the array is empty. Everything is a built-in expression over one scan: no shuffle, no Python.

Defined results: a null line has no fields (``columns``); a null separator makes the line one field (``columns``);
an unknown or null record type has no valid values (``value``); repeated lines are repeated in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for an unquoted separator while a line is cut.
_CUT = "\u001f\u241f\u001f"
_BLANK = "[\\s\\u00a0\\u3000\\ufeff]"


def _fields(line: Column, sep: Column) -> Column:
    """Struct of fields and badly (quoted) of a line. Between quotes, the parts of split(line, '"') alternate outside, inside."""
    quoted_sep = F.concat(F.lit("\\Q"), sep, F.lit("\\E"))
    white = F.concat(F.lit("[\\s\\u00a0\\u3000\\ufeff&&[^"), quoted_sep, F.lit("]]*"))
    after_close = F.concat(F.lit("(?s)^"), white, F.lit("("), quoted_sep, F.lit(".*)?$"))
    before_open = F.concat(F.lit("(?s)^(.*"), quoted_sep, F.lit(")?"), white, F.lit("$"))
    parts = F.split(line, '"', -1)
    # computed once per line, not once per part
    once = F.array(F.struct(parts.alias("parts"), (F.size(parts) - 1).alias("last"), sep.alias("sep"), after_close.alias("after"), before_open.alias("before")))

    def of(k: Column) -> Column:
        def wrong(part: Column, i: Column) -> Column:
            outside, doubled = i % 2 == 0, (part == "") & (i > 0) & (i < k["last"])
            bad = ((i > 0) & ~F.regexp(part, k["after"])) | ((i < k["last"]) & ~F.regexp(part, k["before"]))
            # a part between a closing and an opening quote needs a separator of its own
            lone = (i > 0) & (i < k["last"]) & ~F.contains(part, k["sep"])
            return outside & ~doubled & (bad | lone)

        marked = F.transform(k["parts"], wrong)
        badly = (k["last"] % 2 == 1) | F.exists(marked, lambda m: m)
        masked = F.array_join(F.transform(k["parts"], lambda p, i: F.when(i % 2 == 0, F.replace(p, k["sep"], F.lit(_CUT))).otherwise(p)), '"')
        raw = F.transform(F.split(masked, f"\\Q{_CUT}\\E", -1), lambda f: F.regexp_replace(f, f"^{_BLANK}+|{_BLANK}+$", ""))
        fields = F.transform(
            raw, lambda f: F.when(f.startswith('"') & (F.length(f) > 1), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)
        )
        return F.struct(fields.alias("fields"), badly.alias("badly"))

    return F.transform(once, of)[0]


def parse_lines(df: DataFrame, line: str = "line_text", sep: str = "sep", record_type: str = "record_type") -> DataFrame:
    """df with f1, f2, f3 (nullable text) and errors (array of quoting, columns, value, in this order)."""
    text = F.when(F.col(line).endswith("\r"), F.substring(F.col(line), F.lit(1), F.length(line) - 1)).otherwise(F.col(line))
    cut = _fields(text, F.coalesce(F.nullif(F.col(sep), F.lit("")), F.lit(_CUT)))
    df = df.withColumn("_cut", F.when(F.col(line).isNotNull(), cut)).withColumns({"_fields": F.col("_cut.fields"), "_badly": F.col("_cut.badly")}).drop("_cut")
    f = [F.get("_fields", F.lit(i)) for i in range(3)]
    df = df.withColumns({"f1": f[0], "f2": f[1], "f3": f[2]})

    scene_ok = F.regexp("f1", F.lit("^scene[0-9]+$"))
    whole = F.regexp("f2", F.lit("^[0-9]+$"))
    number = F.when(F.regexp("f3", F.lit("^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$")), F.col("f3").try_cast("double"))
    wavelength_ok = scene_ok & whole & number.between(200, 3000)
    species_ok = F.regexp("f3", F.lit("\\p{L}")) & ~F.regexp("f3", F.lit("[\\x{FFFD}\\p{Cc}&&[^\\t\\n\\r]]"))
    mapping_ok = scene_ok & whole & F.regexp("f2", F.lit("[1-9]")) & species_ok
    value_ok = F.when(F.col(record_type) == "wavelength", wavelength_ok).when(F.col(record_type) == "mapping", mapping_ok).otherwise(False)
    rules = [
        F.when(F.coalesce("_badly", F.lit(False)), F.lit("quoting")),
        F.when(F.coalesce(F.size("_fields"), F.lit(0)) != 3, F.lit("columns")),
        F.when(~F.coalesce(value_ok, F.lit(False)), F.lit("value")),
    ]
    return df.withColumn("errors", F.array_compact(F.array(*rules))).drop("_fields", "_badly")


def rejected(parsed: DataFrame) -> DataFrame:
    """The lines that cannot be loaded, with the first reason that holds."""
    return parsed.where(F.size("errors") > 0).withColumn("reason", F.get("errors", F.lit(0)))


def wavelengths(parsed: DataFrame) -> DataFrame:
    """Typed wavelength records of the good lines."""
    good = parsed.where((F.col("record_type") == "wavelength") & (F.size("errors") == 0))
    return good.select("record_id", F.col("f1").alias("scene"), F.col("f2").try_cast("bigint").alias("band"), F.col("f3").try_cast("double").alias("wavelength"))


def mappings(parsed: DataFrame) -> DataFrame:
    """Typed mapping records of the good lines."""
    good = parsed.where((F.col("record_type") == "mapping") & (F.size("errors") == 0))
    return good.select("record_id", F.col("f1").alias("scene"), F.col("f2").try_cast("bigint").alias("ordinal"), F.col("f3").alias("species"))
