from cubeframe.operators import rejects

LINES = [
    ("wavelength", ",", "scene1,2,500.5", None),
    ("wavelength", ",", ' scene1 , 02 , "+5.0e2" \r', None),
    ("wavelength", ";", "scene1;2;781,4", "value"),
    ("wavelength", ",", "scene1,2,199.9", "value"),
    ("wavelength", ",", "scene1,2,3000", None),
    ("wavelength", ",", "scene1,2,nan", "value"),
    ("wavelength", ",", "scene1,-1,500", "value"),
    ("wavelength", ",", "scn1,1,500", "value"),
    ("mapping", ",", "scene1,0,oak", "value"),
    ("mapping", ",", "scene1,1,12", "value"),
    ("mapping", ",", "scene1,1,oak\x07", "value"),
    ("mapping", ",", "scene1,1,o�k", "value"),
    ("mapping", ",", 'scene1,1,"oak\tred\nx"', None),
    ("mapping", ",", 'scene1,1,"oak, ""red"""', None),
    ("mapping", ",", 'scene1,1,"oak', "quoting"),
    ("mapping", ",", 'scene1,1,oak"', "quoting"),
    ("mapping", ",", 'scene1,1,"oak" x', "quoting"),
    ("mapping", ",", 'scene1,"1,oak', "quoting"),
    ("mapping", ",", 'scene1,1,o"a"k', "quoting"),
    ("mapping", ",", 'scene1,1,"a""', "quoting"),
    ("mapping", ",", "scene1,1", "columns"),
    ("mapping", ",", "scene1,1,oak,", "columns"),
    ("mapping", "\t", 'scene1\t1\t"oak\tash"', None),
    ("mapping", "\t", "scene1\t\t1\toak", "columns"),
    ("mapping", ",", '"","",""', "value"),
    ("mapping", ",", "", "columns"),
    ("mapping", ",", None, "columns"),
    ("mapping", None, "scene1,1,oak", "columns"),
    (None, ",", "scene1,1,oak", "value"),
    ("other", ",", "scene1,1,oak", "value"),
    ("mapping", ",", 'scene1;1,"x"', "columns"),
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, *x[:3], "extra") for i, x in enumerate(LINES)], "record_id bigint, record_type string, sep string, line_text string, f1 string")
    parsed = rejects.parse_lines(df)
    got = {r.record_id: r.reason for r in rejects.rejected(parsed).collect()}
    assert got == {i: x[3] for i, x in enumerate(LINES) if x[3]}
    good = rejects.wavelengths(parsed).count() + rejects.mappings(parsed).count()
    assert good + len(got) == len(LINES)


def test_typed_records(spark):
    df = spark.createDataFrame([(1, "wavelength", ",", '"scene7", 3 ,1.5e3'), (2, "mapping", ",", 'scene7,04,"oak ""b"""')], "record_id bigint, record_type string, sep string, line_text string")
    parsed = rejects.parse_lines(df)
    assert tuple(rejects.wavelengths(parsed).first()) == (1, "scene7", 3, 1500.0)
    assert tuple(rejects.mappings(parsed).first()) == (2, "scene7", 4, 'oak "b"')


def test_long_lines_repeats_and_empty(spark):
    long = 'scene1,1,"' + 'a""' * 100000 + '"'
    df = spark.createDataFrame([(1, "mapping", ",", long), (1, "mapping", ",", long), (2, "mapping", ",", "x," * 50000)], "record_id bigint, record_type string, sep string, line_text string")
    parsed = rejects.parse_lines(df)
    assert [len(r.species) for r in rejects.mappings(parsed).collect()] == [200000, 200000]
    assert [r.reason for r in rejects.rejected(parsed).collect()] == ["columns"]
    assert rejects.rejected(rejects.parse_lines(df.where("false"))).count() == 0


def test_plan_is_one_scan_without_shuffle_or_python(spark, data):
    plan = rejects.rejected(rejects.parse_lines(spark.read.parquet(f"{data}/raw_lines.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
