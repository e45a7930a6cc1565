from cubeframe.operators.packed_values import clean, learn, pieces, split_packed


def split(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "line_id bigint, species string")
    rows = split_packed(df, "species", "species", **how).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.line_id, r.ordinal)):
        out.setdefault(r.line_id, []).append((r.ordinal, r.species))
    return out


def test_separators_quotes_brackets(spark):
    got = split(
        spark,
        [
            "oak, ash;elm | fir",
            '"oak, red";\'ash; white\' ; elm (dry, cut)',
            '["oak","ash ""b"" tall"]',
            "{oak;;ash}",
            "keld's oak & ash + elm",
            "“oak/ash mix” 、 elm\tfir\r",
            '"oak \\"king\\" tree"',
            "oak x ash, elm",
        ],
    )
    assert got == {
        0: [(1, "oak"), (2, "ash"), (3, "elm"), (4, "fir")],
        1: [(1, "oak, red"), (2, "ash; white"), (3, "elm (dry, cut)")],
        2: [(1, "oak"), (2, 'ash "b" tall')],
        3: [(1, "oak"), (3, "ash")],
        4: [(1, "keld's oak"), (2, "ash"), (3, "elm")],
        5: [(1, "oak/ash mix"), (2, "elm"), (3, "fir")],
        6: [(1, 'oak "king" tree')],
        7: [(1, "oak x ash"), (2, "elm")],
    }


def test_blank_null_unclosed_and_repeated(spark):
    got = split(spark, [None, "", "  ", '""; ', '"oak; ash', "(oak; ash", "oak, ash", "oak, ash"])
    assert got == {4: [(1, '"oak'), (2, "ash")], 5: [(1, "(oak"), (2, "ash")], 6: [(1, "oak"), (2, "ash")], 7: [(1, "oak"), (2, "ash")]}


def test_a_separator_within_a_frequent_value_stays(spark):
    """'salt & pepper' is a value of many fields, 'salt' and 'pepper' are of none: the column itself says so."""
    texts = [f"salt & pepper, item{i}a, item{i % 7}b" for i in range(60)] + [f"item{i % 7}b, other{i % 5}" for i in range(60)]
    got = split(spark, texts)
    assert got[3][0] == (1, "salt & pepper")
    assert [v for _, v in got[70]] == ["item3b", "other0"]


def test_learnt_separators(spark):
    df = spark.createDataFrame([(i, f"a{i * 7 % 30}, b{i * 11 % 31}; c{i * 13 % 29}") for i in range(200)], "line_id bigint, species string")
    learnt = learn(df, "species")
    assert learnt.cut[","] > 0.9 and learnt.cut[";"] > 0.9 and learnt.cut["|"] == 0.8
    assert learnt.values.count() >= 90 and learnt.total > 0


def test_long_field_extra_columns_and_empty_table(spark):
    long = ";".join(f"v{i % 50}" for i in range(20000))
    df = spark.createDataFrame([(1, long, "x", 7)], "line_id bigint, species string, value string, ordinal int")
    out = split_packed(df, "species", "species")
    assert out.columns == ["line_id", "value", "ordinal", "species"]
    assert out.count() == 20000 and out.where("ordinal = 20000").first().species == "v49"
    assert split_packed(df.where("false"), "species").count() == 0


def test_helpers():
    assert pieces("a,(b,c),d") == [("a", ","), ("(b,c)", ","), ("d", "")]
    assert clean(' "a ""b""" ') == 'a "b"' and clean("'it''s'") == "it's" and clean("keld's") == "keld's"
    assert clean('"a" b') == '"a" b'


def test_values_with_many_separators_stay(spark):
    """No limit on the separators within a value; the parts of a longer value may be values themselves."""
    long, longer = "alpha&beta&gamma&delta", "alpha&beta&gamma&delta&epsilon"
    for value in (long, longer):
        got = split(spark, [f"{value}, x{i}" for i in range(300)])
        assert all(v == [(1, value), (2, f"x{i}")] for i, v in got.items())
    got = split(spark, [f"{longer}; {long}; y{i}" for i in range(150)] + [f"{long}; z{i}" for i in range(150)] + [f"{long} | {longer}"])
    assert got[5] == [(1, longer), (2, long), (3, "y5")] and got[300] == [(1, long), (2, longer)]


def test_unseen_values_follow_the_odds_of_their_separator(spark):
    """'/' stands within frequent values only, so that it does not cut a new one either; ',' does."""
    texts = [f"oak/ash mix, lot {i}" for i in range(80)] + [f"elm/fir mix; lot {i + 100}" for i in range(80)] + ["yew/box mix, lot 900"]
    got = split(spark, texts)
    assert got[3] == [(1, "oak/ash mix"), (2, "lot 3")] and got[160] == [(1, "yew/box mix"), (2, "lot 900")]
    assert got[100][0] == (1, "elm/fir mix")


def test_frequent_neighbours_are_cut(spark):
    """Two values that are frequent apart are not one value because they often meet."""
    texts = [f"oak, ash, w{i}" for i in range(40)] + [f"oak; v{i}" for i in range(400)] + [f"ash | u{i}" for i in range(400)]
    assert split(spark, texts)[2] == [(1, "oak"), (2, "ash"), (3, "w2")]


def test_fast_and_slow_cutting_agree():
    import random

    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("ab ,;/|&\t") for _ in range(rng.randrange(1, 20)))
        assert pieces(text + ",(x)")[:-1] == pieces(text.lstrip() + ",y")[:-1]
