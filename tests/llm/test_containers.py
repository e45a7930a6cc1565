import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeframe.llm import containers as c
from cubeframe.llm.tokens import n_tokens


def check(placed, sizes, capacity):
    loads, seen = {}, {}
    for r in placed:
        if r.n_tokens:
            loads[r.container] = loads.get(r.container, 0) + r.n_tokens
        seen.setdefault(r.doc_id, []).append((r.token_from, r.n_tokens))
    assert max(loads.values(), default=0) <= capacity
    assert set(seen) == set(sizes)
    for d, parts in seen.items():
        parts.sort()
        n = max(sizes[d] or 0, 0)
        assert sum(k for _, k in parts) == n
        assert len(parts) == 1 or n > capacity
        assert [a for a, _ in parts] == [capacity * i for i in range(len(parts))]
    return len(loads)


@pytest.mark.parametrize("seed", range(3))
def test_fill_is_whole_and_tight(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {i: int(s) for i, s in enumerate(np.r_[np.minimum(rng.lognormal(3, 1.2, 600), 450), [100, 101, 200, 250, 999]].astype(int))}
    df = spark.createDataFrame([(k, v, "x") for k, v in sizes.items()], "doc_id bigint, size int, container string")
    used = check(c.fill(df, "doc_id", "size", 100).collect(), sizes, 100)
    assert used <= 1.02 * sum(sizes.values()) / 100 + 1


def test_plan_matches_best_fit_over_single_items():
    """The plan over counts uses no more containers than best-fit decreasing item by item."""
    rng = np.random.default_rng(1)
    for capacity in (10, 37):
        items = rng.integers(1, capacity + 1, 300)
        rooms = []
        for s in sorted(items, reverse=True):
            fit = [r for r in rooms if r >= s]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - s)
            else:
                rooms.append(capacity - s)
        hist = dict(zip(*np.unique(items, return_counts=True)))
        slots = c.plan({int(k): int(v) for k, v in hist.items()}, capacity)
        assert sum(last - first for _, first, last, _, _ in slots) == 300
        assert len({box + i // each for _, first, last, box, each in slots for i in range(last - first)}) == len(rooms)


def test_one_length_for_a_third_and_repeats(spark):
    df = spark.range(3000).select((F.col("id") % 1500).alias("doc_id"), F.when(F.col("id") % 3 == 0, 30).otherwise((F.col("id") % 1500) % 90).cast("int").alias("size"))
    rows = c.fill(df, "doc_id", "size", 100).collect()
    loads = {}
    for r in rows:
        loads[r.container] = loads.get(r.container, 0) + r.n_tokens
    assert len(rows) == 3000 and max(loads.values()) <= 100


def test_null_empty_and_no_items(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, 7)], "doc_id bigint, size int")
    assert sorted((r.doc_id, r.n_tokens, r.container) for r in c.fill(df.fillna(0), "doc_id", "size", 10).collect()) == [(1, 0, 0), (2, 0, 0), (3, 7, 0)]
    assert c.fill(df.where("false"), "doc_id", "size", 10).count() == 0
    usage = c.usage(c.fill(df.fillna(0), "doc_id", "size", 10), 10).first()
    assert tuple(usage) == (1, 7, 1, 7)


def test_token_counts(spark):
    from cubeframe.llm.tokens import FOLDER, encoding

    texts = ["", "hello world", "ünïcode 漢字", "<|endoftext|>", "a" * 50000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.n for r in df.select("i", n_tokens(F.col("t"), "byt5").alias("n")).orderBy("i").collect()]
    assert got == [len((t or "").encode()) for t in texts]
    enc = encoding("byte_bpe_50k", FOLDER)
    got = [r.n for r in df.select("i", n_tokens(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
