import random

import numpy as np
import pytest

from cubeframe.llm import pieces


def check(text, cell_starts, limit, overlap):
    found = {}
    for cell, k, n, a, b, size in pieces.split_text(text, cell_starts, limit, overlap):
        assert size == len(text[a:b].encode()) <= limit
        found.setdefault(cell, []).append((k, n, a, b))
    starts = [s for s in (cell_starts or []) if s is not None]
    bounds = {0: (0, len(text))} | {k: (s, e) for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(text)]), 1)}
    for cell, (s, e) in bounds.items():
        if len(text[s:e].encode()) <= limit:
            assert cell not in found
            continue
        p = found[cell]
        assert [k for k, *_ in p] == list(range(1, len(p) + 1)) and {n for _, n, *_ in p} == {len(p)}
        assert p[0][2] == s and p[-1][3] == e
        for (*_, _, b1), (*_, a2, b2) in zip(p, p[1:]):
            again = len(text[a2:b1].encode())
            assert overlap <= again <= overlap + 3 and b2 > b1
        least = 1 + -(-(len(text[s:e].encode()) - limit) // (limit - overlap))
        assert len(p) <= 2 * least + 1
    return found


@pytest.mark.parametrize("alphabet", ["ab \n.", "aé漢😀 \n", "x", "漢"])
def test_limits_overlap_and_round_trip(alphabet):
    rng = random.Random(len(alphabet))
    for n in (1, 63, 64, 65, 200, 1000, 3000):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        starts = sorted({0, *(rng.randrange(n) for _ in range(3))})
        check(text, starts, 64, 8)


def test_cuts_at_boundaries():
    cells = ["# heading " + "word " * 250 for _ in range(8)]
    text = "".join(c + "\n\n" for c in cells)
    starts = np.r_[0, np.cumsum([len(c) + 2 for c in cells])][:-1].tolist()
    p = check(text, starts, 4096, 128)[0]
    assert all(b in starts for *_, b in p[:-1])
    lines = "\n".join("x" * 70 for _ in range(200))
    p = check(lines, [0], 4096, 128)[0]
    assert all(lines[b - 1] == "\n" for *_, b in p[:-1])


def test_spark_operator(spark):
    big = "line of text\n" * 1000
    rows = [(1, big, [0, 20, 9000], 1), (2, "short", [0], 1), (3, None, None, 1), (4, "é" * 4000, None, 1), (5, "", [], 1), (6, big, [0, None, 50], 1), (1, big, [0, 20, 9000], 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, cell_starts array<int>, piece int")
    out = pieces.split_oversized(df).collect()
    assert {(r.doc_id, r.cell_no) for r in out} == {(1, 0), (1, 2), (4, 0), (6, 0), (6, 3)}
    texts = {1: big, 4: "é" * 4000, 6: big}
    assert all(r.text == texts[r.doc_id][r.char_from : r.char_to] and len(r.text.encode()) == r.n_tokens <= 4096 for r in out)
    assert len([r for r in out if r.doc_id == 1]) == 2 * len({(r.cell_no, r.piece) for r in out if r.doc_id == 1})
    assert pieces.split_oversized(df.where("false")).count() == 0


def test_an_overlap_that_leaves_no_room_is_refused(spark):
    docs = spark.createDataFrame([(1, "x" * 100, [0])], "doc_id bigint, text string, cell_starts array<int>")
    for limit, overlap in ((10, 10), (10, 3), (10, -1), (8, 1)):
        with pytest.raises(ValueError):
            pieces.split_oversized(docs, limit=limit, overlap=overlap)
    for limit, overlap in ((10, 2), (9, 0), (40, 32)):
        rows = pieces.split_oversized(docs, limit=limit, overlap=overlap).where("cell_no = 0").orderBy("piece").collect()
        assert rows[0].char_from == 0 and rows[-1].char_to == 100 and all(r.n_tokens <= limit for r in rows)
        assert all(a.char_to - b.char_from >= overlap for a, b in zip(rows, rows[1:]))
