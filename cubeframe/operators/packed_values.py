"""Several values packed in one field: split them into one value per row, position kept.

The column is its own dictionary. A field is a chain of pieces, the stretches between separator characters that stand
outside quotes and round brackets (quoted and bracketed spans are atomic). Expectation maximisation learns, from all
distinct fields, how often each value occurs and how often each separator character really separates; the Viterbi path of
a field's lattice then gives its values.

A separator is doubtful only where the column shows it within a recurring stretch: pieces a and b with the same
separator between them in far more fields than the frequencies of a, b and the separator explain (Poisson surprise above
the logarithm of all pieces, so that chance makes less than one such joint in the whole column). Runs of such joints,
however long, are the values with separators in them that compete with their parts. Fields without a doubtful joint and
without a separator character that mostly stands in such joints are certain: their pieces are their values and they only
add to the counts, so that lattices, expectation and Viterbi run over the doubtful fields alone. Values the column does
not show twice are spelled, piece by piece, at the same price whether cut or not; the separator's own odds decide.

Work is spread by value (frequencies), by joint and by field (lattices); the driver only sees one number per separator
character and the lengths of recurring stretches.

Defined results: null, empty and blank fields give no rows; empty positions use up their number and give no row;
repeated input rows give repeated output rows (the learning counts each distinct field once, so re-deliveries add no
evidence); an unclosed quote or bracket is an ordinary character; an apostrophe within a word is no quote.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cubeframe.session import broadcast_if_small, checkpointed

SEPARATORS = ",;/|\t\n&+·、，；"
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»", "„": "“", "‹": "›"}
BRACKETS = {"[": "]", "{": "}"}
#: Log probability of one character of a value that was never seen.
CHAR_LOGP = math.log(1 / 40)
#: Before the column is seen, a separator character counts as met so often as a separator, and so often within a value.
PRIOR = (4, 1)
#: Share of values not seen before, to begin with.
UNSEEN = 0.1
#: A joint is doubtful if its surprise exceeds the logarithm of all pieces by so much.
SURPRISE = 5.0

_PROTECTED = re.compile("[" + re.escape("".join({*QUOTES, "(", *BRACKETS})) + "]")
_PARSED = "struct<pieces:array<string>,values:array<string>,seps:array<string>>"


def _closing(s: str, i: int, dead: set) -> int:
    """Place of the quote that closes the one at i, or -1. dead: quotes known to have no closing one further on."""
    q, close, n, j = s[i], QUOTES[s[i]], len(s), i + 1
    if q in dead:
        return -1
    while j < n:
        c = s[j]
        if c == "\\" and j + 1 < n:
            j += 2
        elif c != close:
            j += 1
        elif close == q and j + 1 < n and s[j + 1] == q and not (j == i + 1 and (j + 2 >= n or s[j + 2] != q)):
            j += 2  # doubled; but two quotes that open a value and stand alone are an empty value
        elif q in "'‘" and j + 1 < n and s[j + 1].isalnum():
            j += 1  # an apostrophe
        else:
            return j
    dead.add(q)
    return -1


def _round_brackets(s: str) -> dict[int, int]:
    stack, match = [], {}
    for i, c in enumerate(s):
        if c == "(":
            stack.append(i)
        elif c == ")" and stack:
            match[stack.pop()] = i
    return match


def _without_list_brackets(s: str) -> str:
    """s without the one pair of list brackets that encloses all of it."""
    if len(s) < 2 or BRACKETS.get(s[0]) != s[-1]:
        return s
    depth = 0
    for i, c in enumerate(s):
        depth += (c == s[0]) - (c == s[-1])
        if depth == 0:
            return s[1:-1].strip() if i == len(s) - 1 else s
    return s


def pieces(text: str, separators: str = SEPARATORS) -> list[tuple[str, str]]:
    """The stretches between unprotected separators, each with the separator that ends it ('' at the end)."""
    s = text.strip()
    if not _PROTECTED.search(s):
        cut = re.split("([" + re.escape(separators) + "])", s)
        return list(zip(cut[::2], [*cut[1::2], ""]))
    s = _without_list_brackets(s)
    match, dead, out = _round_brackets(s), set(), []
    start, i, fresh = 0, 0, True
    while i < len(s):
        c = s[i]
        if c in separators:
            out.append((s[start:i], c))
            start, fresh = i + 1, True
        elif c in QUOTES and (fresh or (c not in "'‘" and not s[i - 1].isalnum())):
            i, fresh = max(i, _closing(s, i, dead)), False
        elif c == "(":
            i, fresh = match.get(i, i), False
        elif not c.isspace():
            fresh = False
        i += 1
    out.append((s[start:], ""))
    return out


def clean(value: str) -> str:
    """A value without outer white space and outer quotes; quotes inside the quotes stand for one."""
    v = value.strip()
    if len(v) < 2 or v[0] not in QUOTES or _closing(v, 0, set()) != len(v) - 1:
        return v
    q, close = v[0], QUOTES[v[0]]
    inner, out, i = v[1:-1], [], 0
    while i < len(inner):
        c, after = inner[i], inner[i + 1 : i + 2]
        if (c == "\\" and after and (after in QUOTES or after in QUOTES.values())) or (c == after and c in (q, close) and c in "\"'"):
            out.append(after)
            i += 2
        else:
            out.append(c)
            i += 1
    return "".join(out).strip()


def _parse(separators: str):
    """Column function: raw pieces, cleaned values and separators of a field."""

    @F.arrow_udf(_PARSED)
    def parse(fields: pa.Array) -> pa.Array:
        raw, values, seps, at = [], [], [], [0]
        for text in fields.to_pylist():
            for piece, sep in pieces(text, separators) if text is not None else ():
                raw.append(piece)
                values.append(clean(piece))
                seps.append(sep)
            at.append(len(raw))
        # as many separators as pieces, the last one empty
        lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(c, pa.string())) for c in (raw, values, seps)]
        return pa.StructArray.from_arrays(lists, names=["pieces", "values", "seps"])

    return parse


def _not_blank(field: str) -> Column:
    return F.col(field).isNotNull() & (F.trim(F.col(field)) != "")


def _keys(values: Column, seps: Column) -> list[Column]:
    """fk, vk, len: the key of a field, the keys of its values and their lengths."""
    low = F.transform(values, F.lower)
    return [F.xxhash64(low, seps).alias("fk"), F.transform(low, lambda v: F.xxhash64(v)).alias("vk"), F.transform(values, F.length).alias("len")]


def _joints() -> Column:
    """Array of (i, lk, sep, rk): the separators between two values that are not empty."""
    one = lambda i: F.struct(i.alias("i"), F.col("vk")[i].alias("lk"), F.col("seps")[i].alias("sep"), F.col("vk")[i + 1].alias("rk"))
    inner = F.when(F.size("vk") > 1, F.sequence(F.lit(0), F.size("vk") - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(inner, lambda i: (F.col("len")[i] > 0) & (F.col("len")[i + 1] > 0)), one)


def _stretch_key(values: list[int], seps: list[str]) -> int:
    """Key of a value of several pieces, from the keys of the pieces and the separators between them."""
    text = " ".join(f"{v}{s}" for v, s in zip(values, [*seps, ""]))
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


def _runs(strong: list[int]) -> list[tuple[int, int]]:
    """(first, last + 1) piece of the maximal runs of doubtful joints; joint i stands after piece i."""
    out = []
    for i in sorted(strong):
        if out and out[-1][1] == i + 1:
            out[-1][1] = i + 2
        else:
            out.append([i, i + 2])
    return [tuple(r) for r in out]


def _each(rows: DataFrame, f: Callable[[dict], Iterator[tuple]], schema: str) -> DataFrame:
    """f over rows (as dicts), each giving tuples of the schema."""
    to = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [t for row in batch.to_pylist() for t in f(row)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), to.types)], schema=to)

    return rows.mapInArrow(run, schema)


def _add(*x: float) -> float:
    m = max(x)
    return m if m == -math.inf else m + math.log(sum(math.exp(v - m) for v in x))


@dataclass
class _Lattice:
    """A field's pieces 0..n-1 between nodes 0..n: log weights of known values (i, j, weight, key), of spelling each piece, of
    keeping and of cutting the separator after it."""

    n: int
    known: list[tuple[int, int, float, int]]
    spell: list[float]
    keep: list[float]
    cut: list[float]

    @staticmethod
    def of(row: dict, cut: dict[str, float], total: float, unseen: float) -> _Lattice:
        n, seps = len(row["vk"]), row["seps"]
        log = lambda p: math.log(max(1e-12, p))
        keep = [log(1 - cut[c]) for c in seps[:-1]]
        inside = [0.0]
        for k in keep:
            inside.append(inside[-1] + k)
        ends = [(i, i + 1, v) for i, v in enumerate(row["vk"])] + [(e["i"], e["j"], e["key"]) for e in row["multi"] or ()]
        known = [(i, j, math.log(c / total) + inside[j - 1] - inside[i], v) for (i, j, v), c in zip(ends, row["ns"]) if c > 0]
        spell = [math.log(unseen) + k * CHAR_LOGP for k in row["len"]]
        return _Lattice(n, known, spell, keep, [*(log(cut[c]) for c in seps[:-1]), 0.0])

    def posterior(self) -> tuple[dict[int, float], list[float]]:
        """Forward-backward: (expected number of each value, probability of each cut)."""
        n, ends, starts = self.n, {}, {}
        for edge in self.known:
            ends.setdefault(edge[1], []).append(edge)
            starts.setdefault(edge[0], []).append(edge)
        f, inside = [0.0] + [-math.inf] * n, [-math.inf] * (n + 1)  # at a boundary; within a spelled value
        for i in range(n):
            inside[i + 1] = _add(f[i], inside[i] + (self.keep[i - 1] if i else 0.0)) + self.spell[i]
            f[i + 1] = _add(inside[i + 1], *(f[e[0]] + e[2] for e in ends.get(i + 1, ()))) + self.cut[i]
        b, rest = [-math.inf] * n + [0.0], [-math.inf] * n + [0.0]
        for i in range(n - 1, -1, -1):
            if i + 1 < n:
                rest[i + 1] = _add(self.cut[i] + b[i + 1], self.keep[i] + self.spell[i + 1] + rest[i + 2])
            b[i] = _add(self.spell[i] + rest[i + 1], *(e[2] + self.cut[e[1] - 1] + b[e[1]] for e in starts.get(i, ())))
        p = lambda i, j, w: math.exp(min(0.0, f[i] + w + self.cut[j - 1] + b[j] - b[0]))
        of: dict[int, float] = {}
        for i, j, w, v in self.known:
            of[v] = of.get(v, 0.0) + p(i, j, w)
        return of, [math.exp(min(0.0, f[i] + b[i] - b[0])) for i in range(1, n)]

    def spelled_alone(self, vk: list[int], of: dict[int, float], cuts: list[float]) -> None:
        """Add what a piece counts for when it is spelled and cut on both sides: whatever the cuts leave over."""
        seen = {i for i, j, _, _ in self.known if j == i + 1}
        for i, v in enumerate(vk):
            if i not in seen:
                of[v] = of.get(v, 0.0) + min(cuts[i - 1] if i else 1.0, cuts[i] if i < self.n - 1 else 1.0)

    def best(self) -> list[int]:
        """Viterbi: the first pieces of the values."""
        n, ends = self.n, {}
        for edge in self.known:
            ends.setdefault(edge[1], []).append(edge)
        f, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        inside, began = -math.inf, 0
        for i in range(n):
            on = inside + (self.keep[i - 1] if i else 0.0)
            inside, began = (f[i], i) if f[i] >= on else (on, began)
            inside += self.spell[i]
            f[i + 1], back[i + 1] = max([(inside, began), *((f[e[0]] + e[2], e[0]) for e in ends.get(i + 1, ()))])
            f[i + 1] += self.cut[i]
        starts, j = [], n
        while j > 0:
            j = back[j]
            starts.append(j)
        return starts[::-1]


@dataclass
class Learnt:
    """values: vk, n (fields beyond the first) of the values met; cut: the chance that a separator character separates;
    paths: fk, starts of the fields whose values are not their pieces; n_paths: how many these are."""

    values: DataFrame
    cut: dict[str, float]
    total: float
    unseen: float
    paths: DataFrame | None
    n_paths: int


def learn(df: DataFrame, field: str, separators: str = SEPARATORS, iterations: int = 3) -> Learnt:
    """Expectation maximisation over all distinct fields.

    It starts from the count of every stretch, so that a value with a separator in it competes with its parts. A field
    counts a value once at most, and a value's count is discounted by one: what a single field shows is no evidence.
    """
    parsed = df.where(_not_blank(field)).select(_parse(separators)(F.col(field)).alias("p")).select(*_keys(F.col("p.values"), F.col("p.seps")), "p.seps")
    fields = checkpointed(parsed.dropDuplicates(["fk"]))
    singles = checkpointed(fields.select(F.explode(F.array_distinct("vk")).alias("vk")).groupBy("vk").agg(F.count("*").alias("c")))
    n_values, total, beyond = singles.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(F.col("c") - 1), F.lit(0))).first()
    occurs = {r["s"]: r["c"] for r in fields.select(F.explode("seps").alias("s")).where("s <> ''").groupBy("s").agg(F.count("*").alias("c")).collect()}  # one row per separator character
    share = lambda c, cuts: (cuts + PRIOR[0]) / (occurs.get(c, 0) + sum(PRIOR))
    plain = {c: share(c, occurs.get(c, 0)) for c in separators}
    unseen = lambda t, n: max(t - n, 1.0) / max(t, 1.0)
    values = singles.select("vk", (F.col("c") - 1.0).alias("n")).where("n > 0")

    # doubtful joints
    if not occurs:
        return Learnt(values, plain, float(max(total, 1)), unseen(total, beyond), None, 0)
    every = float(sum(occurs.values()))
    met = fields.select(F.explode(F.array_distinct(F.transform(_joints(), lambda j: F.struct(j["lk"], j["sep"], j["rk"])))).alias("j")).select("j.lk", "j.sep", "j.rk")
    met = met.groupBy("lk", "sep", "rk").agg(F.count("*").alias("c")).where("c > 1")
    side = broadcast_if_small(singles, n_values, 40)
    met = met.join(side.select(F.col("vk").alias("lk"), F.col("c").alias("a")), "lk").join(side.select(F.col("vk").alias("rk"), F.col("c").alias("b")), "rk")
    often = F.create_map(*(F.lit(x) for c, n in occurs.items() for x in (c, n / every)))
    met = met.withColumn("e", F.col("a") * F.col("b") / F.lit(float(total)) * often[F.col("sep")])
    strong = checkpointed(met.where((F.col("c") > F.col("e")) & (F.col("c") * F.log(F.col("c") / F.col("e")) - F.col("c") + F.col("e") > math.log(total) + SURPRISE)).select("lk", "sep", "rk", "c"))
    within = {r["sep"]: r["c"] for r in strong.groupBy("sep").agg(F.sum("c").alias("c")).collect()}  # one row per separator character
    if not within:
        return Learnt(values, plain, float(total), unseen(total, beyond), None, 0)

    # doubtful fields
    n_strong = strong.count()
    hit = fields.select("fk", F.explode(_joints()).alias("j")).select("fk", "j.*").join(broadcast_if_small(strong.drop("c"), n_strong, 60), ["lk", "sep", "rk"])
    hit = hit.groupBy("fk").agg(F.collect_set("i").alias("strong"))
    mostly = [c for c, n in within.items() if share(c, occurs[c] - n) < 0.5]
    doubtful = fields.join(hit, "fk", "left").where(F.col("strong").isNotNull() | F.arrays_overlap("seps", F.array(*map(F.lit, mostly)).cast("array<string>")))
    doubtful = checkpointed(doubtful.withColumn("strong", F.coalesce("strong", F.array().cast("array<int>"))))

    # stretches: the runs of doubtful joints, and wherever they stand within longer ones
    def longest(row: dict) -> Iterator[tuple]:
        for i, j in _runs(row["strong"]):
            yield _stretch_key(row["vk"][i:j], row["seps"][i : j - 1]), j - i

    stretch = checkpointed(_each(doubtful, longest, "key bigint, n int").distinct())
    lengths = sorted(r["n"] for r in stretch.select("n").distinct().collect())  # bounded by the longest field
    n_stretch = stretch.count()

    def windows(row: dict) -> Iterator[tuple]:
        for first, last in _runs(row["strong"]):
            for k in lengths:
                for i in range(first, last - k + 1):
                    yield row["fk"], i, i + k, _stretch_key(row["vk"][i : i + k], row["seps"][i : i + k - 1])

    multi = _each(doubtful, windows, "fk bigint, i int, j int, key bigint").join(broadcast_if_small(stretch.select("key"), n_stretch, 30), "key", "left_semi")
    multi = multi.groupBy("fk").agg(F.array_sort(F.collect_list(F.struct("i", "j", "key"))).alias("multi"))
    lattice = checkpointed(doubtful.drop("strong").join(multi, "fk", "left"))

    # what the certain fields contribute stays as it is
    keys = F.concat("vk", F.coalesce(F.col("multi.key"), F.array().cast("array<bigint>")))
    there = lattice.select(F.explode(F.array_distinct(keys)).alias("vk")).groupBy("vk").agg(F.count("*").alias("d"))
    state = there.join(broadcast_if_small(singles, n_values, 40), "vk", "left")
    state = checkpointed(state.select("vk", F.coalesce(F.col("c") - F.col("d"), F.lit(0)).cast("double").alias("base"), F.coalesce("c", "d").cast("double").alias("n"), F.col("c").isNotNull().alias("single"), "d"))
    n_state, base, theirs = state.agg(F.count("*"), F.sum("base"), F.coalesce(F.sum(F.when(F.col("single"), F.col("n") - 1)), F.lit(0.0))).first()
    gone = lattice.select(F.explode(F.array_distinct("vk"))).count()
    certain, certain_beyond = float(total - gone), float(beyond - theirs)
    apart = {r["s"]: r["c"] for r in lattice.select(F.explode("seps").alias("s")).where("s <> ''").groupBy("s").agg(F.count("*").alias("c")).collect()}

    cut = dict.fromkeys(separators, PRIOR[0] / sum(PRIOR))
    now, all_, left = state.select("vk", "base", F.greatest(F.col("n") - 1.0, F.lit(0.0)).alias("n")), float(total), UNSEEN

    def weighed(now: DataFrame) -> DataFrame:
        """The lattices with ns, the counts of their values and stretches."""
        long = lattice.select("fk", F.posexplode(keys).alias("e", "vk")).join(broadcast_if_small(now.select("vk", "n"), n_state, 40), "vk")
        return lattice.join(long.groupBy("fk").agg(F.array_sort(F.collect_list(F.struct("e", "n"))).alias("es")), "fk").withColumn("ns", F.col("es.n")).drop("es")

    for _ in range(iterations):

        def expect(row: dict, cut=dict(cut), all_=all_, left=left) -> Iterator[tuple]:  # noqa: B006
            x = _Lattice.of(row, cut, all_, left)
            of, cuts = x.posterior()
            x.spelled_alone(row["vk"], of, cuts)
            for v, p in of.items():
                yield v, None, min(p, 1.0)
            for c, p in zip(row["seps"], cuts):
                yield None, c, p

        sums = checkpointed(_each(weighed(now), expect, "vk bigint, sep string, p double").groupBy("vk", "sep").agg(F.sum("p").alias("p")))
        cuts = {r["sep"]: r["p"] for r in sums.where("sep IS NOT NULL").collect()}  # one row per separator character
        cut = {c: share(c, occurs.get(c, 0) - apart.get(c, 0) + cuts.get(c, 0.0)) for c in separators}
        now = state.select("vk", "base").join(sums.where("vk IS NOT NULL").select("vk", "p"), "vk", "left")
        now = checkpointed(now.select("vk", "base", F.coalesce("p", F.lit(0.0)).alias("p"), F.greatest(F.col("base") + F.coalesce("p", F.lit(0.0)) - 1.0, F.lit(0.0)).alias("n")))
        p, n = now.agg(F.sum("p"), F.sum("n")).first()
        all_ = max(certain + p, 1.0)
        left = unseen(all_, certain_beyond + n)

    def choose(row: dict) -> Iterator[tuple]:
        starts = _Lattice.of(row, cut, all_, left).best()
        if len(starts) < len(row["vk"]):
            yield row["fk"], starts

    paths = checkpointed(_each(weighed(now), choose, "fk bigint, starts array<int>"))
    values = singles.join(now.select("vk", F.col("n").alias("n2")), "vk", "full").select("vk", F.coalesce("n2", F.col("c") - 1.0).alias("n")).where("n > 0")
    return Learnt(values, cut, all_, left, paths, paths.count())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _joined(raw: pa.Array, seps: pa.Array, starts: pa.Array) -> pa.Array:
    """The values that begin at the given pieces; null where there are none given."""
    out = []
    for p, s, first in zip(raw.to_pylist(), seps.to_pylist(), starts.to_pylist()):
        ends = None if first is None else [*first[1:], len(p)]
        out.append(None if first is None else [clean("".join(p[k] + s[k] * (k < j - 1) for k in range(i, j))) for i, j in zip(first, ends)])
    return pa.array(out, pa.list_(pa.string()))


def split_packed(df: DataFrame, field: str, out: str = "value", separators: str = SEPARATORS, iterations: int = 3) -> DataFrame:
    """df's other columns, ordinal (from 1) and the value, one row per non-empty value.

    The row's own columns are kept; the packed field is replaced by ordinal and ``out``. Columns of those names in the
    input are overwritten. Rows are cut where they lie, only those of the few fields with a path of their own look it up.
    """
    learnt = learn(df, field, separators, iterations)
    keep = [c for c in df.columns if c not in {field, "ordinal", out}]
    rows = df.where(_not_blank(field)).select(*keep, _parse(separators)(F.col(field)).alias("_cf_p"))
    values = F.col("_cf_p.values")
    if learnt.n_paths:
        rows = rows.withColumn("_cf_fk", _keys(values, F.col("_cf_p.seps"))[0])
        paths = broadcast_if_small(learnt.paths.select(F.col("fk").alias("_cf_fk"), F.col("starts").alias("_cf_starts")), learnt.n_paths, 400)
        rows = rows.join(paths, "_cf_fk", "left")
        values = F.coalesce(_joined(F.when(F.col("_cf_starts").isNotNull(), F.col("_cf_p.pieces")), F.col("_cf_p.seps"), F.col("_cf_starts")), values)
    exploded = rows.select(*keep, F.posexplode(values).alias("_cf_i", out)).where(F.col(out) != "")
    return exploded.select(*keep, (F.col("_cf_i") + 1).alias("ordinal"), out)
