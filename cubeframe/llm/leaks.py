"""Evaluation texts leaking into training text: pigeonhole edit matching with Myers' bit-parallel distance.

Texts become words (runs of letters and digits, without case, accents, Unicode form, invisible characters or line
breaks). A passage is a window of 12 or 24 successive words of a test item; it may be met with one edit (of a character or
of a space between words) less than it has times PIECE letters: one in 12 words of some 65 letters, four in 24.

1. Every passage is cut into as many pieces as its budget of edits plus one. The pieces are cut from the letters without
   spaces, so that joined or parted words break no more than one: a document that holds the passage within the budget holds
   a piece of it letter by letter. The items' pieces are a table (hash, item, place), made once.
2. One pass over the documents: hashes of their letters, at every place, that pass a Bloom filter of the pieces' hashes
   (of bounded size) leave as rows (document, hash, place). An equi-join with the table of pieces, broadcast only
   while it is counted to be small, gives hits; those of a document, an item and a diagonal are one row.
3. The documents with hits are joined with them. Of the passages that a hit touches, those that lack more three-letter
   sequences about the diagonal than their edits could break cannot be there; the others are verified in place with
   Myers' bit-parallel distance. Distance 0 means the same words.

Nothing but the filter passes through the driver, no text is shuffled, and more items mean more rows, not more passes.

Defined results: null texts hold nothing; an item of fewer words than the shortest passage has none; an item that leaks
several times into a document gives one row, its closest passage; documents of any length are searched whole; repeated
document or item ids with different texts count as one document or item with several texts; empty tables give empty
results.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from cubeframe.session import BROADCAST_BYTES, broadcast_if_small, checkpointed

#: Words of a passage; letters of a piece.
PASSAGES, PIECE = (12, 24), 24
#: Letters of the sequences that are counted before a passage is verified; an edit breaks as many of them.
SEQUENCE = 3
#: Bits of the filter for each piece, and at most.
FILTER_BITS, FILTER_MOST = 256, 1 << 28
#: Characters that are hashed at once.
BATCH = 4 << 20

_WORD = re.compile(r"[^\W_]+")
_B = 0x9E3779B97F4A7C15


def _fold(text: str) -> str:
    """Lower case, compatibility form; marks are still there."""
    t = text.replace("\\n", " ")
    if t.isascii():
        return t.lower()
    return unicodedata.normalize("NFKD", t).replace("ͅ", "").casefold()


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Of every code point: 1 letter or digit, 2 mark or format character (without a trace), 0 other."""
    kind = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        kind[i] = 2 if unicodedata.category(c) in ("Mn", "Mc", "Me", "Cf") else c.isalnum()
    return kind


def words(text: str) -> list[str]:
    kind = _kinds()
    return _WORD.findall("".join(c for c in _fold(text) if c.isascii() or kind[ord(c)] != 2))


class Letters:
    """Letters and digits of several texts, one after the other: chars, begins (of words), and where each text begins."""

    def __init__(self, texts: list[str]):
        folded = [_fold(t) for t in texts]
        whole = "\n".join(folded)
        a = np.frombuffer(whole.encode(), np.uint8) if whole.isascii() else np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _kinds()[a]
        at = np.cumsum([0, *(len(f) + 1 for f in folded)])
        if len(a) != len(whole):  # never, but for the encoders' promise
            raise ValueError("one code unit a character")
        if (kind == 2).any():
            there = kind != 2
            at = np.r_[0, np.cumsum(there)][np.minimum(at, len(there))]
            a, kind = a[there], kind[there]
        place = np.flatnonzero(kind == 1)
        self.chars = a[place]
        self.begins = np.r_[True, place[1:] != place[:-1] + 1][: len(place)]
        self.first = np.searchsorted(place, at)

    def hashes(self, size: int) -> np.ndarray:
        """Hash of every ``size`` successive letters: each sum of powers from two of half the length, the last two overlapping."""
        h, step = self.chars.astype(np.uint64) + np.uint64(1), 1
        while step < size:
            more = min(step, size - step)
            h = h[:-more] * np.uint64(pow(_B, step, 1 << 64)) + h[more:] if len(h) > more else h[:0]
            step += more
        h = (h ^ (h >> np.uint64(29)) ^ np.uint64(size)) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def sequences(self) -> np.ndarray:
        """A number for every SEQUENCE successive letters."""
        c, n = self.chars.astype(np.int64), max(len(self.chars) - SEQUENCE + 1, 0)
        return sum(c[k : k + n] << 21 * k for k in range(SEQUENCE)) if n else c[:0]

    def spaced(self) -> tuple[str, np.ndarray]:
        """The words with a space before each and one at the end, and the place in it of every letter."""
        at = np.arange(len(self.chars)) + np.cumsum(self.begins)
        out = np.full(len(self.chars) + int(self.begins.sum()) + 1, 32, np.uint32)
        out[at] = self.chars
        return out.tobytes().decode("utf-32-le", "surrogatepass"), at


@lru_cache(1 << 16)
def distance(pattern: str, text: str) -> int:
    """Least edit distance of the pattern to any stretch of the text (Myers 1999, one machine word of any width)."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << m - 1
    pv, mv, now, best = mask, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        if ph & high:
            now += 1
        elif mh & high:
            now -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        best = min(best, now)
    return best


def budget(letters: int, edits: int | None) -> int:
    """Edits that a passage of so many letters may be met with; edits: the same for all, else by length."""
    return max(letters // PIECE - 1, 0) if edits is None else min(edits, letters - 1)


class Item:
    """A test item: its passages (first word, words, first letter, letter after the last, budget) and their pieces."""

    def __init__(self, text: str, passages: tuple[int, ...], edits: int | None):
        self.letters = x = Letters([text])
        self.text, self.at = x.spaced()
        starts = np.r_[np.flatnonzero(x.begins), len(x.chars)]
        self.passages = [
            (s, n, int(starts[s]), int(starts[s + n]), budget(int(starts[s + n] - starts[s]), edits)) for n in passages for s in range(len(starts) - n)
        ]
        self.words, self.a, self.b, self.e = (np.array([p[k] for p in self.passages], np.int64) for k in (1, 2, 3, 4))
        self.most, self.sequences = int(self.e.max(initial=0)), x.sequences()

    def pieces(self) -> list[tuple[int, int]]:
        """(length that is hashed, place) of the pieces of all passages, each once."""
        out = set()
        for _, _, a, b, e in self.passages:
            size = (b - a) // (e + 1)
            hashed = PIECE if size >= PIECE else 1 << size.bit_length() - 1
            out.update((hashed, a + j * size) for j in range(e + 1))
        return sorted(out)


def _pieces(items: DataFrame, item: str, text: str, passages: tuple[int, ...], edits: int | None) -> DataFrame:
    """hash, size, item, at of every piece."""
    kind = items.schema[item].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                one = Item(t, passages, edits)
                places = one.pieces()
                for size in sorted({s for s, _ in places}):
                    at = np.array([a for s, a in places if s == size], np.int32)
                    h = one.letters.hashes(size)[at].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(at), size, np.int32)), pa.array([key] * len(at), arrow), pa.array(at)], names=["hash", "size", "item", "at"])

    plain = items.select(F.col(item).alias("item"), F.col(text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    return plain.mapInArrow(run, f"hash bigint, size int, item {kind.simpleString()}, at int")


def _filter(pieces: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the hashes with two probes, as 64-bit words; their number is bounded."""
    bits = 1 << 16
    while bits < min(n * FILTER_BITS, FILTER_MOST):
        bits *= 2
    probes = F.explode(F.array(F.col("hash").bitwiseAND(bits - 1), F.shiftrightunsigned("hash", 32).bitwiseAND(bits - 1))).alias("p")
    word = pieces.select(probes).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    set_ = word.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[set_.column("w").to_numpy()] = set_.column("b").to_numpy().view(np.uint64)
    return out


def _hits(docs: DataFrame, kind, filter_: np.ndarray, sizes: list[int]) -> DataFrame:
    """doc, hash, pos: places of the documents whose letters pass the filter."""
    shared, bits = docs.sparkSession.sparkContext.broadcast(filter_), np.uint64(len(filter_) * 64 - 1)
    arrow = to_arrow_type(kind)

    def passing(words_: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Places in h, by both probes."""
        at = np.arange(len(h))
        for shift in (0, 32):
            p = h[at] >> np.uint64(shift) & bits
            at = at[(words_[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)]
        return at

    def search(keys: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
        x = Letters(texts)
        for size in sizes:
            h = x.hashes(size)
            at = passing(shared.value, h)
            doc = np.searchsorted(x.first, at, "right") - 1
            ok = at + size <= x.first[doc + 1]
            at, doc = at[ok], doc[ok]
            # of letters that repeat with the same hash, the first and the last
            same = (at[1:] == at[:-1] + 1) & (h[at[1:]] == h[at[:-1]]) & (doc[1:] == doc[:-1])
            middle = np.zeros(len(at), bool)
            middle[1:-1] = same[:-1] & same[1:]
            at, doc = at[~middle], doc[~middle]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in doc], arrow), pa.array(h[at].view(np.int64)), pa.array((at - x.first[doc]).astype(np.int32))], names=["doc", "hash", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, n = [], [], 0
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py()
                keys.append(key)
                texts.append(t)
                n += len(t)
                if n >= BATCH:
                    yield from search(keys, texts)
                    keys, texts, n = [], [], 0
        if texts:
            yield from search(keys, texts)

    return docs.mapInArrow(run, f"doc {kind.simpleString()}, hash bigint, pos int")


@lru_cache(1 << 12)
def _item(text: str, passages: tuple[int, ...], edits: int | None) -> Item:
    return Item(text, passages, edits)


def _verify(doc: Letters, sequences: np.ndarray, text: str, at: np.ndarray, item: Item, diagonals: list[dict]) -> tuple[int, int, int] | None:
    """(edits, words of the passage, first word in the document) of the closest passage within its budget.

    diagonals: shift (place in the document less place in the item), lo and hi (places in the item of the first and last hit).
    """
    close, n = [], len(item.sequences)
    for d in diagonals:
        there = np.zeros(n, bool)
        for shift in range(d["shift"] - item.most, d["shift"] + item.most + 1):
            lo, hi = max(0, -shift), min(n, len(sequences) - shift)
            if lo < hi:
                there[lo:hi] |= item.sequences[lo:hi] == sequences[lo + shift : hi + shift]
        lost = np.r_[0, np.cumsum(~there)]
        lost = lost[np.maximum(item.b - SEQUENCE + 1, item.a)] - lost[np.minimum(item.a, n)]
        may = np.flatnonzero((lost <= SEQUENCE * item.e) & (item.a <= d["hi"]) & (item.b > d["lo"]))
        close += [(int(lost[k]), -int(item.words[k]), d["shift"], int(k)) for k in may]
    best = None
    for _, _, shift, k in sorted(close):
        a, b, e = int(item.a[k]), int(item.b[k]), int(item.e[k])
        limit = e if best is None else min(e, best[0] - 1)
        if limit < 0:
            break
        left, right = max(a + shift - e, 0), min(b - 1 + shift + e, len(doc.chars) - 1)
        if right < left:
            continue
        around = text[max(int(at[left]) - 1 - e, 0) : int(at[right]) + 2 + e]
        edits = distance(item.text[item.at[a] - 1 : item.at[b - 1] + 2], around)
        if edits <= limit:
            first = min(max(a + shift, 0), len(doc.chars) - 1)
            best = edits, int(item.words[k]), int(at[first] - first - 1)
    return best


def find_leaks(
    docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "item_text", passages: tuple[int, ...] = PASSAGES, edits: int | None = None
) -> DataFrame:
    """doc, item, edits, words, first_word: items of which a passage stands in a document within its budget of edits.

    edits: the fewest; words: those of the passage met so (of several the longest). edits=...: one budget for all passages.
    """
    kinds = docs.schema[doc].dataType, items.schema[item].dataType
    out = f"doc {kinds[0].simpleString()}, item {kinds[1].simpleString()}, edits int, words int, first_word int"
    named = lambda df: df.select(F.col("doc").alias(doc), F.col("item").alias(item), "edits", "words", "first_word")
    pieces = checkpointed(_pieces(items, item, item_text, passages, edits))
    n = pieces.count()
    if not n:
        return named(docs.sparkSession.createDataFrame([], out))
    sizes = sorted(r["size"] for r in pieces.select("size").distinct().collect())  # powers of two up to PIECE
    plain = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    hits = _hits(plain, kinds[0], _filter(pieces, n), sizes).join(broadcast_if_small(pieces.select("hash", "item", "at"), n, 40), "hash")
    diagonals = hits.groupBy("doc", "item", (F.col("pos") - F.col("at")).alias("shift")).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    met = diagonals.groupBy("doc", "item").agg(F.collect_list(F.struct("shift", "lo", "hi")).alias("diagonals"))
    texts = items.select(F.col(item).alias("item"), F.col(item_text).alias("item_text")).where("item_text IS NOT NULL")
    met = checkpointed(met.join(texts, "item").groupBy("doc").agg(F.collect_list(F.struct("item", "item_text", "diagonals")).alias("met")))
    size = met.agg(F.sum(F.lit(64) + F.aggregate("met", F.lit(0).cast("bigint"), lambda s, m: s + F.octet_length(m["item_text"]) + 40 * F.size(m["diagonals"])))).first()[0] or 0
    to = to_arrow_schema(docs.sparkSession.createDataFrame([], out).schema)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                d = Letters([row["text"]])
                sequences, (spaced, at) = d.sequences(), d.spaced()
                found = [(row["doc"], m["item"], *r) for m in row["met"] if (r := _verify(d, sequences, spaced, at, _item(m["item_text"], passages, edits), m["diagonals"])) is not None]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), to.types)], schema=to)

    rows = plain.join(F.broadcast(met) if size <= BROADCAST_BYTES else met, "doc").mapInArrow(check, out)
    best = rows.groupBy("doc", "item").agg(F.min(F.struct("edits", (-F.col("words")).alias("w"), "first_word")).alias("m"))
    return named(best.select("doc", "item", "m.edits", (-F.col("m.w")).alias("words"), "m.first_word"))
