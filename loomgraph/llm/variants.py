"""Spelling variants: words within one edit, found in forward and reversed sorted dictionaries.

One inserted, deleted or replaced code point leaves the first or the second half of a word intact. So each word stands
in a dictionary by its first half and in one by its second half; words that share a half form a block, and the sorted
dictionary is scanned block by block. A block of more than ``BLOCK`` words is divided: of what its words don't share,
one edit leaves again a half intact, so its words go on into blocks that share the first half of it and blocks that share
the second. Division ends by itself: at the last one a block's words differ in one code point of a bounded alphabet. No
block is capped, and each is compared whole in one task of bounded size, which sends on near pairs only.

Pairs of equal length (a replacement) and pairs whose lengths differ by one (an insertion) have dictionaries of their own.
A block by a second half takes only pairs that don't share the first, so each pair is found once.

A word's form is its near word of most occurrences, if it has ``RATIO`` times the word's own or more; forms of forms are
followed by doubling pointers, which takes as many rounds as the longest chain has binary digits.

Defined cases: a null text has no words; a null identifier is written as nothing before the colon; ties of forms go to
the word that is smaller by code points; repeated rows count again; words may have any length; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, staged, trimmed

RUN, EVERY, LEAST_LENGTH, LEAST_COUNT, RATIO, BLOCK = r"[A-Za-zÀ-ÿ]+", 199, 6, 5, 5, 512
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: lower-cased runs of letters of whole texts; in one of ``every`` occurrences, by hash, a code point is left out."""
    text, ident = F.col(f"`{text_col}`"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    runs = df.select(ident.alias("_id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("_run")).select("_id", F.translate("_run", _UPPER, _LOWER).alias("_run"))
    runs = runs.filter(F.length("_run") >= least_length).select("_run", F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")).alias("_h"))
    at = F.pmod(F.col("_h"), F.length("_run")).cast("int")
    cut = F.concat(F.substring(F.col("_run"), F.lit(1), at), F.substring(F.col("_run"), at + 2, F.length("_run")))
    found = runs.select(F.when(F.col("_h") % every == 0, cut).otherwise(F.col("_run")).alias("word"))
    return found.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def entries(vocabulary: DataFrame) -> DataFrame:
    """Both dictionaries: word, n, kind (r: replacement; i: insertion), s (length of the pair's shorter word), a and b (shared code points at either end), most (pairs share fewer at the start)."""
    length = F.length("word")
    kinds = [("r", length), ("i", length), ("i", length - 1)]
    halves = [F.struct(F.lit(kind).alias("kind"), s.alias("s"), a.alias("a"), b.alias("b"), most.alias("most")) for kind, s in kinds for half in [_half(kind, s)] for a, b, most in ((half, F.lit(0), s + 1), (F.lit(0), half, half))]
    return vocabulary.select("word", "n", F.explode(F.array(*halves)).alias("e")).select("word", "n", "e.*")


def _half(kind: str, middle):
    """Of a middle of so many code points, what one edit leaves intact at one end at least."""
    return F.floor(middle / 2).cast("int") if kind == "r" else F.ceil(middle / 2).cast("int")


def _divided(big: DataFrame) -> DataFrame:
    middle = F.col("s") - F.col("a") - F.col("b")
    half = F.when(F.col("kind") == "r", _half("r", middle)).otherwise(_half("i", middle))
    first = F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b"), F.col("most").alias("most"))
    second = F.struct(F.col("a").alias("a"), (F.col("b") + half).alias("b"), F.least(F.col("most"), F.col("a") + half).alias("most"))
    return big.select("word", "n", "kind", "s", F.explode(F.array(first, second)).alias("e")).select("word", "n", "kind", "s", "e.*")


def _shared():
    """What a block's words share: a string that sorts by the start, with the numbers that tell blocks of one string apart."""
    return F.concat_ws("\x00", F.substring(F.col("word"), F.lit(1), F.col("a")), F.substring(F.col("word"), F.length("word") - F.col("b") + 1, F.col("b")), F.concat_ws(",", "kind", "s", "a", "b", "most"))


def near_pairs(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n, near, near_n: every ordered pair of words (word, n) at one edit, once."""
    open_, scanned = staged(entries(vocabulary).withColumn("block", _shared()), "dictionary"), []
    while True:
        sizes = staged(open_.groupBy("block").agg(F.count("*").alias("_size")).filter("_size > 1"), "block-sizes")
        # A block whose words share all but what one edit may change isn't divided: the alphabet bounds it.
        last = (F.col("s") - F.col("a") - F.col("b")) <= F.when(F.col("kind") == "r", 1).otherwise(0)
        sized = staged(open_.join(sizes, "block").withColumn("_whole", (F.col("_size") <= block) | last), "sized")
        scanned.append(_scanned(sized.filter("_whole")))
        big = sized.filter("not _whole")
        if big.isEmpty():
            break
        open_ = staged(_divided(big).withColumn("block", _shared()), "dictionary")
    out = scanned[0]
    for more in scanned[1:]:
        out = out.union(more)
    return out


def _scanned(rows: DataFrame) -> DataFrame:
    """Near pairs of the blocks, each read in the order of the sorted dictionary."""
    columns = ["block", "word", "n", "kind", "s", "a", "b", "most"]

    def run(batches):
        held, block, about = [], None, None
        for batch in batches:
            found = []
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if row[0] != block:
                    found += _pairs(held, about)
                    held, block, about = [], row[0], row[3:]
                held.append(row[1:3])
            yield _sent(found)
        yield _sent(_pairs(held, about))

    dealt = rows.select(*columns).repartitionByRange(spread(rows), "block").sortWithinPartitions("block", "word")
    return dealt.mapInArrow(trimmed(run), "word string, n long, near string, near_n long")


def _sent(found: list) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64()) * 2, strict=True)], ["word", "n", "near", "near_n"])


def _middles(block: list, start: int, length: int) -> np.ndarray:
    """A row of code points for each word: what follows the first ``start``, so many."""
    joined = "".join(w[start : start + length] for w, _ in block).encode("utf-32-le")
    return np.frombuffer(joined, np.uint32).reshape(len(block), length)


def _pairs(block: list, about: tuple | None) -> list:
    """Both orders of each near pair of a block that shares fewer than ``most`` code points at the start."""
    if len(block) < 2:
        return []
    kind, s, a, b, most = about
    middle, found = s - a - b, []
    if kind == "r":
        rows = _middles(block, a, middle)
        for i in range(len(rows) - 1):
            unequal = rows[i + 1 :] != rows[i]
            near = np.flatnonzero((unequal.sum(axis=1) == 1) & (unequal.argmax(axis=1) + a < most))
            found += [(block[i], block[i + 1 + j]) for j in near.tolist()]
    else:
        short, long = ([w for w in block if len(w[0]) == n] for n in (s, s + 1))
        if short and long:
            # Whole rests: an insertion among equal code points may stand in several places, and what the start shares decides.
            rows, longer = _middles(short, a, s - a), _middles(long, a, s - a + 1)
            for i in range(len(rows)):
                start = _run(longer[:, :-1] == rows[i])
                end = _run((longer[:, 1:] == rows[i])[:, ::-1])
                near = np.flatnonzero((start + end >= s - a) & (start + a < most))
                found += [(short[i], long[j]) for j in near.tolist()]
    return [(*x, *y) for u, v in found for x, y in ((u, v), (v, u))]


def _run(equal: np.ndarray) -> np.ndarray:
    """How many values are true at the start of each row."""
    width = equal.shape[1]
    if not width:
        return np.zeros(len(equal), np.int64)
    return np.where(equal.all(axis=1), width, equal.argmin(axis=1))


def followed(forms: DataFrame) -> DataFrame:
    """word, root for each row word, form: the last of its forms; forms must rise in some order, so that no chain closes."""
    up = staged(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = up.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = staged(up.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "forms")
        up = moved.select("word", "root")
        if moved.filter("_moved").isEmpty():
            return up


def group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    vocabulary = staged(words(df, id_col, text_col, every, least_length, least_count), "vocabulary")
    best = F.min(F.struct(-F.col("near_n"), F.col("near")))
    near = staged(near_pairs(vocabulary, block).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("_best")).withColumn("_formed", -F.col("_best.col1") >= ratio * F.col("n")), "near")
    forms = near.filter("_formed").select("word", F.col("_best.near").alias("form"), (-F.col("_best.col1")).alias("form_n"))
    whole = vocabulary.join(near.select("word", "n_near"), "word", "left").join(forms, "word", "left").join(followed(forms), "word", "left")
    return whole.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
