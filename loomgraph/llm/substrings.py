"""Removal of repeated substrings by a Burrows-Wheeler transform, with threshold-bounded interval expansion.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too. Corpus-sized work is cut into
independent pieces first: the least hash of the short strings inside a window (its anchor) depends on the window alone,
so equal windows have equal anchors. Runs of window starts with one anchor are items, kept as hashes and offsets. Items
with equal contents are repeats as a whole, whatever their number, and are counted, never gathered. What remains is
one item for each distinct content of an anchor that has several, and single items whose windows may equal each other
(equal windows at two places put the string behind the anchor at two places): their bytes are fetched and meet by anchor.

There, pieces of bounded size are concatenated, each with an end mark of its own, and their suffixes sorted. From the
transform, intervals of equal prefixes are extended backward, breadth first: strings of m bytes settle the common
prefixes of m - 1, in increasing order. Expansion stops at ``length``: neighbours in suffix order whose common prefix
is unsettled by then share ``length`` bytes or more.

An anchor whose distinct contents together pass ``GROUP_BYTES`` (a passage in a great many settings) is divided: its
windows get a second anchor from the strings at both of their ends, which again depends on the window alone, and runs
of windows that agree in it are items of their own, of which equal contents are counted and the rest meets in the transform
by both anchors. What is still too much is divided by ever fewer strings at the ends, down to one: there an item is one
window (or a period of one byte), which equals another only as a whole.

Defined cases: a null text counts as empty; a text shorter than ``length`` is never touched; rows repeated with their
identifier are rows of their own, so they are repeats of each other; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spread, staged, trimmed

LENGTH, GRAM, RUN, PIECE_BYTES, GROUP_BYTES = 400, 48, 512, 2 << 20, 4 << 20
ENDS = (128, 32, 8, 1)  # strings at either end of a window that make its further anchors
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


# Items


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place; by doubling, so in a few passes."""
    one = (data.astype(np.uint64) + np.uint64(1)) * _MIX
    one ^= one >> np.uint64(29)
    made, size, power = None, 0, {1: _BASE}
    part, width = one, 1
    while True:
        if gram & width:
            if made is None:
                made, size = part, width
            else:  # made holds the lower bits: put them after this part
                n = len(data) - size - width + 1
                made, size = part[:n] * power[size] + made[width : width + n], size + width
        if size == gram:
            break
        n = len(part) - width
        part = part[:n] * power[width] + part[width : width + n]
        width *= 2
        power |= {k: np.uint64(pow(int(_BASE), k, 1 << 64)) for k in (width, size)}
    made = made * _MIX
    return made ^ (made >> np.uint64(32))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, values
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(out) - (width - size)], out[width - size :]) if width > size else out


def items(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, run: int = RUN) -> list[np.ndarray]:
    """Arrays of: number of the text, first and last window start of the item, anchor, and whether the string behind the
    anchor stands in the item more than once; over all texts in order."""
    gram = min(gram, length)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not (sizes >= length).any():
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64), np.zeros(0, bool)]
    hashes = _gram_hashes(data, gram)
    anchor = _least(hashes, length - gram + 1)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
    place = np.arange(len(anchor)) - starts[owner]
    valid = place <= sizes[owner] - length
    first = valid & np.concatenate([[True], (owner[1:] != owner[:-1]) | (anchor[1:] != anchor[:-1])])
    at = np.flatnonzero(first)
    # An item ends before the next one, or where its text has no more windows.
    stop = np.minimum(np.append(at[1:], len(anchor)), (starts + sizes - length + 1)[owner[at]])
    pieces = -(-(stop - at) // run)
    again = np.repeat(np.arange(len(at)), pieces)
    nth = np.arange(len(again)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    low = at[again] + nth * run
    high = np.minimum(low + run, stop[again])
    own = owner[low]
    within = length - gram
    twice = [np.count_nonzero(hashes[a : b + within] == m) > 1 for a, b, m in zip(low.tolist(), high.tolist(), anchor[low], strict=True)]
    return [own, low - starts[own], high - 1 - starts[own], anchor[low], np.array(twice, bool)]


# The transform


def suffixes(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix order of concatenated pieces. ``codes``: byte + 1, and 0 at the end mark after each piece (at ``ends``).

    End marks are below all bytes and ordered by place. Seven codes sort first; then only suffixes that tie are sorted
    again, by the ranks of what follows, twice as far each time.
    """
    n = len(codes)
    wide = np.concatenate([codes.astype(np.int64), np.zeros(8, np.int64)])
    piece = np.searchsorted(ends, np.arange(n))
    left = ends[piece] - np.arange(n)  # codes before the end mark
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = (key << 9) + np.where(left > k, wide[k : k + n], 0)
    del wide
    order = np.argsort(key)
    # Suffixes that end within the seven are told apart by their end marks, that is by place.
    short = np.flatnonzero(left[order] < 7)
    members = order[short]
    order[short] = members[np.lexsort((members, key[members]))]
    same = key[order[1:]] == key[order[:-1]]
    same &= left[order[1:]] >= 7
    rank = np.empty(n, np.int64)
    head = np.maximum.accumulate(np.where(np.append(True, ~same), np.arange(n), 0))
    rank[order] = head
    depth = 7
    tied = np.append(False, same) | np.append(same, False)
    where = np.flatnonzero(tied)
    while len(where):
        group, members = head[where], order[where]
        beyond = rank[members + depth]
        sort = np.argsort((group << 32) + beyond)
        members, beyond = members[sort], beyond[sort]
        order[where] = members
        new = np.append(True, (group[1:] != group[:-1]) | (beyond[1:] != beyond[:-1]))
        head[where] = np.maximum.accumulate(np.where(new, where, 0))
        rank[members] = head[where]
        again = np.append(False, ~new[1:]) | np.append(~new[1:], False)
        where = where[again]
        depth *= 2
    return order


def settled(codes: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether the common prefix of each suffix with the one before it in order is below ``length``; one more at the end."""
    n = len(codes)
    before = codes[order - 1].astype(np.int64)  # the transform; the first suffix wraps to an end mark
    before[order == 0] = 0
    back = np.empty(n, np.int64)
    back[np.argsort(before.astype(np.uint16), kind="stable")] = np.arange(n)  # where a suffix extended by its byte stands
    done = np.zeros(n + 1, bool)
    done[0] = done[n] = True
    first = codes[order].astype(np.int64)
    # Strings of one code: end marks are codes of their own.
    heads = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (first[1:] == 0)))
    low, high = heads, np.append(heads[1:], n)
    done[high] = True
    for _ in range(1, length):
        if not len(low):
            break
        size = high - low
        total = np.cumsum(size)
        at = np.repeat(low - total + size, size) + np.arange(total[-1])
        code = before[at]
        keep = code > 0  # nothing extends across an end mark
        at, code, string = at[keep], code[keep], np.repeat(np.arange(len(low)), size)[keep]
        if not len(at):
            break
        # Extended by one code, the members of an interval stand together, in the same order.
        key = string * 512 + code
        sort = np.sort((key << 32) + np.arange(len(key))) & 0xFFFFFFFF if (size > 1).any() else slice(None)
        key, to = key[sort], back[at[sort]]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        low, high = to[new], to[np.append(new[1:], len(to)) - 1] + 1
        fresh = ~done[high]
        low, high = low[fresh], high[fresh]
        done[high] = True
    return done


def repeated(contents: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each piece, the places from which ``length`` bytes are found elsewhere in the pieces."""
    sizes = np.array([len(c) for c in contents], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    codes = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8).astype(np.int16) + 1
    codes[ends] = 0
    order = suffixes(codes, ends)
    done = settled(codes, order, length)
    hit = np.sort(order[~done[:-1] | ~done[1:]])
    piece = np.searchsorted(ends, hit)
    starts = ends - sizes
    cut = np.searchsorted(piece, np.arange(len(contents) + 1))
    return [hit[cut[k] : cut[k + 1]] - starts[k] for k in range(len(contents))]


def runs(places: np.ndarray) -> list[tuple[int, int]]:
    """[first, last] of consecutive places."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.append(0, cut + 1)].tolist(), places[np.append(cut, len(places) - 1)].tolist(), strict=True))


# Over a table


def _kind(df: DataFrame) -> T.DataType:
    return df.schema["_id"].dataType


def _schema(kind: T.DataType, ddl: str) -> T.StructType:
    return T.StructType([T.StructField("_id", kind), *T.StructType.fromDDL(ddl).fields])


def _found_items(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            step = max(1, int((4 << 20) // max(1, batch.nbytes // max(1, batch.num_rows))))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                texts = [t.encode() for t in part.column(2).to_pylist()]
                own, first, last, anchor, twice = items(texts, length, gram)
                content = np.array([xxhash.xxh3_64_intdigest(texts[k][a : b + length]) for k, a, b in zip(own.tolist(), first.tolist(), last.tolist(), strict=True)], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), part.column(1).take(pa.array(own)), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(twice)], ["_id", "_h", "_a", "_b", "_m", "_c", "_r"])

    return docs.mapInArrow(trimmed(run), _schema(_kind(docs), "_h long, _a int, _b int, _m long, _c long, _r boolean"))


def _contents(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """_id, _h, _a, _m, _one and the bytes of each wanted item."""
    lists = wanted.groupBy("_id", "_h").agg(F.collect_list(F.struct("_a", "_b", "_m", "_one")).alias("_items")).withColumnsRenamed({"_id": "_i", "_h": "_g"})
    joined = docs.join(lists, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g"))).select("_id", "_h", "_text", "_items")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                text, found = batch.column(2)[k].as_py().encode(), batch.column(3)[k].as_py()
                n = len(found)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * n)), batch.column(1).take(pa.array([k] * n)), pa.array([i["_a"] for i in found], pa.int32()), pa.array([i["_m"] for i in found], pa.int64()), pa.array([i["_one"] for i in found], pa.bool_()), pa.array([text[i["_a"] : i["_b"] + length] for i in found], pa.binary())], ["_id", "_h", "_a", "_m", "_one", "_bytes"])

    return joined.mapInArrow(trimmed(run), _schema(_kind(docs), "_h long, _a int, _m long, _one boolean, _bytes binary"))


def _transformed(contents: DataFrame, length: int, piece: int) -> DataFrame:
    """Marks (_id, _h, _a, _b: window starts) of contents that share ``length`` bytes with another."""

    def settle(rows):
        for (i, h, a, one), places in zip([r[:4] for r in rows], repeated([r[4] for r in rows], length), strict=True):
            if one:
                for low, high in runs(places):
                    yield i, h, a + low, a + high

    def run(batches):
        held, size, last = [], 0, None
        out: list[tuple] = []
        kinds = None
        for batch in batches:
            kinds = [batch.schema.field("_id").type, pa.int64(), pa.int32(), pa.int32()]
            for i, h, a, m, one, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if m != last and size > piece:
                    out += settle(held)
                    held, size = [], 0
                held.append((i, h, a, one, content))
                size, last = size + len(content), m
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["_id", "_h", "_a", "_b"])
                out = []
        if held:
            out += settle(held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["_id", "_h", "_a", "_b"])

    dealt = contents.repartition(spread(contents), "_m").sortWithinPartitions("_m")
    return dealt.mapInArrow(trimmed(run), _schema(_kind(contents), "_h long, _a int, _b int"))


def _least(hashes: np.ndarray, width: int) -> np.ndarray:
    """The least of every so many neighbours."""
    return np.lib.stride_tricks.sliding_window_view(hashes, width).min(axis=1)


def _divided(contents: DataFrame, length: int, gram: int, ends: int) -> DataFrame:
    """Items like ``_found_items`` makes, with _one, of contents whose anchor alone gathers too many: by anchors from both ends of each window."""

    def run(batches):
        for batch in batches:
            take, out = [], []
            for k, (a, m, content) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 5)), strict=True)):
                grams = _gram_hashes(np.frombuffer(content, np.uint8), gram)
                n, width = len(content) - length + 1, min(ends, length - gram + 1)
                first, last = _least(grams, width)[:n], _least(grams, width)[length - gram + 1 - width :][:n]
                key = (np.uint64(m & (1 << 64) - 1) + first * _BASE) * _MIX
                key = ((key ^ (key >> np.uint64(29))) + last) * _BASE
                key ^= key >> np.uint64(31)
                cut_at = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist()
                for i, j in zip(cut_at, [*cut_at[1:], n], strict=True):
                    again = len(np.unique(grams[i:j])) < j - i  # equal windows begin with equal strings
                    take.append(k)
                    out.append((a + i, a + j - 1, int(key[i : i + 1].view(np.int64)[0]), xxhash.xxh3_64_intdigest(content[i : j - 1 + length]) - (1 << 63), again))
            at = pa.array(take, pa.int64())
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), batch.column(4).take(at)], ["_id", "_h", "_a", "_b", "_m", "_c", "_r", "_one"])

    return contents.mapInArrow(trimmed(run), _schema(_kind(contents), "_h long, _a int, _b int, _m long, _c long, _r boolean, _one boolean"))


def _opened(again: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Of items with _one (its windows aren't settled yet): those to mark whole, as their content stands elsewhere too, and one for each content whose anchor has several or that may repeat itself, with its anchor's _size."""
    distinct = again.groupBy("_m", "_c").agg(F.count("*").alias("_n"), F.min("_one").alias("_every"), *(F.first(c).alias(c) for c in ("_id", "_h", "_a", "_b", "_r")))
    whole = again.filter("_one").join(distinct.filter("_n > 1").select("_m", "_c"), ["_m", "_c"], "left_semi").select("_id", "_h", "_a", "_b")
    one = (F.col("_n") == 1) & F.col("_every")
    kinds = distinct.groupBy("_m").agg(F.count("*").alias("_k"), F.sum(F.col("_b").cast("long") - F.col("_a") + length).alias("_size"), F.max(F.col("_r") & one).alias("_r")).filter("_k > 1 or _r").drop("_r")
    return whole, staged(distinct.join(kinds, "_m").select("_id", "_h", "_a", "_b", "_m", one.alias("_one"), "_size"), "open-items")


def marks(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, piece: int = PIECE_BYTES, group: int = GROUP_BYTES) -> DataFrame:
    """_id, _h, _marks (array of _a, _b): inclusive runs of places from which ``length`` bytes are found elsewhere."""
    every = staged(_found_items(docs, length, gram), "items")
    shared = every.groupBy("_m").agg(F.count("*").alias("_n"), F.max("_r").alias("_r")).filter("_n > 1 or _r").select("_m")
    again = staged(every.join(shared, "_m", "left_semi").withColumn("_one", F.lit(True)), "shared-items")
    whole, open_ = _opened(again, length)
    found = whole.unionByName(_transformed(_contents(docs, open_.filter(F.col("_size") <= group), length), length, piece))
    for ends in ENDS:
        large = open_.filter(F.col("_size") > group)
        if large.isEmpty():
            break
        whole, open_ = _opened(staged(_divided(_contents(docs, large, length), length, gram, ends), "divided-items"), length)
        if ends == ENDS[-1]:  # only periods of one byte have several windows; there are few of them
            open_ = open_.filter("_a < _b").withColumn("_size", F.lit(0))
        found = found.unionByName(whole).unionByName(_transformed(_contents(docs, open_.filter(F.col("_size") <= group), length), length, piece))
    return staged(found, "marks").distinct().groupBy("_id", "_h").agg(F.collect_list(F.struct("_a", "_b")).alias("_marks"))


def cut(text: bytes, places: list, length: int) -> tuple[list[tuple[int, int]], bytes]:
    """Removed spans [start, stop) and what remains, given inclusive runs of window starts."""
    spans: list[list[int]] = []
    for a, b in sorted(places):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b + length)
        else:
            spans.append([a, b + length])
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return [(a, b) for a, b in spans], b"".join([*kept, text[at:]])


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, piece: int = PIECE_BYTES, group: int = GROUP_BYTES) -> DataFrame:
    """One row per input row: id_col, n_bytes, spans (removed, array of start, stop), kept (the remaining bytes)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    docs = df.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_h"), text.alias("_text"))
    found = marks(docs, length, gram, piece, group).withColumnsRenamed({"_id": "_i", "_h": "_g"})
    joined = docs.join(found, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g")), "left").select("_id", "_text", "_marks")
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *T.StructType.fromDDL("n_bytes long, spans array<struct<start:bigint,stop:bigint>>, kept binary").fields])

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            raws = [t.encode() for t in batch.column(1).to_pylist()]
            done = [cut(raw, [(m["_a"], m["_b"]) for m in found or ()], length) for raw, found in zip(raws, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raws), pa.int64()), pa.array([[{"start": a, "stop": b} for a, b in spans] for spans, _ in done], kind), pa.array([k for _, k in done], pa.binary())], [id_col, "n_bytes", "spans", "kept"])

    return joined.mapInArrow(trimmed(run), schema)
