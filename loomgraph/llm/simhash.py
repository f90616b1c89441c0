"""SimHash near-deduplication by tiled exact comparison.

A fingerprint has a bit where over half of the 4-word shingle hashes (XXH64, seed 42) have it. Distinct fingerprints
are dealt by population count into tiles of bounded size; only tiles whose counts differ by at most the radius meet,
as differing bits are at least the difference of counts. A pair of tiles is compared whole with exclusive-or and bit
counts, and sends on a spanning forest of its links, so a group of k near copies gives about k links and not k squared;
no link is lost for reachability. Links then become components.

The 64 bits say too little for a given similarity of shingle sets, so ``keep_one`` takes longer fingerprints: repeated
shingles count once, and 63 more words follow, each from the shingle hashes mixed anew. Sets of Jaccard similarity j lie
at an angle of arccos(2j / (1 + j)), and a bit differs by angle / pi. Tiles meet by the first word, within a wide radius,
and by the first eight, within three standard errors of what the similarity amounts to: that loses almost no link and
leaves groups far too wide. Each group is then compared in tiles of its own: pairs that all 4,096 bits put within three
standard errors are confirmed by the exact similarity of their shingle sets before they link. Neither step gathers a
group in one task: tiles are bounded by fingerprints and by bytes of text.

Defined cases: a null or wordless text has fingerprint zero, linked like any other; rows with a null identifier get a
fingerprint and their component, whose identifier is the smallest that isn't null (null if there is none); repeated
rows share a component; an empty table gives an empty result; other columns are ignored by ``components`` and carried
unchanged by ``keep_one``, which decides by (identifier, text): rows that share an identifier but not a text are
judged apart, of rows that share both one stays (which one, if they differ elsewhere, is open), and of a component the
row with the smallest identifier stays, null last, ties by a digest of identifier and text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spread, staged, trimmed
from .components import roots

SHINGLE, SEED, RADIUS, TILE = 4, 42, 4, 1 << 16
SIMILARITY, WIDE_SHINGLE, WIDE_RADIUS, FIRST, WORDS, GROUP_TILE, TILE_BYTES = 0.8, 5, 18, 8, 64, 1 << 13, 1 << 22
_S = 1 << 40  # a tile's number: its population count times this, plus its place


def shingle_hashes(text: str | None, k: int = SHINGLE) -> np.ndarray:
    joined = b" ".join((text or "").encode().lower().split())
    if not joined:
        return np.zeros(0, np.uint64)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(spaces + 1).tolist()], [*spaces.tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    if len(starts) < k:
        return np.array([digest(joined, SEED)], np.uint64)
    return np.array([digest(joined[i:j], SEED) for i, j in zip(starts, ends[k - 1 :])], np.uint64)


def _majority(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """Majority bits of the hashes, and of what splitmix64 makes of them in ``words - 1`` more steps, as signed words."""
    ones = np.zeros(64 * words, np.int64)
    step = np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 255):  # so many that a byte holds the count
        part = hashes[at : at + 255, None] + step
        if words > 1:
            mixed = part[:, 1:]
            mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            part[:, 1:] = mixed ^ (mixed >> np.uint64(31))
        bits = np.unpackbits(part.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer."""
    return int(_majority(shingle_hashes(text, k))[0])


def wide_fingerprint(text: str | None, k: int = WIDE_SHINGLE, words: int = WORDS) -> np.ndarray:
    """All words of the fingerprint; of more than one, a shingle counts once, however often it stands."""
    hashes = shingle_hashes(text, k)
    return _majority(np.unique(hashes) if words > 1 else hashes, words)


def differing_bits(similarity: float, words: int = WORDS, errors: float = 0.0) -> int:
    """The bits by which fingerprints of sets of this Jaccard similarity differ, and so many standard errors more."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(64 * words * share + errors * np.sqrt(64 * words * share * (1 - share)))


def fingerprints(df: DataFrame, id_col: str, text_col: str, k: int = SHINGLE, words: int = 1) -> DataFrame:
    """_id, _fp (the first word), _wide (all words) and _key (128 bits that stand for all words) of each row."""
    schema = T.StructType([T.StructField("_id", df.schema[id_col].dataType), T.StructField("_fp", T.LongType()), T.StructField("_wide", T.ArrayType(T.LongType())), T.StructField("_key", T.BinaryType())])

    def run(batches):
        for batch in batches:
            made = [wide_fingerprint(t.as_py(), k, words) for t in batch.column(1)]
            keys = [xxhash.xxh3_128_digest(m.tobytes()) for m in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(m[0]) for m in made], pa.int64()), pa.array(made, pa.list_(pa.int64())), pa.array(keys, pa.binary())], ["_id", "_fp", "_wide", "_key"])

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(trimmed(run), schema)


def forest(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS, most: int | None = None, block: int | None = None, confirm: Callable | None = None) -> list[tuple[int, int]]:
    """A spanning forest of all links between (or, with b None, within) the fingerprints of one or two tiles.

    Tiles are arrays of a row of words for each fingerprint; a link has at most ``radius`` differing bits in the first
    word and, if ``most`` is given, at most so many in all; ``confirm(i, js)`` may then tell which of these pairs link.
    Links are pairs of places in a followed by b.
    """
    own = a if b is None else np.concatenate([a, b])
    other, shift = (a, 0) if b is None else (b, len(a))
    label = np.arange(len(own))
    block = block or max(1, (1 << 22) // max(8, own.shape[1]) // max(1, len(other)))  # comparisons at once, so that they stay in a core's cache
    for at in range(0, len(a), block):
        near = np.bitwise_count(a[at : at + block, 0, None] ^ other[None, :, 0]) <= radius
        if b is None:
            near[np.arange(len(near)), np.arange(at, at + len(near))] = False
        row, col = np.nonzero(near)
        if most is not None and len(row):
            apart = label[at + row] != label[col + shift]  # what is connected already needs no look
            row, col = row[apart], col[apart]
            fits = np.bitwise_count(a[at + row] ^ other[col]).sum(axis=1) <= most
            row, col = row[fits], col[fits]
        for r, members in zip(*_grouped(row, col), strict=True):
            found, mine = label[members + shift], label[at + r]
            if confirm is not None:
                members = members[found != mine]
                found = label[members[confirm(at + r, members + shift)] + shift] if len(members) else found
            if (found != mine).any():
                classes = np.unique(np.append(found, mine))
                label[np.isin(label, classes)] = classes[0]
    return [(int(i), int(label[i])) for i in np.flatnonzero(label != np.arange(len(own)))]


def _grouped(row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    if not len(row):
        return row, []
    cut = np.flatnonzero(np.diff(row)) + 1
    return row[np.append(0, cut)], np.split(col, cut)


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE, most: int | None = None) -> DataFrame:
    """Columns a, b (fingerprints of all words): links that connect exactly what the distinct fingerprints' links connect."""
    ones = F.bit_count("_fp")
    counts = {r[0]: r[1] for r in distinct.groupBy(ones).count().collect()}  # 65 rows at most
    tiles_of = [-(-counts.get(p, 0) // tile) for p in range(65 + radius)]
    number = F.array(*(F.lit(max(1, n)).cast("long") for n in tiles_of))
    has = F.array(*(F.lit(n).cast("long") for n in tiles_of))
    place = F.pmod(F.xxhash64("_wide"), F.element_at(number, ones + 1))
    tiles = staged(distinct.groupBy((ones.cast("long") * _S + place).alias("t")).agg(F.flatten(F.collect_list("_wide")).alias("x"), F.first(F.size("_wide")).alias("width")), "tiles")
    count = F.expr(f"cast(t div {_S} as int)")

    def meetings(d):
        """Pairs of this tile with every tile whose count is ``d`` more: numbers in order, and whether it comes second."""
        n = F.when(count + d >= 0, F.element_at(has, count + d + 1))
        other = lambda s: (count + d).cast("long") * _S + s
        pair = lambda s: F.struct(F.least("t", other(s)).alias("ta"), F.greatest("t", other(s)).alias("tb"), (other(s) < F.col("t")).alias("second"))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), pair)).otherwise(F.array().cast("array<struct<ta:bigint,tb:bigint,second:boolean>>"))

    meets = F.flatten(F.transform(F.sequence(F.lit(-radius), F.lit(radius)), meetings))
    rows = tiles.select(F.explode(meets).alias("m"), "x", "width").select("m.ta", "m.tb", "m.second", "x", "width")
    met = sum(tiles_of[p] * (tiles_of[p] + 1) // 2 + tiles_of[p] * sum(tiles_of[p + 1 : p + 1 + radius]) for p in range(65))
    # About a pair to a partition: a task is then a comparison of bounded size, and holds two tiles.
    return _compared(rows, ["ta", "tb"], max(1, min(met, 20_000)), radius, most)


def _compared(rows: DataFrame, pair: list[str], partitions: int, radius: int, most: int | None) -> DataFrame:
    """Links a, b (all words) of tiles ``x`` that meet: rows of ``pair``, whose columns number the tiles, and ``second``."""
    columns = [*pair, "second", "x", "width"]
    at = {c: columns.index(c) for c in columns}

    def run(batches):
        first = None
        for batch in batches:
            for ta, tb, second, x, width in zip(*(batch.column(at[c]) for c in columns), strict=True):
                tile_ = x.values.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, width.as_py())
                if second.as_py():
                    own, found = np.concatenate([first, tile_]), forest(first, tile_, radius, most)
                elif ta.as_py() == tb.as_py():
                    own, found = tile_, forest(tile_, None, radius, most)
                else:  # the second of the pair comes next
                    first = tile_.copy()
                    continue
                own = own.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([own[i] for i, _ in found], pa.list_(pa.int64())), pa.array([own[j] for _, j in found], pa.list_(pa.int64()))], ["a", "b"])

    dealt = rows.select(*columns).repartition(partitions, *pair).sortWithinPartitions(*pair, "second")
    return dealt.mapInArrow(trimmed(run), "a array<long>, b array<long>")


class Sets:
    """Shingle sets of the texts of a tile or two, and which of them are similar."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray):
        self.sizes, self.ends = sizes, np.cumsum(sizes)
        values, self.ids = np.unique(hashes, return_inverse=True)
        self.mark = np.zeros(len(values), bool)

    def of(self, i: int) -> np.ndarray:
        return self.ids[self.ends[i] - self.sizes[i] : self.ends[i]]

    def similar(self, i: int, others: np.ndarray, least: float) -> np.ndarray:
        """Whether the Jaccard similarity of set i and each of the others is at least so much."""
        own = self.of(i)
        self.mark[own] = True
        shared = np.array([np.count_nonzero(self.mark[self.of(j)]) for j in others.tolist()], np.int64)
        self.mark[own] = False
        return shared >= least * (len(own) + self.sizes[others] - shared) - 1e-9


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """_key, _group, _t, _wide and _set (the distinct shingle hashes of its text) of each row with _text."""
    names = ["_key", "_group", "_t", "_wide"]

    def run(batches):
        for batch in batches:
            made = [np.unique(shingle_hashes(t.as_py(), k)).view(np.int64) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(made, pa.list_(pa.int64()))], [*names, "_set"])

    return texts.select(*names, "_text").mapInArrow(trimmed(run), "_key binary, _group long, _t long, _wide array<long>, _set array<long>")


def confirmed_links(texts: DataFrame, similarity: float, radius: int, most: int, k: int) -> DataFrame:
    """Links a, b (keys) within groups, given _key, _group, _t and _tiles (its tile, and of how many), _wide and _text: every two tiles of a group meet."""
    dealt = _sets(texts.select("_key", "_group", (F.col("_t") * _S + F.col("_tiles")).alias("_t"), "_wide", "_text"), k).repartition("_group", "_t")
    tile_ = dealt.groupBy("_group", "_t").agg(F.collect_list(F.struct("_key", "_wide", "_set")).alias("r"))
    parts = tile_.select("_group", F.expr(f"_t div {_S}").alias("t"), (F.col("_t") % _S).alias("_tiles"), F.col("r._key").alias("keys"), F.flatten("r._wide").alias("x"), F.flatten("r._set").alias("s"), F.transform("r._set", lambda x: F.size(x)).alias("sizes"))
    tiles = staged(parts, "group-tiles")
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1), lambda o: F.struct(F.least("t", o).alias("ta"), F.greatest("t", o).alias("tb"), (o < F.col("t")).alias("second")))
    columns = ["_group", "ta", "tb", "second", "keys", "x", "s", "sizes"]
    rows = tiles.select("_group", "keys", "x", "s", "sizes", F.explode(meets).alias("m")).select("_group", "m.ta", "m.tb", "m.second", "keys", "x", "s", "sizes")

    def run(batches):
        held = None  # the first tile of a pair; the second may be missing, as a tile may have no rows
        for batch in batches:
            for i in range(batch.num_rows):
                own, ta, tb, second = (batch.column(c)[i].as_py() for c in range(4))
                numbers = [batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (5, 6, 7)]
                tile_ = (batch.column(4)[i].values.to_pylist(), numbers[0].view(np.uint64).reshape(len(numbers[2]), -1), *numbers[1:])
                if second:
                    if held is None or held[0] != (own, ta, tb):
                        continue
                    first = held[1]
                    keys, hashes, sizes = first[0] + tile_[0], np.concatenate([first[2], tile_[2]]), np.concatenate([first[3], tile_[3]])
                    a, b = first[1], tile_[1]
                elif ta == tb:
                    (keys, a, hashes, sizes), b = tile_, None
                else:
                    held = (own, ta, tb), (tile_[0], *(x.copy() for x in tile_[1:]))
                    continue
                sets = Sets(hashes, sizes)
                found = forest(a, b, radius, most, confirm=lambda i, js, sets=sets: sets.similar(i, js, similarity))
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i, _ in found], pa.binary()), pa.array([keys[j] for _, j in found], pa.binary())], ["a", "b"])

    met = rows.select(*columns).repartition(spread(texts), "_group", "ta", "tb").sortWithinPartitions("_group", "ta", "tb", "second")
    return met.mapInArrow(trimmed(run), "a binary, b binary")


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, k: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """One row per input row: id_col, fingerprint (16 hex digits), component_id."""
    rows = staged(fingerprints(df, id_col, text_col, k).drop("_key"), "fingerprints")
    distinct = staged(rows.groupBy("_fp", "_wide").agg(F.min("_id").alias("_least")), "distinct")
    up = roots(links(distinct, radius, tile), "a", "b")
    rooted = distinct.join(up.withColumnsRenamed({"u": "_wide", "v": "_root"}), "_wide", "left").withColumn("_root", F.coalesce("_root", "_wide"))
    names = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    classes = rooted.join(names, "_root").select("_wide", "component_id")
    return rows.join(classes, "_wide").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def _named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_all (the whole row), _i, _x (its identifier and text) and _row (a digest of both)."""
    ident, text = F.col("_i").cast("string"), F.col("_x")
    rows = df.select(F.struct("*").alias("_all"), F.col(f"`{id_col}`").alias("_i"), F.col(f"`{text_col}`").alias("_x"))
    return rows.withColumn("_row", F.unhex(F.md5(F.concat_ws("|", F.when(ident.isNull(), "none").otherwise(F.concat(F.lit("="), ident)), F.coalesce(F.md5(text), F.lit("none"))))))


def _once(named: DataFrame, wanted: DataFrame, repeats: DataFrame) -> DataFrame:
    """The rows that ``wanted`` has by _row, with its columns, each once. ``repeats``: _row of those that stand more than once."""
    # A merge join at every size: what is wanted grows with the input, so it is never broadcast.
    single = named.join(wanted.join(repeats, "_row", "left_anti").hint("merge"), "_row")
    return single.unionByName(named.join(repeats, "_row", "left_semi").dropDuplicates(["_row"]).join(wanted, "_row").select(*single.columns))


def near_groups(named: DataFrame, rows: DataFrame, repeats: DataFrame, similarity: float, radius: int, k: int, first: int, words: int, tile: int, group_tile: int, tile_bytes: int) -> DataFrame:
    """_key, _least (of its rows), _root of each distinct fingerprint: texts of one root are linked by similarity."""
    distinct = staged(rows.groupBy("_key").agg(F.min("_id").alias("_least"), F.first("_fp").alias("_fp"), F.first("_wide").alias("_wide")), "distinct")
    cut = F.slice("_wide", 1, first)
    wide = roots(links(distinct.select("_fp", cut.alias("_wide")).distinct(), radius, tile, differing_bits(similarity, first, 3.0)), "a", "b")
    grouped = distinct.withColumn("_cut", cut).join(wide.withColumnsRenamed({"u": "_cut", "v": "_group"}), "_cut", "left")
    grouped = staged(grouped.select("_key", F.xxhash64(F.coalesce("_group", "_cut")).alias("_group"), F.col("_least.row").alias("_row"), F.col("_least.bytes").alias("_bytes"), "_wide"), "near-groups")
    # Written first, so that Spark can split a hot group in the join.
    tiles = F.greatest(F.ceil(F.count("*") / group_tile), F.ceil(F.sum("_bytes") / tile_bytes)).cast("long")
    sizes = staged(grouped.groupBy("_group").agg(F.count("*").alias("_n"), tiles.alias("_tiles")).filter("_n > 1").select("_group", "_tiles"), "group-sizes")
    dealt = grouped.join(sizes, "_group").withColumn("_t", F.pmod(F.xxhash64("_key"), "_tiles")).drop("_bytes")
    texts = _once(named.select("_row", F.col("_x").alias("_text")), dealt, repeats)
    up = roots(confirmed_links(texts, similarity, radius, differing_bits(similarity, words, 3.0), k), "a", "b")
    return distinct.select("_key", "_least").join(up.withColumnsRenamed({"u": "_key", "v": "_root"}), "_key", "left").withColumn("_root", F.coalesce("_root", "_key"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, radius: int = WIDE_RADIUS, k: int = WIDE_SHINGLE, first: int = FIRST, words: int = WORDS, tile: int = TILE, group_tile: int = GROUP_TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """The rows that stay, one of each component of texts that similarity links."""
    named = _named(df, id_col, text_col)
    told = named.select(F.struct(F.col("_i").isNull().alias("none"), F.col("_i").alias("id"), F.col("_row").alias("row"), F.coalesce(F.octet_length("_x"), F.lit(0)).cast("long").alias("bytes")).alias("_id"), "_x")
    rows = staged(fingerprints(told, "_id", "_x", k, words), "fingerprints")
    repeats = staged(rows.groupBy(F.col("_id.row").alias("_row")).count().filter("count > 1").select("_row"), "repeats")
    rooted = near_groups(named, rows, repeats, similarity, radius, k, first, words, tile, group_tile, tile_bytes)
    kept = staged(rooted.groupBy("_root").agg(F.min("_least").alias("_first")).select(F.col("_first.row").alias("_row")), "kept")
    return _once(named.select("_row", "_all"), kept, repeats).select("_all.*")
