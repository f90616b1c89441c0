"""Exact deduplication by Patricia tries.

Texts are equal when identical after every whitespace run became one space. Work is dealt by length and content
hash; a partition inserts whole byte strings into a compressed radix trie whose terminal nodes keep the smallest
identifier, so the hash only deals out work and never decides equality. The same insertion runs before the shuffle,
so a text held by a third of all rows crosses it once per input partition. A trie over its memory bound writes its
largest subtree to disk and finishes it on its own afterwards.

Defined cases: a null text counts as empty; null identifiers sort last and stay only where a group has no other;
of rows repeated with identifier and text one is kept; an empty table gives an empty result; other columns of the
input are ignored by ``groups`` and carried unchanged by ``keep_first``, whatever they are called.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import squeeze, staged, trimmed

TRIE_BYTES = 64 << 20


def content_hash(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


class Node:
    __slots__ = ("children", "label", "value")

    def __init__(self, label: bytes, value=None):
        self.label, self.children, self.value = label, {}, value


def _shared(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of ``a`` and ``b[start:]``, by halving."""
    low, high = 0, min(len(a), len(b) - start)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[start + low : start + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """Byte strings to merged values, with spilling by subtree below the root.

    ``merge(old, new)`` combines the values of equal strings. ``items`` yields each string once.
    """

    def __init__(self, merge: Callable, limit: int = TRIE_BYTES):
        self.merge, self.limit, self.keys = merge, limit, 0
        self.root, self.held = Node(b""), {}
        self.spilled: dict[int, object] = {}
        self.size = 0

    def insert(self, key: bytes, value) -> None:
        if key and key[0] in self.spilled:
            pickle.dump((key, value), self.spilled[key[0]])
            return
        node, at, before = self.root, 0, self.size
        while True:
            if at == len(key):
                self.keys += node.value is None
                node.value = value if node.value is None else self.merge(node.value, value)
                break
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], value)
                self.size += len(key) - at + 300
                self.keys += 1
                break
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            n = _shared(child.label, key, at)
            upper = Node(child.label[:n])
            child.label = child.label[n:]
            upper.children[child.label[0]] = child
            node.children[key[at]] = upper
            node, at = upper, at + n
            self.size += 300
        if key:
            self.held[key[0]] = self.held.get(key[0], 0) + self.size - before
        if self.size > self.limit and self.keys > 1 and self.held:
            self._spill(max(self.held, key=self.held.get))

    def _spill(self, first: int) -> None:
        out = self.spilled[first] = tempfile.TemporaryFile()
        for entry in self._walk(self.root.children.pop(first), b""):
            pickle.dump(entry, out)
        self.size -= self.held.pop(first)

    @staticmethod
    def _walk(node: Node, prefix: bytes) -> Iterator[tuple[bytes, object]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            key = prefix + node.label
            if node.value is not None:
                yield key, node.value
            stack.extend((child, key) for child in node.children.values())

    def items(self) -> Iterator[tuple[bytes, object]]:
        yield from self._walk(self.root, b"")
        self.root, self.held, self.size = Node(b""), {}, 0
        for first, file in self.spilled.items():
            # Below what all its strings share, the subtree branches anew, so it can spill again by its own subtrees.
            shared = None
            for key, _ in self._read(file):
                shared = key if shared is None else shared[: _shared(shared, key, 0)]
            sub = PatriciaTrie(self.merge, self.limit)
            for key, value in self._read(file):
                sub.insert(key[len(shared) :], value)
            file.close()
            for key, value in sub.items():
                yield shared + key, value

    @staticmethod
    def _read(file) -> Iterator[tuple[bytes, object]]:
        file.seek(0)
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return


def _earlier(a: tuple, b: tuple) -> tuple:
    """Merge (identifier, rows, rows that have the identifier, payload): the smaller identifier stays, null last."""
    if a[0] == b[0]:
        return a[0], a[1] + b[1], a[2] + b[2], a[3]
    first = b if a[0] is None or (b[0] is not None and b[0] < a[0]) else a
    return first[0], a[1] + b[1], first[2], first[3]


def _owners(batches, limit: int, hashed: Callable, raw: bool):
    """Insert a partition's texts; ``raw`` rows are (id, text, rest...), others what this function has sent on."""
    trie, schema = PatriciaTrie(_earlier, limit), None
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        if raw:
            for i, text, *rest in zip(*cols, strict=True):
                key = squeeze((text or "").encode())
                trie.insert(key, (i, 1, 1, (text, *rest)))
        else:
            for _, _, key, i, n, m, *payload in zip(*cols, strict=True):
                trie.insert(key, (i, n, m, tuple(payload)))
    pending, weight = [], 0
    for key, value in trie.items():
        pending.append((len(key), hashed(key), key, *value[:3], *value[3]))
        weight += len(key)
        if weight > 8 << 20:
            yield pending
            pending, weight = [], 0
    if pending:
        yield pending


def _phase(df: DataFrame, schema: T.StructType, limit: int, hashed: Callable, raw: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for rows in _owners(batches, limit, hashed, raw):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    return df.mapInArrow(trimmed(run), schema)


def _merged(df: DataFrame, id_col: str, text_col: str, rest: list[str], limit: int, hashed: Callable, keep_text: bool) -> DataFrame:
    """One row for each distinct text: _len, _hash, _key (normalised bytes), _id, _n, _m and the owner's columns by position."""
    names = [text_col, *rest]
    fields = [T.StructField(f"_{k}", df.schema[c].dataType) for k, c in enumerate(names)]
    schema = T.StructType([T.StructField("_len", T.LongType()), T.StructField("_hash", T.StringType()), T.StructField("_key", T.BinaryType()), T.StructField("_id", df.schema[id_col].dataType), T.StructField("_n", T.LongType()), T.StructField("_m", T.LongType()), *fields])
    first = df.select(F.col(f"`{id_col}`"), *(F.col(f"`{c}`") for c in names))
    local = _phase(first, schema, limit, hashed, True)
    if not keep_text:
        local = local.withColumn("_0", F.lit(None).cast("string"))
    return _phase(local.repartition("_len", "_hash"), schema, limit, hashed, False)


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TRIE_BYTES, hashed: Callable = content_hash) -> DataFrame:
    """The rows that stay, one for each distinct text, with all columns of the input."""
    rest = [c for c in df.columns if c not in (id_col, text_col)]
    out = _merged(df, id_col, text_col, rest, limit, hashed, True)
    at = {id_col: "_id", text_col: "_0"} | {c: f"_{k + 1}" for k, c in enumerate(rest)}
    return out.select(*(F.col(at[c]).alias(c) for c in df.columns))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TRIE_BYTES, hashed: Callable = content_hash) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256 of the normalised text."""
    owners = _merged(df, id_col, text_col, [], limit, hashed, False)
    owners = staged(owners.select(F.sha2("_key", 256).alias("_sha"), F.col("_id").alias("keep_id"), F.col("_n").alias("group_size"), F.col("_m")), "dedup-owners")
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("_id", kind), T.StructField("_sha", T.StringType())])

    def digests(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([content_hash(squeeze((t or "").encode())) for t in batch.column(1).to_pylist()], pa.string())], ["_id", "_sha"])

    rows = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(trimmed(digests), schema)
    joined = rows.join(owners, "_sha").withColumn("kept", F.col("_id").eqNullSafe(F.col("keep_id")))
    if owners.filter("_m > 1").limit(1).count():  # rows repeated with their identifier: one of them stays
        tied = F.col("kept") & (F.col("_m") > 1)
        order = Window.partitionBy("_sha").orderBy("_id")
        joined = joined.filter(~tied).unionByName(joined.filter(tied).withColumn("kept", F.row_number().over(order) == 1))
    return joined.select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.col("_sha").alias("text_sha256"))
