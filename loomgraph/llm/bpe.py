"""Byte-level BPE encoding and decoding by tree concatenation.

A text longer than a leaf is halved until its parts fit; the leaves are encoded in parallel, and each join re-encodes a
window around it that grows until both sides agree with the window exactly. Two kinds of agreement are certain. (1) The
window starts and ends where the splitting pattern must split in the whole text as well as in the half alone; then the
halves' tokens outside of it and the window's are those of the whole. (2) In a run that the pattern doesn't split, the
window begins with the left half's tokens and ends with the right half's; as a BPE encoding is valid if each pair of
neighbouring tokens is, the spliced one is that of the whole run. If no window agrees, the whole is encoded at once.

Texts that stand more than once in a batch, as the copies that a mix takes do, are encoded once. A special token written in the text gets its id, as in the
public tokenizer. Decoding joins the bytes of ids and replaces what isn't UTF-8.

Defined cases: a null or empty text gives no ids and decodes to the empty text; repeated rows are encoded each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, trimmed

VOCABULARY = "byte_bpe_50k.json"
LEAF, WINDOW, AGREE = 16_384, 64, 2


def _byte_of() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """One public vocabulary, read from a ``tokenizers`` JSON file of a byte-level BPE with the usual pattern."""

    def __init__(self, name: str = VOCABULARY, leaf: int = LEAF, threads: int = 2):
        import json

        import public_tokenizers
        import tiktoken

        found = json.loads(open(name if "/" in name else public_tokenizers.path(name), encoding="utf-8").read())
        bytes_of, vocab, merges = _byte_of(), found["model"]["vocab"], found["model"]["merges"]
        self.specials = {t["content"]: t["id"] for t in found["added_tokens"]}
        # Ranks are those of the merges; single bytes come first.
        own = {p: i for p, i in vocab.items() if p not in self.specials}
        as_bytes = {p: bytes(bytes_of[c] for c in p) for p in own}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
        ranked = [p for p in own if len(as_bytes[p]) == 1] + merged
        if len(ranked) != len(own) or set(ranked) != set(own):
            raise ValueError("not a byte-level BPE whose vocabulary is its bytes and merges")
        self.core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={as_bytes[p]: k for k, p in enumerate(ranked)}, special_tokens={})
        self.id_of = np.array([own[p] for p in ranked], np.uint32)
        self.piece = [as_bytes[p] for p in ranked]
        self.by_id = {own[p]: as_bytes[p] for p in ranked} | {i: t.encode() for t, i in self.specials.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.one_class = regex.compile(r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+")
        self.leaf, self.threads = leaf, threads

    # Leaves

    def _leaf(self, text: str) -> np.ndarray:
        return self.core.encode_to_numpy(text, disallowed_special=()).view(np.int32)

    def _leaves(self, texts: list[str]) -> list[np.ndarray]:
        if len(texts) < 2:
            return [self._leaf(t) for t in texts]
        with ThreadPoolExecutor(self.threads) as pool:
            return list(pool.map(self._leaf, texts))

    # The tree

    def _cuts(self, low: int, high: int, cuts: list[int]) -> None:
        if high - low > self.leaf:
            middle = (low + high) // 2
            self._cuts(low, middle, cuts)
            cuts.append(middle)
            self._cuts(middle, high, cuts)

    def ranks(self, texts: list[str]) -> list[np.ndarray]:
        """Ranks of each text; the leaves of all of them are encoded together."""
        all_cuts = []
        for text in texts:
            cuts: list[int] = []
            self._cuts(0, len(text), cuts)
            all_cuts.append([0, *cuts, len(text)])
        leaves = iter(self._leaves([t[a:b] for t, cuts in zip(texts, all_cuts, strict=True) for a, b in zip(cuts, cuts[1:])]))
        out = []
        for text, cuts in zip(texts, all_cuts, strict=True):
            level = [(a, b, next(leaves)) for a, b in zip(cuts, cuts[1:])]
            while len(level) > 1:  # neighbours join, level by level
                level = [self._joined(text, *level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
            out.append(level[0][2])
        return out

    def _sure(self, text: str, i: int) -> bool:
        """Whether the pattern splits at i whatever stands further away, in the whole text and in a part of it."""
        x, y = text[i - 1], text[i]
        if x.isspace():
            return False
        if y.isspace():
            return True
        if ord(x) > 0x24F or ord(y) > 0x24F or x == "'":
            return False
        kinds = [unicodedata.category(c)[0] for c in (x, y)]
        return [k if k in "LN" else "-" for k in kinds][0] != [k if k in "LN" else "-" for k in kinds][1]

    def _tail(self, ranks: np.ndarray, n_bytes: int, last: bool) -> int | None:
        """How many tokens at the end (or the start) hold exactly so many bytes; None if a token is across."""
        n, k = 0, 0
        while n < n_bytes:
            k += 1
            n += len(self.piece[ranks[-k if last else k - 1]])
        return k if n == n_bytes else None

    def _joined(self, text: str, left: tuple, right: tuple) -> tuple:
        (low, cut, a), (_, high, b) = left, right
        reach = WINDOW
        while True:
            found = self._by_split(text, low, cut, high, a, b, reach)
            if found is None:
                found = self._by_agreement(text, low, cut, high, a, b, reach)
            if found is not None:
                return low, high, found
            if reach > high - low:
                return low, high, np.array(self.core.encode_ordinary(text[low:high]), np.int32)
            reach *= 4

    def _by_split(self, text, low, cut, high, a, b, reach):
        start = next((i for i in range(cut - 4, max(low, cut - reach), -1) if self._sure(text, i)), low if cut - reach <= low else None)
        if start is None:
            return None
        stop = next((i for i in range(cut + 1, min(high, cut + reach)) if self._sure(text, i)), high if cut + reach >= high else None)
        if stop is None:
            return None
        i, j = self._tail(a, len(text[start:cut].encode()), True), self._tail(b, len(text[cut:stop].encode()), False)
        if i is None or j is None:
            return None
        return np.concatenate([a[: len(a) - i], np.array(self.core.encode_ordinary(text[start:stop]), np.int32), b[j:]])

    def _by_agreement(self, text, low, cut, high, a, b, reach):
        i, j = min(len(a), reach), min(len(b), reach)
        try:
            window = b"".join(self.piece[r] for r in (*a[len(a) - i :], *b[:j])).decode()
        except UnicodeDecodeError:
            return None
        # One class of characters, and some more of it on both sides, so that the run goes on beyond the window.
        before, after = len(b"".join(self.piece[r] for r in a[len(a) - i :]).decode(errors="ignore")), len(b"".join(self.piece[r] for r in b[:j]).decode(errors="ignore"))
        if cut - before - 1 < low or cut + after + 1 > high or not self.one_class.fullmatch(text[cut - before - 1 : cut + after + 1].lstrip(" ") if not window.isspace() else text[cut - before - 1 : cut + after + 1]) or window[0] == " " and not window.isspace():
            return None
        got = np.array(self.core.encode_ordinary(window), np.int32)
        if len(got) < 2 * AGREE or i <= AGREE or j <= AGREE or (got[:AGREE] != a[len(a) - i : len(a) - i + AGREE]).any() or (got[-AGREE:] != b[j - AGREE : j]).any():
            return None
        return np.concatenate([a[: len(a) - i], got, b[j:]])

    # Texts and ids

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; those of equal texts are one array."""
        distinct = {text: k for k, text in enumerate(dict.fromkeys(text or "" for text in texts))}
        ids = self._encoded(list(distinct))
        return [ids[distinct[text or ""]] for text in texts]

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        parts, owner = [], []
        for k, text in enumerate(texts):
            if self.special is not None and any(s in text for s in self.specials):
                for part in self.special.split(text):
                    if part:
                        parts.append(part)
                        owner.append(k)
            elif text:
                parts.append(text)
                owner.append(k)
        plain = [p for p in parts if p not in self.specials]
        made = iter(self.ranks(plain))
        out: list[list] = [[] for _ in texts]
        for part, k in zip(parts, owner, strict=True):
            out[k].append(np.array([self.specials[part]], np.uint32) if part in self.specials else self.id_of[next(made)])
        return [np.concatenate(x) if x else np.zeros(0, np.uint32) for x in out]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.by_id.__getitem__, ids.tolist())).decode(errors="replace")


def codec(name: str = VOCABULARY, leaf: int = LEAF) -> Codec:
    """The worker's own, kept from task to task."""
    return held(Codec, name, leaf)


def _batches(batches, text_at: int, most: int = 4 << 20):
    for batch in batches:
        step = max(1, int(most // max(1, batch.column(text_at).nbytes // max(1, batch.num_rows))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """One row per input row: id_col, ids."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.LongType()))])

    def run(batches):
        own = codec(vocabulary, leaf)
        for batch in _batches(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.int64) for x in own.encode(batch.column(1).to_pylist())], pa.list_(pa.int64()))], [id_col, "ids"])

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(trimmed(run), schema)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per input row: id_col, text; null ids count as none."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches):
        own = codec(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{ids_col}`")).mapInArrow(trimmed(run), schema)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """One row per input row: id_col, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256.

    Encoding, decoding and digests in one pass, so that ids and texts needn't leave the task.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *T.StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string").fields])

    def run(batches):
        own = codec(vocabulary, leaf)
        for batch in _batches(batches, 1):
            ids = own.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(own.decode(x).encode()).hexdigest() for x in ids], pa.string()),
            ], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(trimmed(run), schema)
