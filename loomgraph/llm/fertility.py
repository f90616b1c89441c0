"""Quality rules from tokeniser fertility.

Each word of a text is encoded, with a leading space, by a public vocabulary. Three measures follow: characters per
token, the share of byte-fallback tokens (pieces that aren't whole characters), and the entropy of the text's tokens
in bits. Bands per language, else per script, reject a text whose measure is outside. Words are encoded once and
remembered, in a cache of bounded size that never changes a result.

Base rules, on words between ASCII whitespace: at least 50 words, and at most half of them in 3-word windows that occur
twice or more.

Defined cases: a null or wordless text has zero counts, null measures, and fails the base rules; a null or unknown
language uses the band of the text's script; nulls in other columns don't matter; repeated rows give repeated rows; an
empty table gives an empty result. ``measure`` returns only its own columns, ``keep_good`` the input's, unchanged.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITESPACE, held, trimmed

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: By language, else by script: least and most characters a token, most byte-fallback share, and the least entropy as
#: a share of the most that so many tokens (256 at most) can have. Floors lie a little under what rows labelled good
#: show, ceilings leave room for prose that the vocabulary knows well.
LANGUAGE_BANDS = {"en": (1.90, 7.0, 0.05, 0.735), "de": (2.05, 7.0, 0.10, 0.735), "fr": (1.75, 7.0, 0.10, 0.735), "es": (1.85, 7.0, 0.10, 0.735)}
SCRIPT_BANDS = {"latin": (1.5, 8.0, 0.15, 0.70), "other": (0.3, 8.0, 0.95, 0.60)}
CACHE_WORDS, CHUNK_BYTES = 100_000, 4 << 20
_SYMBOLS = b"#*$%&|<>"


def vocabulary(name: str = VOCABULARY):
    """(encode a list of texts to lists of ids, array that says which ids are byte fallback)."""
    import public_tokenizers

    path = name if "/" in name else public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda texts: model.encode(texts, num_threads=1)), np.array([model.is_byte(i) for i in range(model.get_piece_size())])
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    model = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    partial = np.zeros(max(ranks.values()) + 1, bool)
    for piece, i in ranks.items():
        try:
            piece.decode()
        except UnicodeDecodeError:
            partial[i] = True
    return (lambda texts: [model.encode_ordinary(t) for t in texts]), partial


def encoder_of(name: str) -> Encoder:
    """The worker's own, kept from task to task."""
    return held(Encoder, name)


class Encoder:
    """Words to token ids, remembered: ``ids[start[w]:start[w + 1]]`` are those of word number w."""

    def __init__(self, name: str):
        self.encode, self.partial = vocabulary(name)
        self._clear()

    def _clear(self):
        self.number: dict[bytes, int] = {}
        self.ids, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def numbers(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.number) > CACHE_WORDS:
            self._clear()
        known = self.number
        new = list({w: None for words in texts for w in words if w not in known})
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            found = self.encode([" " + w.decode() for w in new])
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.int32, int(sizes.sum()))])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
        return [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in texts]

    def tokens(self, numbers: np.ndarray) -> np.ndarray:
        first, size = self.start[numbers], self.start[numbers + 1] - self.start[numbers]
        ends = np.cumsum(size)
        return self.ids[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def repeated_words(numbers: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows of so many words that are found twice or more."""
    n = len(numbers) - window + 1
    if n < 2:
        return 0
    _, small = np.unique(numbers, return_inverse=True) if numbers.max() >= 1 << 20 else (None, numbers)
    key = np.zeros(n, np.int64)
    for k in range(window):
        if k and key.max() >= 1 << 42:  # keep keys in 63 bits
            key = np.unique(key, return_inverse=True)[1]
        key = (key << 20) + small[k : k + n]
    ordered = np.sort(key)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    again = again[np.append(True, again[1:] != again[:-1])]
    hit = again[np.minimum(np.searchsorted(again, key), len(again) - 1)] == key
    covered = np.zeros(len(numbers), bool)
    for k in range(window):
        covered[k : k + n] |= hit
    return int(covered.sum())


def duplicate_lines(raw: bytes) -> int:
    lines = raw.split(b"\n")
    if len(lines) == len(set(lines)):
        return 0
    seen, n = set(), 0
    for line in lines:
        if line in seen:
            n += bool(line.strip(WHITESPACE))
        seen.add(line)
    return n


def script(text: str) -> str:
    """The script of most letters of a text; latin if it has none."""
    letters = {c: n for c, n in Counter(text).items() if c.isalpha()}
    return "latin" if 2 * sum(n for c, n in letters.items() if ord(c) < 0x250) >= sum(letters.values()) else "other"


def verdict(chars_per_token: float, fallback: float, entropy: float, n_tokens: int, band: tuple) -> bool:
    low, high, most, share = band
    return low <= chars_per_token <= high and fallback <= most and entropy >= share * np.log2(max(2, min(n_tokens, 256)))


def measures(texts: list[str | None], langs: list[str | None], encoder: Encoder, language_bands: dict, script_bands: dict) -> list[tuple]:
    raws = [(t or "").encode() for t in texts]
    split = [raw.split() for raw in raws]
    out = []
    for text, lang, raw, numbers in zip(texts, langs, raws, encoder.numbers(split), strict=True):
        n, tokens = len(numbers), encoder.tokens(numbers)
        word_chars = len(text or "") - (len(raw) - len(raw.translate(None, WHITESPACE)))
        repeat = repeated_words(numbers)
        failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
        per_token = fallback = entropy = None
        good = False
        if len(tokens):
            ordered = np.sort(tokens)
            counts = np.diff(np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])))
            entropy = float(max(0.0, np.log2(len(tokens)) - (counts * np.log2(counts)).sum() / len(tokens)))
            per_token, fallback = word_chars / len(tokens), float(encoder.partial[tokens].mean())
            band = language_bands.get(lang) or script_bands[script(text)]
            good = verdict(per_token, fallback, entropy, len(tokens), band)
        out.append((n, word_chars, len(raw) - len(raw.translate(None, _SYMBOLS)), duplicate_lines(raw), repeat, failed, bool(good and not failed), len(tokens), per_token, fallback, entropy))
    return out


def _chunks(batch: pa.RecordBatch, text_at: int):
    """Parts of a batch of bounded size; a single longer text is a part of its own."""
    sizes = batch.column(text_at).nbytes / max(1, batch.num_rows)
    step = max(1, int(CHUNK_BYTES // max(1.0, sizes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


_OWN = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, fallback_share double, token_entropy double"


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", vocabulary_name: str = VOCABULARY, language_bands: dict = LANGUAGE_BANDS, script_bands: dict = SCRIPT_BANDS) -> DataFrame:
    """One row per input row: id_col, base counts and verdict, kept, and the three measures."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *T.StructType.fromDDL(_OWN).fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        encoder = encoder_of(vocabulary_name)
        for batch in batches:
            for part in _chunks(batch, 1):
                rows = measures(part.column(1).to_pylist(), part.column(2).to_pylist(), encoder, language_bands, script_bands)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types[1:], strict=True))], schema=arrow)

    lang = F.col(f"`{lang_col}`").cast("string") if lang_col else F.lit(None).cast("string")
    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), lang.alias("_lang")).mapInArrow(trimmed(run), schema)


def keep_good(df: DataFrame, text_col: str = "text", lang_col: str | None = "lang", vocabulary_name: str = VOCABULARY, language_bands: dict = LANGUAGE_BANDS, script_bands: dict = SCRIPT_BANDS) -> DataFrame:
    """The rows that are kept, with all columns of the input."""
    text_at, lang_at = df.columns.index(text_col), df.columns.index(lang_col) if lang_col else None

    def run(batches):
        encoder = encoder_of(vocabulary_name)
        for batch in batches:
            for part in _chunks(batch, text_at):
                langs = part.column(lang_at).to_pylist() if lang_at is not None else [None] * part.num_rows
                rows = measures(part.column(text_at).to_pylist(), langs, encoder, language_bands, script_bands)
                yield part.filter(pa.array([r[6] for r in rows], pa.bool_()))

    return df.mapInArrow(trimmed(run), df.schema)
