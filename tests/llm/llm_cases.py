"""Small tables with every odd case: nulls, empty and very long texts, ties, repeats, columns with clashing names."""

from __future__ import annotations

import random


KIND = "doc_id long, text string, lang string, source string, n_chars long, _id string, kept string, size string, component_id string, a string, _text string"


def word_soup(rnd: random.Random, n: int) -> str:
    parts = ["th", "an", "re", "ing", "on", "er", "ti", "es"]
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def odd_rows() -> list[tuple]:
    rnd = random.Random(7)
    base = [word_soup(rnd, 90) for _ in range(4)]
    passage = word_soup(rnd, 120)
    texts = [None, "", " ", "\n\t ", "one", "two words", *base, base[0], base[0].replace(" ", "  "), base[1] + " more", base[2][:-3] + "xyz", word_soup(rnd, 60) + " " + passage, passage + " " + word_soup(rnd, 60), passage, "# * $ % & | < >\nsame line\nsame line\n\n\n", "é 漢字 \U0001f600 <|endoftext|> 'll", word_soup(rnd, 6000), "x" * 40_000, "ab " * 5_000]
    rows = [(i, t, ["en", "de", None, "xx"][i % 4], ["s1", "s2", "s1", None, "s0"][i % 5], None, "c", "c", "c", "c", "c", "c") for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, base[0], "en", None, 1, *"cccccc"), (None, "nameless text", None, "s1", 1, *"cccccc"), (None, None, None, None, None, *[None] * 6)]
    return rows


