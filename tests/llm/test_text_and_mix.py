from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows
from llm_cases import KIND, odd_rows, word_soup
from loomgraph.llm import bpe, licenses, mixing, preferences, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# BPE


@pytest.fixture(scope="module")
def public():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def awkward_texts(seed, n):
    rnd = random.Random(seed)
    bits = ["a", "b", "ab", "é", "ü", "漢", "字", " ", "  ", "\n", "'s", "'", "'re", "1", "23", "!", "...", "\t", "\xa0", "　", "<|endoftext|>", "\U0001f600", "ing", " the", "\x1c", "ß"]
    out = ["".join(rnd.choice(bits[: rnd.randint(2, len(bits))]) for _ in range(rnd.randint(0, 250))) for _ in range(n)]
    out += ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(100, 3000))) for _ in range(n // 10)]
    out += [rnd.choice(["a", "ab", "the", " ", "\n", "!", "1", "漢", "\n ", "=-", "aé"]) * rnd.randint(50, 2000) for _ in range(n // 10)]
    out += ["".join(chr(rnd.randint(0x4E00, 0x9FFF)) for _ in range(600)) for _ in range(n // 20)]
    return out


@pytest.mark.parametrize("leaf", [16, 64, 500, 16384])
def test_tree_concatenation_is_exact(public, leaf):
    texts = awkward_texts(leaf, 200)
    want = [x.ids for x in public.encode_batch(texts, add_special_tokens=False)]
    codec = bpe.Codec(leaf=leaf)
    assert [list(map(int, x)) for x in codec.encode(texts)] == want
    assert [codec.decode(np.array(x, np.int64)) for x in want] == [public.decode(x, skip_special_tokens=False) for x in want]
    assert codec.decode(np.array([187, 188, 11], np.int64)) == public.decode([187, 188, 11], skip_special_tokens=False)


def test_encode_tables(public, odd, empty):
    want = []
    for r in odd_rows():
        ids = public.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(public.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows(bpe.round_trip(odd)) == sorted(want, key=repr)
    back = bpe.decode(bpe.encode(odd))
    assert rows(back) == sorted(((r[0], r[1] or "") for r in odd_rows()), key=repr)
    assert bpe.encode(empty).count() == bpe.round_trip(empty).count() == 0


def test_copies_are_encoded_once(monkeypatch):
    """Each copy that the mix took was encoded anew; the ids stay those of every row, in order."""
    codec, seen = bpe.Codec(leaf=64), []
    whole = codec.ranks
    monkeypatch.setattr(codec, "ranks", lambda texts: seen.extend(texts) or whole(texts))
    a, b = "some words of one text " * 9, "another <|endoftext|> text"
    got = [x.tolist() for x in codec.encode([a, a, None, b, a, "", b])]
    assert sorted(seen) == sorted([a, "another ", " text"])
    assert got == [codec.encode([t])[0].tolist() for t in (a, a, "", b, a, "", b)]


# Mixing


def brute_targets(totals, weights=(3.0, 1.0, 2.0), share=1.5, cap=2.0):
    names = sorted(totals, key=lambda s: (s is None, s))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, out, open_ = share * sum(totals.values()), {}, set(names)
    while open_:
        per = left / sum(w[s] for s in open_)
        full = {s for s in open_ if per * w[s] > cap * totals[s]}
        if not full:
            return out | {s: per * w[s] for s in open_}
        for s in full:
            out[s] = cap * totals[s]
            left -= out[s]
        open_ -= full
    return out


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    rnd = random.Random(seed)
    totals = {f"s{k}": rnd.choice([0, 5, 100, 1000, 7]) for k in range(rnd.randint(1, 9))} | {None: 50}
    df = spark.createDataFrame(list(totals.items()), "_source string, _total long")
    got = {r["_source"]: r["_target"] for r in mixing.targets(df).collect()}
    want = brute_targets(totals)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def brute_taken(keys, sizes, budget, extras=64):
    """Documents of one source by (key, identifier): a prefix, then what fits, then the smallest if nearer."""
    left, taken, whole, more = budget, set(), True, 0
    order = sorted(keys, key=lambda i: (keys[i], i))
    for i in order:
        fits = sizes[i] <= left
        whole = whole and fits
        if fits and (whole or more < extras):
            more += not whole
            taken.add(i)
            left -= sizes[i]
    rest = [(sizes[i], keys[i], i) for i in order if i not in taken and sizes[i]]
    if rest and min(rest)[0] - left < left:
        taken.add(min(rest)[2])
    return taken


@pytest.mark.parametrize("window", [1, 7, 50, 100_000])
def test_cut_of_any_fineness(spark, window):
    """Many documents in one bucket: with a small window it is cut finer and finer; a prefix is never lost."""
    rnd = random.Random(9)
    data = [(i, " ".join("w" * rnd.randint(0, 30)) or None, None, "big" if i % 10 else "small", None, *"cccccc") for i in range(3000)]
    df = spark.createDataFrame(data, KIND)
    weight = F.lit(1.0)
    got = mixing.plan(df.withColumn("q", weight), quality_col="q", share=0.8, window=window).collect()
    keys = {r[0]: r[1] for r in mixing._sized(df.withColumn("q", weight), "doc_id", "text", "source", "q", mixing.SEED).select("_id", "_key").collect()}
    for source in ("big", "small"):
        own = [r for r in got if r["source"] == source]
        sizes, target, total = {r["doc_id"]: r["size"] for r in own}, own[0]["target"], own[0]["source_size"]
        epochs = int(target / total + 1e-12)
        taken = {r["doc_id"] for r in own if r["copies"] > epochs}
        assert abs(sum(r["taken"] for r in own) - target) <= 30
        if window == 100_000:
            assert taken == brute_taken({i: keys[i] for i in sizes}, sizes, target - epochs * total)
        else:
            left, prefix = target - epochs * total, set()
            for i in sorted(sizes, key=lambda i: (keys[i], i)):
                left -= sizes[i]
                if left < 0:
                    break
                prefix.add(i)
            assert prefix <= taken and len(prefix) > 10


def test_many_sources(spark):
    """Targets don't depend on how sources are dealt out."""
    totals = {f"host{k:04}": (k * 37) % 211 + 1 for k in range(900)} | {None: 77}
    df = spark.createDataFrame(list(totals.items()), "_source string, _total long").repartition(9)
    got = {r["_source"]: r["_target"] for r in mixing.targets(df).collect()}
    want = brute_targets(totals)
    assert all(got[s] == pytest.approx(want[s]) for s in want) and len(got) == len(want)


def test_plan(spark, odd, empty):
    rnd = random.Random(2)
    data = [(i, word_soup(rnd, rnd.randint(0, 60)) or None, "en", rnd.choice(["a", "b", "c", "d", None]), None, *"cccccc") for i in range(600)]
    df = spark.createDataFrame(data, KIND)
    got = mixing.plan(df).collect()
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in data}
    source = {r[0]: r[3] for r in data}
    totals = {s: sum(size[i] for i in size if source[i] == s) for s in set(source.values())}
    want = brute_targets(totals)
    taken = dict.fromkeys(totals, 0)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == totals[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        epochs = int(want[r["source"]] / totals[r["source"]] + 1e-12)
        assert epochs <= r["copies"] <= epochs + 1 and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in totals:
        assert abs(taken[s] - want[s]) <= max(size.values())
    assert rows(mixing.plan(df.repartition(7))) == rows(mixing.plan(df))
    assert mixing.plan(empty).count() == mixing.mixed(empty).count() == 0
    odd_plan = mixing.plan(odd)
    assert odd_plan.count() == len(odd_rows())
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and out.count() == odd_plan.agg(F.sum("copies")).first()[0]


def test_keys_follow_quality(spark):
    """Documents of weight 9 are taken far more often than those of weight 1; the order is that of -ln(u) / weight."""
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"), F.when(F.col("id") % 2 == 0, 9.0).otherwise(1.0).alias("q"))
    got = mixing.plan(df, quality_col="q", share=0.25, cap=1.0)
    good, all_ = got.filter("taken > 0 and doc_id % 2 = 0").count(), got.filter("taken > 0").count()
    assert abs(all_ - 1000) <= 1 and good > 0.8 * all_


# Sharding


def test_shards(spark, odd, empty):
    rnd = random.Random(4)
    data = [(i, word_soup(rnd, rnd.randint(1, 80)), None, None, None, *"cccccc") for i in range(3000)]
    df = spark.createDataFrame(data, KIND)
    got = sharding.shard(df, shards=7, slots=256).collect()
    load, places = [0] * 7, {}
    for r in got:
        text = data[r["doc_id"]][1].encode()
        assert r["size"] == len(text) + 16 and r["text_crc32"] == zlib.crc32(text)
        load[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in places.values()) and len(places) == 7
    assert max(load) - min(load) <= max(r["size"] for r in got) * 12  # less than a virtual slot
    odd_got = sharding.shard(odd, shards=3, slots=16).collect()
    assert len(odd_got) == len(odd_rows())
    for k in range(3):
        slots = [r["slot"] for r in odd_got if r["shard"] == k]
        assert sorted(slots) == list(range(len(slots)))
    assert sharding.shard(empty).count() == 0
    assert sharding.shard(df, shards=1, slots=8).select("shard").distinct().count() == 1


def test_map_is_edited_and_kept(spark, odd, tmp_path):
    recs = sharding.records(odd, slots=64)
    first = sharding.first_map(sharding.slot_sizes(recs, 64), 4)
    assert first.count() == 64
    more = sharding.with_one_more(first)
    before = {r["virtual_slot"]: r["shard"] for r in first.collect()}
    after = {r["virtual_slot"]: r["shard"] for r in more.collect()}
    assert all(after[s] in (before[s], 4) for s in before)
    sharding.store_map(first, str(tmp_path / "map"))
    sharding.store_map(more, str(tmp_path / "map"))
    assert rows(sharding.read_map(spark, str(tmp_path / "map")).select("virtual_slot", "shard")) == sorted(after.items(), key=repr)
    assert rows(sharding.read_map(spark, str(tmp_path / "map"), 1).select("virtual_slot", "shard")) == sorted(before.items(), key=repr)


def test_one_more_and_rebalance_even_out(spark):
    sizes = spark.range(64).select(F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % 9 + 20).alias("bytes"), F.lit(1).cast("long").alias("rows"))
    m = sharding.first_map(sizes, 4)
    loads = lambda t: [r[1] for r in sorted((r[0], r[1]) for r in t.groupBy("shard").agg(F.sum("bytes")).collect())]
    grown = loads(sharding.with_one_more(m))
    assert len(grown) == 5 and max(grown) < 1.5 * min(grown)
    changed = sizes.withColumn("bytes", F.when(F.col("virtual_slot") % 4 == 0, F.col("bytes") * 3).otherwise(F.col("bytes")))
    again = sharding.rebalanced(m, changed)
    assert again.count() == 64 and again.first()["version"] == 2
    stale = loads(m.drop("bytes").join(changed.select("virtual_slot", "bytes"), "virtual_slot"))
    assert max(loads(again)) - min(loads(again)) <= max(stale) - min(stale)


# Preferences


def turns(pair, side, *texts):
    return [(pair, side, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]


def test_preferences(spark):
    data = turns(1, "chosen", "hi", "hello", "q", "good") + turns(1, "rejected", "hi", "hello", "q", "bad", "why") + turns(2, "chosen", "same", "x") + turns(2, "rejected", "same", "x") + turns(3, "chosen", "alone")
    data += [(4, "chosen", 0, None, None), (4, "rejected", 0, "user", ""), (None, "chosen", 0, "user", "z"), (5, "other", 0, "user", "z"), (6, "chosen", 0, "assistant", "é"), (6, "rejected", 0, "assistant", "ab")]
    df = spark.createDataFrame(data, "pair_id long, side string, turn int, role string, text string")
    got = {r["pair_id"]: r for r in preferences.format_pairs(df).collect()}
    assert set(got) == {1, 2, 3, 4, 6}
    show = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got[1]["n_common"] == 3 and got[1]["prompt"] == show("user", "hi") + show("assistant", "hello") + show("user", "q")
    assert got[1]["chosen"] == show("assistant", "good") and got[1]["rejected"] == show("assistant", "bad") + show("user", "why")
    for pair, side, want in ((1, "chosen", ["good<|im_end|>"]), (1, "rejected", ["bad<|im_end|>"]), (6, "chosen", ["é<|im_end|>"]), (6, "rejected", ["ab<|im_end|>"])):
        spans = [tuple(map(int, s.split("-"))) for s in got[pair][f"{side}_spans"].split(",")]
        assert [got[pair][side][a:b] for a, b in spans] == want
    assert (got[2]["n_common"], got[2]["chosen"], got[2]["rejected"], got[2]["chosen_spans"]) == (2, "", "", "")
    assert (got[3]["n_common"], got[3]["prompt"], got[3]["rejected"]) == (0, "", None)
    assert got[4]["n_common"] == 1
    assert preferences.format_pairs(df.limit(0)).count() == 0


# Licenses


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["AGPL-3.0"]),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["LGPL-3.0"]),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ["LGPL-2.1"]),
        ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General\n# Public License as published by the Free Software Foundation, either version\n# 3 of the License, or (at your option) any later version.", ["GPL-3.0"]),
        ("Licensed under the Apache License, Version 1.1.", []),
        ("Licensed under the Apache License 2.0.", ["Apache-2.0"]),
        ("Released under the BSD License.", []),
        ("Licensed under CC BY 3.0.", []),
        ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0"]),
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", ["CC-BY-ND-4.0"]),
        ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]),
        ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", ["EPL-2.0"]),
        ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.', ["MIT"]),
    ],
)
def test_licenses_and_their_kin(text, want):
    assert [name for name, *_ in licenses.scan(f"Some words. {text} More words.", licenses.standard_index())] == want


def test_each_template_is_found_as_its_own():
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            assert (name, 1.0) in [r[:2] for r in licenses.scan(text, licenses.standard_index())], text


def test_licenses(spark, odd, empty):
    mit = licenses.TEMPLATES["MIT"][2]
    texts = ["plain text", f"before {mit.upper()} after", mit.replace("free of charge", "free of any charge").replace("publish, ", ""), "This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License.", "Released under the MIT License. words Released under the MIT license", "licensed under the Apache", "é Licensed under CC BY-NC 4.0."]
    df = spark.createDataFrame([(i, t, None, None, None, *"cccccc") for i, t in enumerate(texts)], KIND)
    got = {(r["doc_id"], r["license"]): r for r in licenses.find(df).collect()}
    assert set(got) == {(1, "MIT"), (2, "MIT"), (3, "GPL-3.0"), (3, "MIT"), (4, "MIT"), (6, "CC-BY-NC-4.0")}
    assert got[1, "MIT"]["coverage"] == 1.0 and 0.95 < got[2, "MIT"]["coverage"] < 1
    for i, name in ((3, "MIT"), (6, "CC-BY-NC-4.0")):
        (span,) = got[i, name]["spans"]
        assert texts[i][span["start"] : span["stop"]] in licenses.TEMPLATES[name]
    assert len(got[4, "MIT"]["spans"]) == 2
    assert licenses.find(odd).count() == licenses.find(empty).count() == 0


def brute_coverage(template, words):
    """Longest common subsequence of a template with any window a little longer than it."""
    best, n = 0, len(template)
    for at in range(-2, len(words)):
        part = words[max(0, at) : at + n + 8]
        table = [0] * (len(part) + 1)
        for w in template:
            above = 0
            for j, p in enumerate(part):
                above, table[j + 1] = table[j + 1], max(table[j + 1], table[j], above + (w == p))
        best = max(best, table[-1])
    return best


def test_alignment_reaches_what_brute_force_finds():
    rnd = random.Random(1)
    index = licenses.Index({"T": ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu",)})
    words = [w.decode() for w in index.items[0][1]]
    for _ in range(60):
        cut = [w for w in words if rnd.random() > 0.1]
        for _ in range(rnd.randint(0, 2)):
            cut.insert(rnd.randrange(len(cut)), "noise")
        text = ["noise"] * rnd.randint(0, 5) + cut + ["noise"] * 3
        want = brute_coverage(words, text)
        found = licenses.scan(" ".join(text), index)
        if want < 0.8 * len(words):
            assert not found
        elif any(text[i : i + 4] == words[j : j + 4] for i in range(len(text)) for j in range(len(words) - 3)):
            assert found and found[0][2] == want
