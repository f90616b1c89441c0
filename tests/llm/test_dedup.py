from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from helpers import rows
from llm_cases import KIND, odd_rows, word_soup
from loomgraph.llm import exact_dedup, simhash, substrings
from loomgraph.llm.components import roots

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def normal(text):
    return SPACE.sub(" ", text or "")


# Exact


@pytest.mark.parametrize("limit", [1 << 30, 2000])
def test_trie_against_a_dictionary(limit):
    rnd = random.Random(limit)
    trie, want = exact_dedup.PatriciaTrie(lambda a, b: a + b, limit), {}
    for _ in range(3000):
        key = bytes(rnd.choice(b"ab\0\xff") for _ in range(rnd.randint(0, 12)))
        trie.insert(key, 1)
        want[key] = want.get(key, 0) + 1
    got = list(trie.items())
    assert len(got) == len(want) and dict(got) == want


def check_groups(got, given):
    groups = {}
    for i, text in given:
        groups.setdefault(normal(text), []).append(i)
    assert len(got) == len(given)
    for r in got:
        assert r["text_sha256"] in {hashlib.sha256(t.encode()).hexdigest() for t in groups}
    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = {}
    for r in got:
        ids = by[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert r["keep_id"] == (min(known) if known else None) and r["group_size"] == len(ids)
        kept[r["text_sha256"]] = kept.get(r["text_sha256"], 0) + r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}


def test_groups(odd, empty):
    check_groups(exact_dedup.groups(odd).collect(), [(r[0], r[1]) for r in odd_rows()])
    assert exact_dedup.groups(empty).count() == 0


def test_colliding_hashes_and_spill_change_nothing(odd):
    """Every text has the same content hash here, so only the tries tell texts apart."""
    check_groups(exact_dedup.groups(odd, limit=5000, hashed=lambda t: "same").collect(), [(r[0], r[1]) for r in odd_rows()])


def test_keep_first(odd, empty):
    got = exact_dedup.keep_first(odd)
    assert got.columns == odd.columns and got.schema == odd.schema
    best = {}
    for r in odd_rows():
        k = normal(r[1])
        if k not in best or best[k][0] is None or (r[0] is not None and r[0] < best[k][0]):
            best[k] = r
    assert rows(got) == sorted(best.values(), key=repr)
    assert exact_dedup.keep_first(empty).count() == 0


# SimHash


def brute_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    left, out = set(fps), {}
    while left:
        todo, part = [left.pop()], set()
        while todo:
            x = todo.pop()
            part.add(x)
            near = {y for y in left if bin(x ^ y).count("1") <= radius}
            left -= near
            todo += near
        for x in part:
            out[x] = frozenset(part)
    return out


@pytest.mark.parametrize(("radius", "tile"), [(4, 1 << 16), (4, 2), (12, 3)])
def test_components(odd, empty, radius, tile):
    given = [(r[0], brute_fingerprint(r[1], 4)) for r in odd_rows()]
    of = brute_components([f for _, f in given], radius)
    want = []
    for i, f in given:
        ids = [j for j, g in given if g in of[f] and j is not None]
        want.append((i, f"{f:016x}", min(ids) if ids else None))
    assert rows(simhash.components(odd, radius=radius, tile=tile)) == sorted(want, key=repr)
    assert simhash.components(empty).count() == 0


def test_forest_connects_what_links_connect():
    rnd = np.random.default_rng(3)
    for _ in range(30):
        a = rnd.integers(0, 1 << 10, (rnd.integers(1, 60), 1)).astype(np.uint64)
        b = rnd.integers(0, 1 << 10, (rnd.integers(1, 60), 1)).astype(np.uint64)
        for two in (None, b):
            own = a if two is None else np.concatenate([a, b])
            found = simhash.forest(a, two, 1, block=7)
            assert len(found) < len(own)
            parent = list(range(len(own)))

            def top(i, parent=parent):
                while parent[i] != i:
                    i = parent[i]
                return i

            for i, j in found:
                assert top(i) != top(j)
                parent[top(i)] = top(j)
            other = range(len(a)) if two is None else range(len(a), len(own))
            for i in range(len(a)):
                for j in other:
                    if bin(int(own[i, 0]) ^ int(own[j, 0])).count("1") <= 1:
                        assert top(i) == top(j)


def test_keep_one(spark, odd, empty):
    rnd = random.Random(5)
    base = word_soup(rnd, 400).split()
    near = base.copy()
    near[200] = "changed"
    texts = [" ".join(base), " ".join(near), word_soup(rnd, 400), word_soup(rnd, 300)]
    df = spark.createDataFrame([(i, t, None, None, None, *"cccccc") for i, t in enumerate(texts)], KIND)
    assert [r[0] for r in rows(simhash.keep_one(df))] == [0, 2, 3]
    got = simhash.keep_one(odd)
    assert got.columns == odd.columns and simhash.keep_one(empty).count() == 0
    texts = {normal(r["text"]).strip() for r in got.collect()}
    assert "one" in texts and "two words" in texts and "nameless text" in texts
    ids = [r["doc_id"] for r in got.collect() if r["doc_id"] is not None]
    assert len(ids) == len(set(ids))
    assert "one" in texts and len(got.filter("doc_id = 6").collect()) == 1  # a row that stands three times


def test_keep_one_decides_by_identifier_and_text(spark):
    """Rows of one identifier with texts of their own all stay; only the copies of one text go."""
    rnd = random.Random(8)
    texts = [word_soup(rnd, 200) for _ in range(4)]
    data = [(1, texts[0]), (1, texts[1]), (1, texts[2]), (2, texts[0] + " more"), (None, texts[3]), (None, texts[3] + " more"), (3, texts[2] + " more"), (0, texts[3] + " and more")]
    df = spark.createDataFrame([(i, t, None, None, None, *"cccccc") for i, t in data], KIND)
    assert {(r["doc_id"], r["text"]) for r in simhash.keep_one(df).collect()} == {(1, texts[0]), (1, texts[1]), (1, texts[2]), (0, texts[3] + " and more")}


def test_keep_one_carries_columns_of_clashing_names(spark):
    df = spark.createDataFrame([(1, "a text of a few words here", b"r", 5, 6), (2, "another one that is not alike at all", None, 5, 6)], "doc_id long, text string, _row binary, _all long, _key long")
    assert sorted(map(tuple, simhash.keep_one(df).collect())) == sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("group_tile", "tile_bytes"), [(simhash.GROUP_TILE, simhash.TILE_BYTES), (3, 5_000)])
def test_near_components_against_exact_similarities(spark, group_tile, tile_bytes):
    """Texts between 0.7 and 0.9 alike: components are those of exact links, pairs just below 0.8 aren't linked."""
    rnd = random.Random(14)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(260)]
        for changed in (0, 4, 5, 6, 7):
            one = base.copy()
            for j in range(changed):
                one[(17 + 31 * j + rnd.randint(0, 9)) % 256] = word()
            texts.append(" ".join(one))
    sets = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in texts]
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    near = 0
    for i in range(len(texts)):
        for j in range(i):
            alike = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            near += 0.77 < alike < 0.8
            if alike >= 0.8:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    df = spark.createDataFrame([(i, t, None, None, None, *"cccccc") for i, t in enumerate(texts)], KIND)
    kept = sorted(r["doc_id"] for r in simhash.keep_one(df, group_tile=group_tile, tile_bytes=tile_bytes).collect())
    assert near > 5 and kept == sorted({top(i) for i in range(len(texts))})


def test_a_repeated_line_does_not_make_near_copies(spark):
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    line = " ".join(word() for _ in range(10))

    def text(times):
        own = [" ".join(word() for _ in range(1400 // times)) for _ in range(times)]
        return " ".join(f"{part} {line}" for part in own)

    for times in (40, 60):
        df = spark.createDataFrame([(i, text(times), None, None, None, *"cccccc") for i in range(4)], KIND)
        assert [r[0] for r in rows(simhash.keep_one(df))] == [0, 1, 2, 3]


def test_similarity_as_bits():
    assert simhash.differing_bits(1.0, 8) == 0 and 70 < simhash.differing_bits(0.8, 8) < 85 and simhash.differing_bits(0.0, 8) == 256
    assert simhash.differing_bits(0.8, 8) < simhash.differing_bits(0.8, 8, 3.0) < simhash.differing_bits(0.6, 8)


def test_wide_fingerprint_against_brute_force():
    mask = (1 << 64) - 1

    def mixed(h, step):
        z = (h + step * 0x9E3779B97F4A7C15) & mask
        z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & mask
        return z ^ z >> 31

    for n in (0, 1, 4, 5, 60, 700):
        text = word_soup(random.Random(n), n)
        words = text.lower().split()
        hashes = sorted({xxhash.xxh64_intdigest(" ".join(words[i : i + 5]), 42) for i in range(max(1, len(words) - 4))}) if words else []
        want = [[h if w == 0 else mixed(h, w) for h in hashes] for w in range(3)]
        want = [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) for hs in want]
        assert simhash.wide_fingerprint(text, words=3).view(np.uint64).tolist() == want


def pairs_of_similarity(rnd, changed, n, count):
    """Texts of different words, a word changed at so many places: n - 4 shingles, 5 of them gone with each."""
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    for _ in range(count):
        one = [word() for _ in range(n)]
        two = one.copy()
        for j in range(changed):
            two[10 + (n - 20) // changed * j] = word()
        yield " ".join(one), " ".join(two)


@pytest.mark.parametrize(("changed", "n", "least", "most"), [(5, 310, 0.99, 1), (6, 300, 0.9, 1), (9, 300, 0, 0.1)])
def test_links_follow_the_similarity(changed, n, least, most):
    """Similarities of 0.849, 0.816 and 0.736 by the rules of near dedup: both the wide step and the narrow one."""
    linked = 0
    for x, y in pairs_of_similarity(random.Random(31), changed, n, 200):
        a, b = (simhash.wide_fingerprint(t).view(np.uint64)[None, :] for t in (x, y))
        first = simhash.forest(a[:, : simhash.FIRST], b[:, : simhash.FIRST], simhash.WIDE_RADIUS, simhash.differing_bits(0.8, simhash.FIRST, 3.0))
        linked += bool(first) and bool(simhash.forest(a, b, simhash.WIDE_RADIUS, simhash.differing_bits(0.8, simhash.WORDS, 0.5)))
    assert least <= linked / 200 <= most


@pytest.mark.parametrize("group_tile", [simhash.GROUP_TILE, 2])
def test_groups_follow_links_not_the_wide_step(spark, group_tile):
    """A center with variants that are near copies of it, not of each other, and pairs that only the wide step links."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    base = [word() for _ in range(300)]
    texts = []
    for k in range(6):  # each 0.87 like the center, 0.76 like one another
        one = base.copy()
        for j in range(4):
            one[8 + 45 * j + 6 * k] = word()
        texts.append(" ".join(one))
    texts.append(" ".join(base))
    texts += [t for pair in pairs_of_similarity(rnd, 9, 300, 3) for t in pair]
    df = spark.createDataFrame([(i, t, None, None, None, *"cccccc") for i, t in enumerate(texts)], KIND)
    assert sorted(r[0] for r in simhash.keep_one(df, group_tile=group_tile).collect()) == [0, *range(7, 13)]


def test_roots(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 3), (5, 4), (4, 1), (7, 9)], "a long, b long")
    assert rows(roots(links, "a", "b")) == [(2, 1), (3, 1), (4, 1), (5, 1), (8, 7), (9, 7)]
    assert rows(roots(links.unionByName(spark.createDataFrame([(None, 1), (2, None)], "a long, b long")), "a", "b")) == rows(roots(links, "a", "b"))
    assert roots(links.limit(0), "a", "b").count() == 0


# Substrings


def brute_repeats(texts, length):
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_transform_against_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        length, letters = rnd.choice([1, 2, 3, 5, 8, 20]), rnd.choice([b"ab", b"abcd", bytes(range(256))])
        base = [bytes(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(4)]
        pieces = [b"".join(rnd.choice(base)[rnd.randint(0, 5) :] for _ in range(rnd.randint(0, 4))) for _ in range(rnd.randint(1, 6))] + [b"a" * rnd.randint(0, 40)]
        seen = {}
        for p in pieces:
            for i in range(len(p) - length + 1):
                seen[p[i : i + length]] = seen.get(p[i : i + length], 0) + 1
        want = [[i for i in range(len(p) - length + 1) if seen[p[i : i + length]] > 1] for p in pieces]
        assert [list(map(int, g)) for g in substrings.repeated(pieces, length)] == want


@pytest.mark.parametrize(("length", "gram", "piece", "group"), [(400, 48, 1 << 20, 1 << 20), (50, 8, 500, 1 << 20), (50, 8, 500, 0)])
def test_removal(spark, odd, length, gram, piece, group):
    """With a group bound of zero, every open anchor is divided down to single windows."""
    given = [(r[0], (r[1] or "").encode()) for r in odd_rows()]
    want = sorted(((i, *x) for (i, _), x in zip(given, brute_repeats([t for _, t in given], length))), key=repr)
    got = [(r["doc_id"], r["n_bytes"], sum(s["stop"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in substrings.remove(odd, length=length, gram=gram, piece=piece, group=group).collect()]
    assert sorted(got, key=repr) == want


@pytest.mark.parametrize("group", [substrings.GROUP_BYTES, 0])
def test_repeats_within_one_item(spark, group):
    """Periodic texts whose windows have one anchor that stands nowhere else."""
    rnd = random.Random(11)
    line = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    texts = [line(100) * 6, "-" * 401, "=" * 911, (line(37) * 20)[:500], line(350) * 2, line(300) + line(90) * 7 + line(300), "_" * 400, line(600), (line(48) + line(200)) * 2]
    for given in [[t] for t in texts] + [texts]:
        df = spark.createDataFrame([(i, t, None, None, None, *"cccccc") for i, t in enumerate(given)], KIND)
        got = [(r["n_bytes"], sum(s["stop"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in sorted(substrings.remove(df, group=group).collect(), key=lambda r: r["doc_id"])]
        assert got == brute_repeats([t.encode() for t in given], 400)
    assert brute_repeats([texts[0].encode()], 400)[0][1] == 600


@pytest.mark.parametrize("group", [substrings.GROUP_BYTES, 1 << 12, 1 << 10])
def test_a_passage_in_many_settings(spark, group):
    """One anchor gathers far more than its bound: passages shorter and longer than a match, between texts of their own."""
    rnd = random.Random(17)
    letters = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passages = [letters(n) for n in (390, 399, 401, 430)]
    texts = [letters(rnd.randint(0, 120)) + p + letters(rnd.randint(0, 120)) for p in passages for _ in range(12)]
    texts += [passages[2][:200] + letters(3) + passages[2][203:] + "." * 500, "x" * 700, "x" * 460 + letters(40)]
    df = spark.createDataFrame([(i, t, None, None, None, *"cccccc") for i, t in enumerate(texts)], KIND)
    got = [(r["n_bytes"], sum(s["stop"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in sorted(substrings.remove(df, group=group).collect(), key=lambda r: r["doc_id"])]
    assert got == brute_repeats([t.encode() for t in texts], 400)


def test_removal_of_nothing(empty):
    assert substrings.remove(empty).count() == 0
