"""Prefix trie, spelling variants and WARC archives against brute force, with the odd cases."""

from __future__ import annotations

import hashlib
import io
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import zstandard

from loomgraph.llm import prefix_trie, variants, warc

TURNS = "conv_id long, turn long, role string, text string, _c string, _key string, _n string, depth string"


def trie_by_hand(rows, rebuild=True):
    convs = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            convs[c].append(((t is not None, t or 0), r or "", hashlib.sha256((x or "").encode()).digest(), x or ""))
    convs = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        whole[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    members, kids, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[x] for x in kids[k])
    ends = {k: ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(k)))) for k, m in members.items()}
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items())


def in_order(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.fixture(scope="module")
def conversations():
    rnd = random.Random(3)
    extra = ["c"] * 4
    rows = [(c, t, rnd.choice(["user", "assistant"]), rnd.choice(["hé", "yes", "no 漢\U0001f600"]), *extra) for c in range(320) for t in range(rnd.randint(1, 5))]
    rows += [(c, t, "user", f"same {t}", *extra) for c in range(400, 460) for t in range(4)]  # one conversation many times
    rows += [(500, t, "user", f"long {t % 7}", *extra) for t in range(70)] + [(501, t, "user", f"long {t % 7}", *extra) for t in range(64)]  # deeper than 64
    rows += [(300, None, None, None, *extra), (300, None, "user", "first", *extra), (301, 1, "user", "tie b", *extra), (301, 1, "user", "tie a", *extra), (302, 2, "user", "twice", *extra), (302, 2, "user", "twice", *extra)]
    rows += [(None, 0, "user", "of none", *extra), (700, 0, "user", None, *extra), (701, 0, None, "", *extra)]
    return rows


def test_trie_of_rebuilt_conversations(spark, conversations, monkeypatch):
    df = spark.createDataFrame(conversations, TURNS).repartition(5)
    assert in_order(prefix_trie.rebuilt_trie(df)) == sorted(trie_by_hand(conversations), key=lambda r: tuple((x is not None, x) for x in r))


def test_trie_of_conversations_as_they_are(spark, conversations):
    df = spark.createDataFrame(conversations, TURNS)
    found = in_order(prefix_trie.prefix_trie(df))
    assert found == sorted(trie_by_hand(conversations, rebuild=False), key=lambda r: tuple((x is not None, x) for x in r))
    assert max(r[1] for r in found) == 70


def test_a_nodes_ends_stream_through_blocks(spark, conversations):
    df = spark.createDataFrame(conversations, TURNS)
    rows = prefix_trie.numbered(df).cache()
    paths = prefix_trie.paths(rows, rows.groupBy("_c").max("_p").toDF("_c", "_total"))
    assert sorted(map(tuple, prefix_trie.ends(paths, 7).collect())) == sorted(map(tuple, prefix_trie.ends(paths).collect()))


def test_a_conversation_spreads_over_ranges(spark):
    rows = [(9, t, "user", f"t{t}") for t in range(5_000)]
    numbered = prefix_trie.numbered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).cache()
    assert numbered.select("_seg").distinct().count() > 2
    assert sorted(r._p for r in numbered.collect()) == list(range(1, 5_001))


def test_trie_of_an_empty_table(spark):
    out = prefix_trie.rebuilt_trie(spark.createDataFrame([], TURNS))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"] and out.count() == 0


def variants_by_hand(rows, least_count=5):
    n, low = Counter(), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= least_count}
    near, holes, form = defaultdict(set), defaultdict(set), {}
    for w in n:
        for i in range(len(w)):
            hole = w[:i] + w[i + 1 :]
            holes[i, hole].add(w)
            if hole in n:
                near[w].add(hole)
                near[hole].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    for w in n:
        if near[w] and n[f := min(near[w], key=lambda v: (-n[v], v))] >= 5 * n[w]:
            form[w] = f
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root))
    return sorted(out, key=lambda r: r[0])


@pytest.fixture(scope="module")
def spelled():
    rnd = random.Random(11)
    rows = []
    for i in range(60):
        picked = ["".join(rnd.choice("abé") for _ in range(rnd.randint(5, 8))) for _ in range(60)]
        rows.append((i, " ".join(picked).title() + " ÀÉÎÕÜß× straße " + "Colour color Colours colors " * (1 + i % 3)))
    chain = "abcdefgh " * 625 + "abcdefgx " * 125 + "abcdefyx " * 25 + "abcdezyx " * 5  # form of form of form
    return [*rows, (None, chain), (None, None), (70, ""), (71, "1234 #! 漢字"), (72, ("w" * 30_000 + " ") * 6), rows[0], rows[0]]


@pytest.mark.parametrize("block", [2, 9, 512])
def test_variants_by_any_block_size(spark, spelled, block):
    df = spark.createDataFrame([(*r, "c", "c", 1) for r in spelled], "doc_id long, text string, word string, block string, n long").repartition(3)
    found = sorted((tuple(r) for r in variants.group(df, block=block).collect()), key=lambda r: r[0])
    assert found == variants_by_hand(spelled)
    by = {r[0]: r for r in found}
    assert by["abcdezyx"][5] == "abcdefgh" and by["abcdezyx"][3] == "abcdefyx"


def test_each_near_pair_is_found_once(spark):
    words = ["aaaaaa", "aaaaaaa", "aaaaaaaa", "aaabaa", "baaaaa", "aaaaab", "ababab", "bababa", "abababa"]
    rows = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    for block in (2, 3, 512):
        pairs = [(r.word, r.near) for r in variants.near_pairs(rows, block).collect()]

        def edit(a, b):
            holes = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
            return a != b and (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1 or len(a) + 1 == len(b) and a in holes(b) or len(b) + 1 == len(a) and b in holes(a))

        assert sorted(pairs) == sorted((a, b) for a in words for b in words if edit(a, b))


def test_variants_of_an_empty_table(spark, empty):
    assert variants.group(empty).count() == 0


@pytest.fixture(scope="module")
def page_rows():
    rnd = random.Random(5)
    pages = [(i, f"http://x.example/{i}?q=a b\n", "<p>" + "".join(rnd.choice("aeé漢 ") for _ in range(rnd.randint(0, 900)))) for i in range(80)]
    pages += [(100 + i, "http://same", "<b>" + "copy " * 40) for i in range(30)] + [(3, "http://again", "<b>" + "copy " * 40)]
    pages += [(200, None, None), (201, "", ""), (202, "u", ""), (203, "u", "x" * 99), (204, "u", "x" * 99), (205, "u", "y" * 100), (206, "u", "y" * 100), (None, "u", "y" * 100), (None, None, "z" * 300), (None, None, "z" * 300)]
    pages += [(205, "u", "y" * 100), (300, "long", "long text \r\n\r\n" * 40_000)]
    return pages


PAGES = "page_id long, url string, html string, _id string, _payload string, record_type string, archive string"


def test_warc_round_trip(spark, page_rows):
    df = spark.createDataFrame([(*r, *"cccc") for r in page_rows], PAGES).repartition(4)
    first = {}
    for i, _, html in page_rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    wanted = []
    for i, _, html in page_rows:
        raw = (html or "").encode()
        target = first.get(html)
        again = target is not None and i != target
        wanted.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", target if again else None))
    archives = warc.write(df, archive_bytes=4_000)
    assert archives.count() > 4 and sum(r.records for r in archives.collect()) == len(page_rows)
    assert in_order(warc.pages(archives)) == sorted(wanted, key=lambda r: tuple((x is not None, x) for x in r))
    whole = warc.read(archives).filter("record_type = 'response'").collect()
    assert Counter((r.id, r.payload) for r in whole) == Counter((None if i is None else str(i), (html or "").encode()) for (i, _, html), w in zip(page_rows, wanted, strict=True) if w[3] == "response")
    assert {r.target_uri for r in whole} >= {None, "http://x.example/7?q=a%20b%0A"} and all(r.error is None for r in whole)
    folder = archives.first().archive.rpartition("/")[0]
    assert warc.archives_in(spark, folder).count() == archives.count()


def test_warc_of_an_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def archive_of(records, dictionary=b"0123456789" * 40, packed=False):
    compress = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).compress
    stored = zstandard.ZstdCompressor().compress(dictionary) if packed else dictionary
    return struct.pack("<II", warc.DICTIONARY_MAGIC, len(stored)) + stored + b"".join(map(compress, records))


def page(ident, payload=b"hello"):
    return warc.record("response", ident, "http://a", payload, hashlib.sha256(payload).hexdigest(), None)


@pytest.mark.parametrize("packed", [False, True])
def test_reader_takes_plain_and_compressed_dictionaries(packed):
    other = struct.pack("<II", 0x184D2A51, 3) + b"abc"  # a skippable frame that isn't the dictionary
    rows = list(warc.records(io.BytesIO(archive_of([page("1"), page("2", b"x" * 300_000)], packed=packed) + other), strict=True))
    assert [(r[3 - 1], r[4 + 1], r[-1]) for r in rows] == [("1", 5, None), ("2", 300_000, None)]


@pytest.mark.parametrize(
    ("raw", "why"),
    [
        (page("1").replace(b"WARC/1.1", b"WARC/9.9"), "version"),
        (page("1").replace(b"WARC-Date", b"X-Date"), "without WARC-Date"),
        (page("1").replace(b"hello", b"hullo"), "digest differs"),
        (page("1")[:-2], "Content-Length is"),
        (page("1").replace(b"WARC-Type: response", b"no colon here"), "malformed"),
        (warc.record("revisit", "1", "u", b"", hashlib.sha256(b"").hexdigest(), "2").replace(b"WARC-Refers-To", b"X"), "of nothing"),
    ],
)
def test_damaged_records_are_told_and_the_next_one_is_read(raw, why):
    rows = list(warc.records(io.BytesIO(archive_of([raw, page("2")]))))
    assert why in rows[0][-1] and rows[1][2] == "2" and rows[1][-1] is None
    with pytest.raises(warc.Damaged, match=why):
        list(warc.records(io.BytesIO(archive_of([raw])), strict=True))


def test_damaged_archives_are_told():
    whole = archive_of([page("1"), page("2")])
    for raw, why in ((whole[:-5], "ends within"), (whole[8 + 400 :], "no dictionary"), (whole + b"????????", "neither"), (whole[:420] + b"\xff\xff\xff" + whole[423:], "decoded|ends within|neither")):
        rows = list(warc.records(io.BytesIO(raw)))
        assert re.search(why, rows[-1][-1])
        with pytest.raises(warc.Damaged):
            list(warc.records(io.BytesIO(raw), strict=True))
