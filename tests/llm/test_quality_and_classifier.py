from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from helpers import rows
from llm_cases import KIND, odd_rows, word_soup
from loomgraph.llm import fertility, ordinal, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(1 for i, line in enumerate(lines) if WORD.search(line) and line in lines[:i])
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_base_rules_match_brute_force(odd):
    for r in fertility.measure(odd).join(odd.select("doc_id", "text"), "doc_id").collect():
        n, chars, symbols, dup, repeat = brute(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (r["kept"] and r["base_failed"])


def test_measures_match_direct_encoding(odd):
    encode, partial = fertility.vocabulary()
    for r in fertility.measure(odd).join(odd.select("doc_id", "text"), "doc_id").collect():
        ids = [i for w in WORD.findall(r["text"] or "") for i in encode([" " + w])[0]]
        assert r["n_tokens"] == len(ids)
        if ids:
            p = np.array(list(Counter(ids).values())) / len(ids)
            assert r["token_entropy"] == pytest.approx(float(-(p * np.log2(p)).sum()), abs=1e-9)
            assert r["fallback_share"] == pytest.approx(float(np.mean(partial[ids])))
            assert r["chars_per_token"] == pytest.approx(r["word_chars"] / len(ids))


@pytest.mark.parametrize("seed", range(4))
def test_repeats_on_random_words(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        words = [rnd.choice("abc") for _ in range(rnd.randint(0, 25))]
        numbers = np.array(["abc".index(w) for w in words], np.int64)
        assert fertility.repeated_words(numbers) == brute(" ".join(words))[4]
        if len(words):
            assert fertility.repeated_words(numbers + (1 << 41)) == brute(" ".join(words))[4]


def test_filter_keeps_rows_whole(odd, empty):
    kept = fertility.keep_good(odd)
    assert kept.columns == odd.columns
    want = sorted(r["n_words"] for r in fertility.measure(odd).filter("kept").collect())
    assert sorted(len(WORD.findall(r["text"])) for r in kept.collect()) == want
    assert fertility.measure(empty).count() == fertility.keep_good(empty).count() == 0


def test_other_vocabularies(spark):
    df = spark.createDataFrame([(1, word_soup(random.Random(1), 80), "zz", "s", 1, *"cccccc")], KIND)
    for name in ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model"):
        assert fertility.measure(df, vocabulary_name=name).first()["n_tokens"] > 80


def graded(seed, n=500):
    """Texts whose grade is told by a few words."""
    rnd = random.Random(seed)
    tell = {0: ["vile", "nasty"], 1: ["meh", "dull"], 2: ["fine", "lucid"]}
    out = []
    for _ in range(n):
        g = rnd.choice([0, 1, 2])
        words = word_soup(rnd, rnd.randint(20, 200)).split()
        for w in tell[g] * 2:
            words.insert(rnd.randrange(len(words)), w)
        out.append((" ".join(words), g))
    return out


def test_ordinal_learns_held_out_grades():
    data = graded(1) + graded(2, 200)
    x = [ordinal.features(t) for t, _ in data]
    model = ordinal.fit(x[:500], [g for _, g in data[:500]])
    assert np.all(np.diff(model.thresholds) > 0)
    tails = model.tails(np.array([float((model.weights[i] * v).sum()) for i, v in x[500:]]))
    assert np.all(tails[:, 0] >= tails[:, 1])
    expected = tails.sum(axis=1)
    truth = np.array([g for _, g in data[500:]])
    assert np.mean(np.abs(np.round(expected) - truth) == 0) > 0.9


def test_likelihood_and_gradient_against_brute_force():
    rnd = np.random.default_rng(4)
    y, wide = rnd.integers(0, 4, 30), 7
    row, index = np.repeat(np.arange(30), 3), rnd.integers(0, wide, 90)
    value, theta = rnd.normal(size=90), rnd.normal(size=wide + 3)

    def brute(theta):
        t = [theta[wide]]
        for raw in theta[wide + 1 :]:
            t.append(t[-1] + math.log(1 + math.exp(raw)))
        total = 0.0
        for k in range(30):
            s = sum(theta[i] * v for i, v, r in zip(index, value, row) if r == k)
            tail = [1.0, *(1 / (1 + math.exp(x - s)) for x in t), 0.0]
            total -= math.log(tail[y[k]] - tail[y[k] + 1])
        return (total + sum(w * w for w in theta[:wide]) / (2 * 0.3**2)) / 30

    loss, grad = ordinal.likelihood(theta, index, value, row, y, wide, 0.3)
    assert math.isclose(loss, brute(theta), rel_tol=1e-9)
    for k in range(len(theta)):
        step = np.zeros(len(theta))
        step[k] = 1e-5
        assert math.isclose(grad[k], (brute(theta + step) - brute(theta - step)) / 2e-5, rel_tol=1e-4, abs_tol=1e-7)


def auc(worse, better):
    return sum((b > a) + (b == a) / 2 for a in worse for b in better) / len(worse) / len(better)


def test_few_labels_tell_grades_apart(spark):
    """399 labels of the 0.01 tables; held out: labelled texts of the 0.1 tables that are others."""
    def labelled(sf):
        docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
        return docs, queries.grades(labels), docs.join(queries.grades(labels), "doc_id").select("text", "grade").collect()

    docs, labels, own = labelled("sf0.01")
    model = ordinal.train(docs, labels)
    known = {r["text"] for r in own}
    held = [(r["grade"], *ordinal.features(r["text"])) for r in labelled("sf0.1")[2] if r["text"] not in known][:1500]
    scores = {g: [float((model.weights[i] * v).sum()) for grade, i, v in held if grade == g] for g in (1, 2)}
    assert auc(scores[1], scores[2]) > 0.9


def test_repeated_identifiers_give_one_row_each(spark):
    texts = [(1, "bad words !!"), (1, "a bad"), (1, None), (2, "fine"), (3, "fine too")] * 3
    df = spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, grade int")
    once = spark.createDataFrame([(1, "a bad"), (2, "fine"), (3, "fine too")], "doc_id long, text string")
    assert np.allclose(ordinal.train(df, labels).weights, ordinal.train(once, labels).weights)


def test_ordinal_on_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(0, 1), (6, 2), (7, 0), (None, 1), (8, None), (99999, 1)], "doc_id long, grade int")
    model = ordinal.train(odd, labels)
    scored = ordinal.score(odd, model)
    assert scored.count() == len(odd_rows()) and scored.columns == ["doc_id", "expected_grade", "tail_probability", "kept"]
    assert ordinal.score(empty, model).count() == 0
    none = ordinal.train(empty, labels)
    assert {r["expected_grade"] for r in ordinal.score(odd, none).collect()} == {0.0}


def test_training_agrees_with_itself(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(graded(3, 120))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, (_, g) in enumerate(graded(3, 120))], "doc_id long, grade int")
    a, b = ordinal.train(df, labels, max_rows=80), ordinal.train(df.repartition(5), labels.repartition(3), max_rows=80)
    assert np.allclose(a.weights, b.weights) and rows(ordinal.score(df, a)) == rows(ordinal.score(df, b))


def test_script_counts_all_letters():
    assert fertility.script("abc " * 2000 + "漢字" * 5000) == "other" and fertility.script("") == fertility.script("éa漢 1") == "latin"


def test_staged_tables_are_released(spark):
    from pathlib import Path

    from loomgraph.llm.common import release, shared_dir, staged

    release(spark)
    staged(spark.range(3).toDF("x"), "trial")
    folder = Path(shared_dir(spark).removeprefix("file://"))
    assert list(folder.glob("trial-*"))
    release(spark)
    assert not list(folder.glob("trial-*"))
