"""Near copies of the pipeline against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from salesmart.llm import near_copies

from .data import SCHEMA, documents, words
from .test_exact import brute_components


def brute_set(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(rows):
    sets = [brute_set(r[1]) for r in rows]
    near = lambda a, b: a == b or len(a & b) * 5 >= 4 * len(a | b) > 0
    return brute_components(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if near(sets[i], sets[j])])


@pytest.mark.parametrize("bucket", [32, 2])
def test_near_copies(spark, monkeypatch, bucket):
    monkeypatch.setattr(near_copies, "BUCKET", bucket)  # 2: large band values are compared with one member first
    rng = random.Random(4)
    rows = [r[:2] for r in documents(1)]
    text = words(rng, 60).split(" ")
    for k in range(40):  # a drifting group, whose ends are no near copies of each other
        text[rng.randrange(len(text))] = words(rng, 1)
        rows.append((100 + k, " ".join(text)))
    rows += [(100, rows[-1][1]), (None, rows[-1][1]), (None, words(rng, 30)), (3, rows[3][1]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    label = brute_groups(rows)
    key = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    want = sorted(min(key(j) for j in label if label[j] == g) for g in set(label.values()))
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in near_copies.keep_one(df).collect())
    assert got == want


def test_cloud_below_the_limit(spark, monkeypatch):
    """Many texts with one base, most pairs just below 0.8: all links are found, and few of the pairs are made."""
    monkeypatch.setattr(near_copies, "BUCKET", 4)
    rng = random.Random(14)
    base, rows = words(rng, 64).split(" "), []
    for i in range(240):
        text = list(base)
        for _ in range(rng.choice([1, 1, 2])):
            text[rng.randrange(len(text))] = words(rng, 1) + str(i)
        rows.append((i, " ".join(text)))
    made = []
    plain = near_copies._by_rare_shingles
    monkeypatch.setattr(near_copies, "_by_rare_shingles", lambda *a: (made.append(plain(*a).count()), plain(*a))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    label = brute_groups(rows)
    got = {}
    for r in near_copies.near_copies(df).collect():
        got.setdefault(r.group, set()).add(r.doc_id)
    want = {}
    for i, g in label.items():
        want.setdefault(g, set()).add(rows[i][0])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert made and made[0] < 240 * 239 / 2 / 4


def test_parities_bound_the_difference():
    rng = random.Random(15)
    for n in (1, 5, 60, 3000):
        x, y = (near_copies.shingles(words(rng, n) + " same words here for all of them " * 3) for _ in range(2))
        bits = sum(int(v).bit_count() for v in (near_copies.parities(x) ^ near_copies.parities(y)).view("uint64"))
        assert bits <= len(set(x.tolist()) ^ set(y.tolist()))


def test_stage_drops_near_copies_beyond_three_bits(spark):
    """A text of 200 words with two words changed has a similarity over 0.8, whatever its SimHash."""
    rng = random.Random(6)
    rows = []
    for i in range(30):
        text = words(rng, 200).split(" ")
        rows.append((2 * i, " ".join(text), None, None, 1, "z"))
        text[50], text[120] = "changed", "words"
        rows.append((2 * i + 1, " ".join(text), None, None, 1, "z"))
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert len(out.columns) == 6 and sorted(r.doc_id for r in out.select(F.col("doc_id")).collect()) == list(range(0, 60, 2))
    assert near_copies.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0
