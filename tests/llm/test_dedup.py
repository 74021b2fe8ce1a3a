"""Exact dedup (2) and the n-gram join (3) against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import common, digest_index, ngram_join
from keyloom.llm import components as component_module
from keyloom.llm.components import components

from .helpers import edge_frame, edge_rows, empty_frame, same_rows


def brute_dedup(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).digest()].append(i)
    out = []
    for digest, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known, default=None)
        seen = set()
        for i in ids:
            out.append((i, keep, len(ids), i == keep and i not in seen, digest.hex()))
            seen.add(i)
    return out


@pytest.mark.parametrize(("batches", "hot"), [(1, 1000), (3, 2)])
def test_exact_dedup(spark, monkeypatch, batches, hot):
    monkeypatch.setattr(common, "HOT_LEAST", hot)
    got = digest_index.deduplicate(edge_frame(spark), batches=batches).collect()
    same_rows([(r[0], r[1], r[2], r[3], r[4].hex()) for r in got], brute_dedup(edge_rows()))


def test_exact_dedup_of_nothing(spark):
    assert digest_index.deduplicate(empty_frame(spark)).count() == 0
    assert digest_index.drop_copies(empty_frame(spark)).count() == 0


def test_drop_copies_keeps_columns(spark):
    df = edge_frame(spark)
    kept = digest_index.drop_copies(df)
    assert kept.columns == df.columns
    expected = [(r[0], r[4]) for r in brute_dedup(edge_rows()) if r[3]]
    assert len(kept.collect()) == len(expected)
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(i for i, _ in expected if i is not None)


def test_own_names_dont_clash(spark):
    names = ["_keyloom_digest", "_keyloom_id", "_keyloom_kept", "_keyloom_stay"]
    df = spark.createDataFrame([(1, "a b c d e f", *"wxyz"), (2, "a  b c d e f", *"wxyz"), (3, "other", *"stuv")], ["doc_id", "text", *names])
    for drop in (digest_index.drop_copies, ngram_join.drop_near_duplicates):
        got = drop(df)
        assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [(1, "a b c d e f", *"wxyz"), (3, "other", *"stuv")]


def test_own_index_goes(spark):
    before = {t.name for t in spark.catalog.listTables()}
    digest_index.deduplicate(spark.createDataFrame([(1, "a")], "doc_id long, text string")).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_persistent_index(spark):
    index = digest_index.DigestIndex(spark, "digest_index_test", buckets=3)
    first = spark.createDataFrame([(5, "a b"), (6, "c")], "doc_id long, text string")
    digest_index.deduplicate(first, index=index)
    second = spark.createDataFrame([(1, "a  b"), (2, "d"), (3, "d")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in digest_index.deduplicate(second, index=index, batches=1).collect()}
    # what an earlier batch recorded wins
    assert got == {1: (5, False), 2: (2, True), 3: (2, False)}
    assert spark.table("digest_index_test").count() == 3
    # the index is read in place: no exchange stands above its scan
    keyed = digest_index.keyed_documents(second)
    plan = keyed.groupBy("digest").count().join(index.read().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan
    spark.sql("DROP TABLE digest_index_test")


# -- near duplicates -----------------------------------------------------


def shingles(text):
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_near(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    return [(i, len(sets[k]), min(least[find(k)], default=None) if sets[k] else i) for k, (i, _) in enumerate(rows)]


def corpus(seed, n=160):
    """Groups of near copies with edits around the threshold, a passage in many texts, short texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 400))
    passage = [word() for _ in range(40)]
    bases = [[word() for _ in range(rng.choice([6, 30, 80, 150]))] for _ in range(6)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.6:
            w = list(rng.choice(bases[:2] if kind < 0.4 else bases))
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 6])):
                w[rng.randrange(len(w))] = word()
        elif kind < 0.8:
            w = passage + [word() for _ in range(rng.choice([0, 2, 5, 10, 40]))]
        else:
            w = [rng.choice("xyz") for _ in range(rng.randint(0, 7))]
        rows.append((i * 7 % 1009, " ".join(w)))
    return rows


@pytest.mark.parametrize(("seed", "frequent", "crowd", "block", "hot"), [(1, 24, 24, 512, 1000), (2, 2, 3, 7, 4), (3, 1, 1000, 512, 1000), (4, 0, 2, 16, 2)])
def test_near_duplicates(spark, monkeypatch, seed, frequent, crowd, block, hot):
    monkeypatch.setattr(common, "HOT_LEAST", hot)
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    same_rows(ngram_join.near_duplicates(df).collect(), brute_near(rows))


def test_sets_that_collide_are_hashed_anew(spark, monkeypatch):
    rows = corpus(5, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tables = []

    def colliding(docs, seed=0):
        table = real(docs, seed)
        tables.append(seed)
        # with the first seed all classes have one name
        return table.withColumn("key", F.lit(1).cast("long")) if seed == 0 else table

    real = ngram_join.set_table
    monkeypatch.setattr(ngram_join, "set_table", colliding)
    same_rows(ngram_join.near_duplicates(df).collect(), brute_near(rows))
    assert tables == [0, 1]


def test_left_join_keeps_rows_without_a_partner(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 3)
    left = spark.createDataFrame([(k % 4 if k > 10 else 9, k) for k in range(30)], "k int, v int")
    right = left.groupBy("k").count().where("k <> 2").withColumn("w", F.col("k") * 2)
    got = common.join_counted(left, right, "k", "count", 30, how="left")
    same_rows(got.collect(), [(r[0], r[1], None if r[0] == 2 else 2 * r[0]) for r in left.collect()])


def test_near_duplicates_edges(spark):
    same_rows(ngram_join.near_duplicates(edge_frame(spark)).collect(), brute_near(edge_rows()))
    assert ngram_join.near_duplicates(empty_frame(spark)).count() == 0
    assert ngram_join.drop_near_duplicates(edge_frame(spark)).columns == edge_frame(spark).columns


def test_prefix_arithmetic():
    for n in range(2, 400):
        for m in range(-(-3 * n // 4), 4 * n // 3 + 1):
            level = ngram_join.size_level(m)
            needs = dict(ngram_join.partner_needs(n))
            common = -(-3 * (n + m) // 7)
            if common <= min(n, m):
                # missing more than n - common shingles is what a link can't do
                assert needs[level] >= n - common + 1


def test_common_counts():
    rng = np.random.default_rng(0)
    left = [np.unique(rng.integers(0, 60, rng.integers(0, 30))) for _ in range(9)]
    right = [np.unique(rng.integers(0, 60, rng.integers(0, 30))) for _ in range(5)]
    got = ngram_join.common_counts(left, right)
    assert (got == [[len(np.intersect1d(a, b)) for b in right] for a in left]).all()


def test_join_counted_splits_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 3)
    left = spark.createDataFrame([(k % 4 if k > 10 else 9, k) for k in range(30)], "k int, v int")
    right = left.groupBy("k").count().where("k <> 2")
    got = common.join_counted(left, right, "k", "count", 30)
    assert got.columns == ["k", "v"]
    same_rows(got.collect(), [(r[0], r[1]) for r in left.collect() if r[0] != 2])


@pytest.mark.parametrize("hot", [1000, 2])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr(component_module, "HOT_EDGES", hot)
    edges = [(i, i + 1) for i in range(20, 60)] + [(1, 2), (3, 2), (70, 9), (9, 70)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 20 for i in range(21, 61)) and got[2] == got[3] == 1 and got[70] == 9
