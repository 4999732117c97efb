"""The index of postings by impact against the search over all postings."""

from __future__ import annotations

import random

import pytest

from brambleflow.operators import bm25, bm25_index
from brambleflow.sources.config import shared_folder


def texts(n, seed):
    """A common word in all, frequent ones of different weight, rare ones in a few."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = ["common"] * rng.randrange(1, 4) + [f"f{rng.randrange(12)}" for _ in range(rng.randrange(1, 25))] + [f"r{rng.randrange(n)}" for _ in range(rng.randrange(6))]
        rng.shuffle(words)
        out.append((f"d{i:04}", " ".join(words)))
    return out


def opened(spark, docs):
    path = shared_folder(spark, "index")
    bm25_index.save_index(spark.createDataFrame(docs, "item_id string, text string"), path)
    return bm25_index.open_index(spark, path)


def rows(df):
    return sorted((r.query_id, r["rank"], r.item_id, round(r.score, 5)) for r in df.collect())


@pytest.fixture(scope="module")
def library(spark):
    docs = [*texts(900, 1), ("e1", ""), ("e2", None), ("e3", "!!"), *((f"copy{i}", "common f1 f2 same") for i in range(300))]
    queries = [("q0", "common f1 r5"), ("q1", "r7 r7 r8"), ("q2", "common"), ("q3", "f1 f2 f3 f4 f5 f6 common"), ("q4", "nothing"), ("q5", ""), ("q6", None), ("q7", "Same f2"), ("q8", "r1 r2 r3 r4 common common")]
    return docs, opened(spark, docs), spark.createDataFrame(queries, "query_id string, text string")


@pytest.mark.parametrize("k", [1, 10, 700])
def test_the_early_end_loses_nothing(spark, library, k):
    docs, index, queries = library
    whole = bm25.search(bm25.build_index(spark.createDataFrame(docs, "item_id string, text string")), queries, k)
    assert rows(bm25_index.search(index, queries, k)) == rows(whole)


def test_blocks_fall_and_hold_all_postings(spark, library):
    docs, index, _ = library
    blocks = index.blocks.collect()
    assert max(len(b["items"]) for b in blocks) <= bm25_index.BLOCK
    found = {}
    for b in blocks:
        assert b.impact == b.impacts[0] == max(b.impacts) and list(b.impacts) == sorted(b.impacts, reverse=True)
        found.setdefault(b.token, []).append(b)
    want = {}
    for i, t in docs:
        for word in set((t or "").replace("!!", "").split()):
            want.setdefault(word, set()).add(i)
    assert {t: {i for b in bs for i in b["items"]} for t, bs in found.items()} == want
    terms = {r.token: (r.df, r.impact) for r in index.terms.collect()}
    assert terms == {t: (len(want[t]), max(b.impact for b in bs)) for t, bs in found.items()}
    # Only the ends of tasks and tokens leave blocks that aren't full.
    assert len(found["common"]) <= -(-1200 // bm25_index.BLOCK) + 2 * index.blocks.rdd.getNumPartitions() + 4


def test_selective_queries_read_few_postings(spark, library):
    _, index, _ = library
    queries = spark.createDataFrame([("q", "common same r5 r6")], "query_id string, text string")
    counted = {}
    bm25_index.search(index, queries, 3, counted)
    assert counted["read"] < counted["postings"] / 2 and counted["scored"] < counted["matches"] / 2


def test_empty_tables(spark):
    index = opened(spark, [])
    queries = spark.createDataFrame([("q", "a b")], "query_id string, text string")
    assert bm25_index.search(index, queries, 3).count() == 0
    index = opened(spark, [("a", "a a"), ("b", "b")])
    assert bm25_index.search(index, queries.limit(0), 3).count() == 0
    assert [r.item_id for r in bm25_index.search(index, queries, 3).orderBy("rank").collect()] == [r.item_id for r in bm25.search(bm25.build_index(spark.createDataFrame([("a", "a a"), ("b", "b")], "item_id string, text string")), queries, 3).orderBy("rank").collect()]


def test_matches_are_counted_in_cells(spark, library, monkeypatch):
    docs, index, queries = library
    monkeypatch.setattr(bm25, "POSTINGS", 700)
    monkeypatch.setattr(bm25, "PAIRS", 500)
    asked = bm25.query_tokens(queries).join(index.terms, "token").select("query_id", "token")
    postings = index.blocks.join(asked.select("token").distinct(), "token", "left_semi").selectExpr("token", "explode(items) AS item_id")
    words = {i: set((t or "").replace("!!", "").split()) for i, t in docs}
    held = {}
    for r in asked.collect():
        held.setdefault(r.query_id, set()).add(r.token)
    assert bm25.count_matches(asked, postings, postings.count()) == sum(bool(q & w) for q in held.values() for w in words.values())
    assert bm25.count_matches(asked.limit(0), postings, 9) == 0
