"""The keyword automaton against a search of every text for every keyword."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from brambleflow.operators import interests
from brambleflow.operators.keywords import contained


def plain(texts, words):
    return sorted((t, w) for t in texts if t is not None for w in {x for x in words if x is not None} if w in t)


def got(df):
    return sorted(tuple(r) for r in df.select("text", "keyword").collect())


def test_contained_keywords_against_brute_force(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcé日 ") for _ in range(rng.randrange(30))) for _ in range(300)] + [None, "", "aaaa", "abcabc"]
    texts = list(dict.fromkeys(texts))
    words = ["".join(rng.choice("abcé日 ") for _ in range(rng.randrange(1, 4))) for _ in range(60)] + ["a", "aa", "ab", "b", "abcab", None, "a"]
    t = spark.createDataFrame([(x, "k") for x in texts], "text string, keyword string")
    w = spark.createDataFrame([(x, "t") for x in words], "keyword string, text string")
    for part in (1 << 16, 7):
        assert got(contained(t, w, part)) == plain(texts, words)
    assert got(contained(t, w.unionByName(spark.createDataFrame([("", "x")], w.schema)))) == plain(texts, [*words, ""])
    assert contained(t, w.limit(0)).count() == 0 and contained(t.limit(0), w).count() == 0


def test_tag_scores_of_many_keywords(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    items = [(f"i{k}", None if k % 17 == 0 else " ".join(word() for _ in range(5)).title(), None if k % 13 == 0 else " ".join(word() for _ in range(9))) for k in range(200)]
    items += [("same1", "Red ring", "red"), ("same2", "Red ring", "red")]
    dictionary = [(f"t{k % 40}", word()) for k in range(500)] + [("Color", "RED"), ("Color", "red"), ("Ring", "ring"), ("Both", "red")]
    df = spark.createDataFrame(items, "item_id string, title string, description string")
    tags = spark.createDataFrame(dictionary, "tag string, keyword string")
    want = {}
    for i, title, text in items:
        for tag, w in {(t, w.lower()) for t, w in dictionary}:
            n = 2 * (w in (title or "").lower()) + (w in (text or "").lower())
            if n:
                want[i, tag] = want.get((i, tag), 0) + n
    assert {(r.item_id, r.tag): r.raw for r in interests.tag_scores(df, tags).collect()} == want
    titled = {(i, t) for i, title, _ in items for t, w in dictionary if w.lower() in (title or "").lower()}
    found = interests.title_tags(df, tags).collect()
    assert {tuple(r) for r in found} == titled and len(found) == len(titled)


def test_time_hardly_grows_with_the_dictionary(spark):
    texts = spark.range(60_000).select(F.concat_ws(" ", *(F.sha2(F.concat_ws("#", "id", F.lit(i)), 256) for i in range(6))).alias("text"))
    texts = texts.persist()
    texts.count()
    took = []
    for n in (30, 30_000):
        words = spark.range(n).select(F.concat(F.lit("zz"), F.sha2(F.col("id").cast("string"), 256)).alias("keyword"))
        contained(texts, words).count()  # the automaton is made
        start = time.perf_counter()
        contained(texts, words).count()
        took.append(time.perf_counter() - start)
    texts.unpersist()
    assert took[1] < 6 * took[0] + 2  # a thousand times the keywords
