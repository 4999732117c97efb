"""Byte-level BPE, importance resampling and tiered search against libraries and brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from brambleflow.llm import byte_pairs, importance, textblocks, tiers
from brambleflow.llm.byte_pairs import HashTable, MemoPairs, decode_bytes_bpe, encode_bytes_bpe, read_ranks
from brambleflow.llm.common import shared_dir
from brambleflow.llm.textblocks import ragged

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, row string, h string, ids string, item string, rank string, n string"
LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def corpus(spark, pairs):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, *"abcdef") for i, t in pairs], SCHEMA)


def target(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "item_id long, text string, doc_id string")


def words(rng, n, vocabulary=40):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return MemoPairs(RANKS)


def encoded(encoder, texts):
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    out = []
    for parts in encoder.texts(data, offsets):
        both = list(parts)
        out.append(([int(x) for ids, _ in both for x in ids], b"".join(b.tobytes() for _, b in both)))
    return out


def odd_texts(rng, n):
    parts = [*" \n\t'strevmlld12.,!aé日😀 　՘ǲ²½\r\x0b\x1c\x85​́", "  ", "'s", "'re", " '", "<|endoftext|>", "ing", " the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(50))) for _ in range(n)]
    return [*texts, "", "'", "''s", "x's's", " 's", "\n's", "it're'", "'r", "'re", "'l l", "aé'lla", " " * 9, "\n\n a", "a" * 700, "ab" * 500 + " " * 300 + "x"]


def test_byte_pairs_equal_the_library(library, encoder):
    rng = random.Random(2)
    texts = odd_texts(rng, 6000)
    texts += ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(40)) for _ in range(500)]
    for k in range(0, len(texts), 400):
        assert encoded(encoder, texts[k : k + 400]) == [(library.encode_ordinary(t), t.encode()) for t in texts[k : k + 400]]


def test_letters_numbers_and_spaces_are_the_librarys(encoder):
    import unicodedata

    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000)) if unicodedata.category(chr(c)) != "Cn"]
    got = encoder.pairs.classes[[ord(c) for c in every]]
    for kind, before in ((byte_pairs.LETTER, "a"), (byte_pairs.NUMBER, "1"), (byte_pairs.SPACE, "\n")):
        assert np.array_equal(got == kind, byte_pairs._told_apart(before, "".join(every), public_tokenizers.PATTERN))


@pytest.mark.parametrize("size", [3, 5, 255, 256, 257, 900])
def test_matrices_and_heap_agree(library, encoder, size):
    rng = random.Random(size)
    pieces = list({"".join(rng.choice("abcdenrst" if k % 2 else "ab") for _ in range(size)).encode() for k in range(20)} - set(encoder.pairs.ranks))
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    ids, n = encoder.pairs.merged(data, ends - size, ends)
    want = [library.encode_ordinary(p.decode()) for p in pieces]
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want == [encoder.pairs._heap(p) for p in pieces]


def test_memo_starts_afresh_and_equal_hashes_do_no_harm(library, monkeypatch):
    rng = random.Random(3)
    texts = odd_texts(rng, 500)
    want = [(library.encode_ordinary(t), t.encode()) for t in texts]
    monkeypatch.setattr(byte_pairs, "MEMO_PIECES", 51_000)
    small = MemoPairs(RANKS)
    for _ in range(2):
        assert [x for k in range(0, len(texts), 50) for x in encoded(small, texts[k : k + 50])] == want
    assert small.entries <= 51_000
    monkeypatch.setattr(byte_pairs, "MEMO_PIECES", 50_300)  # fewer than one block needs
    assert encoded(MemoPairs(RANKS), texts) == want
    monkeypatch.setattr(byte_pairs, "MEMO_PIECES", 1_000_000)
    honest = byte_pairs.span_hashes
    colliding = MemoPairs(RANKS)
    monkeypatch.setattr(byte_pairs, "span_hashes", lambda *x: honest(*x) & np.uint64(0xFFF))
    colliding.table = HashTable(10_000)
    assert encoded(colliding, texts) == want


def test_long_texts_go_part_by_part(library, encoder, monkeypatch):
    monkeypatch.setattr(byte_pairs, "BLOCK_BYTES", 40)
    rng = random.Random(4)
    texts = [" ".join(odd_texts(rng, 30)), words(rng, 500), "x" * 300, "don't " * 50]
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        parts = list(encoder.parts(raw))
        assert [int(x) for ids, _ in parts for x in ids] == library.encode_ordinary(t)
    assert len(list(encoder.parts(np.frombuffer(texts[1].encode(), np.uint8)))) > 20


def test_hash_table_of_keys_that_share_slots():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 20, 3000, dtype=np.uint64) << np.uint64(40))
    table = HashTable(len(keys))
    table.put(keys[::2], np.arange(len(keys[::2]), dtype=np.int32))
    want = np.full(len(keys), -1)
    want[::2] = np.arange(len(keys[::2]))
    assert np.array_equal(table.get(keys), want)
    assert ragged(np.array([5, 9, 2]), np.array([2, 0, 3])).tolist() == [5, 6, 2, 3, 4]


def test_byte_pairs_of_a_table(spark, library):
    pairs = [(1, "Don't  stop"), (2, None), (3, ""), (None, "日本 é\n"), (1, "Don't  stop"), (4, "a <|endoftext|> b")]
    rows = encode_bytes_bpe(corpus(spark, pairs), RANKS)
    want = sorted((i or 0, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in pairs)
    assert sorted((r.doc_id or 0, list(r.ids), bytes(r.decoded)) for r in rows.collect()) == want
    short = encode_bytes_bpe(corpus(spark, pairs), RANKS, digest=True).collect()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids, r.decoded) for r in short) == sorted((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(raw)) for i, ids, raw in want)
    again = decode_bytes_bpe(rows.selectExpr("doc_id", "CASE WHEN doc_id = 3 THEN null ELSE ids END AS ids", "'x' AS decoded"), RANKS).collect()
    assert sorted((r.doc_id or 0, b"-" if r.decoded is None else bytes(r.decoded)) for r in again) == sorted((i or 0, b"-" if i == 3 else (t or "").encode()) for i, t in pairs)
    assert encode_bytes_bpe(corpus(spark, []), RANKS).count() == 0


# Importance resampling.


def features(text):
    own = WORD.findall((text or "").translate(LOWERED))
    return own, [" ".join(own[i : i + n]) for n in (1, 2, 3) for i in range(len(own) - n + 1)]


def resampled(pairs, texts, percent=5, least=20, seed=42):
    """By the contract's words."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    own = [(i, *features(t)) for i, t in pairs]
    s, t = Counter(bucket(f) for _, _, fs in own for f in fs), Counter(bucket(f) for x in texts for f in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in s}
    out = []
    for i, w, fs in own:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append([i, len(w), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    long = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], float("inf") if r[0] is None else r[0]))
    for rank, r in enumerate(long[: percent * len(long) // 100], 1):
        r[5] = rank
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("percent", [5, 40, 100])
def test_importance_against_brute_force(spark, percent):
    rng = random.Random(7)
    pairs = [(0, None), (1, ""), (2, "one"), (3, "One two"), (None, words(rng, 30)), (4, "É日本 x_y Z9 " * 20), (5, words(rng, 19)), (6, words(rng, 20)), (7, "supercalifragilistic" * 40 + " " + words(rng, 25))]
    copy = words(rng, 60)
    pairs += [(100 + i, copy) for i in range(60)] + [(900, copy), (900, copy)]
    pairs += [(1000 + i, words(rng, rng.randrange(5, 80), 3000)) for i in range(150)]
    texts = [words(rng, 30, 500) for _ in range(20)] + [None, "", copy]
    got = importance.importance_resample(corpus(spark, pairs), target(spark, texts), percent=percent).collect()
    rows = sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in got), key=repr)
    assert rows == resampled(pairs, texts, percent)


def test_importance_of_empty_tables(spark):
    none = target(spark, [])
    assert importance.importance_resample(corpus(spark, []), none).count() == 0
    pairs = [(i, words(random.Random(i), 30)) for i in range(40)]
    got = importance.importance_resample(corpus(spark, pairs), none).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in got), key=repr) == resampled(pairs, [])


def test_long_texts_have_the_same_features_in_parts(monkeypatch):
    rng = random.Random(8)
    text = " ".join(rng.choice(["a", "bb", "É", "x" * 50, "...", "W3"]) for _ in range(3000))
    data = np.frombuffer(text.encode(), np.uint8)
    _, bucket, n = importance._features(data, np.array([0, len(data)]))
    monkeypatch.setattr(textblocks, "BLOCK_BYTES", 64)
    some, counts, n_words = importance._long_features(data)
    want, n_each = np.unique(bucket, return_counts=True)
    assert np.array_equal(some, want) and np.array_equal(counts, n_each) and n_words == n[0]
    assert sum(n_each) == len(features(text)[1])


def test_ranks_over_many_partitions(spark):
    from pyspark.sql import functions as F

    rows = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 13).alias("s")).repartition(7)
    got = importance.ranked_globally(rows, [F.desc("s"), F.col("id")], 900).where("rank IS NOT NULL").collect()
    want = sorted(((i * 7919 % 13, i) for i in range(5000)), key=lambda x: (-x[0], x[1]))[:900]
    assert [(r.s, r.id) for r in sorted(got, key=lambda r: r["rank"])] == want and {r["rank"] for r in got} == set(range(1, 901))


# Tiered search.


def terms(text):
    return [w.translate(LOWERED) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def searched(pairs, items, k):
    docs = [(i, Counter(terms(t))) for i, t in pairs]
    n_docs, total = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in docs:
            n = sum(c.values())
            score = 0
            for t, qf in Counter(terms(text)).items():
                if t in c:
                    m = 100 - 75 + 75 * n * n_docs // total
                    score += qf * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, float("inf") if i is None else i))
        out += [(item, rank, None if i == float("inf") else i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def library_of_texts():
    rng = random.Random(9)
    pairs = [(0, None), (1, ""), (2, "..."), (3, "É日本 W1"), (None, words(rng, 20)), (4, words(rng, 5000, 400))]
    pairs += [(10 + i, "w1 w2 w3 w3 rare" if i % 2 else "w1 w2 w3") for i in range(80)]  # copies: ties
    pairs += [(200 + i, words(rng, rng.randrange(1, 60), rng.choice([40, 3000]))) for i in range(300)]
    pairs += [(9, "w5 w5"), (9, "w5 w5"), (9, "w6")]
    items = [(0, "w1 w2 W3"), (1, "rare w7 w7 w8"), (2, None), (3, "nothing-there"), (4, words(rng, 40)), (5, "É日本"), (6, "w5"), (6, "w6 w6"), (None, "w9 w11")]
    items += [(50 + i, words(rng, 6, 3000)) for i in range(10)]
    return pairs, items


@pytest.mark.parametrize("shard_bytes", [200, 3000, 1 << 23])
def test_tiered_search_against_brute_force(spark, library_of_texts, shard_bytes):
    pairs, items = library_of_texts
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    index = tiers.build_index(corpus(spark, pairs).coalesce(2), shard_bytes)
    for k in (1, 10):
        counted = []
        assert rows_of(tiers.search(index, asked, k, counted)) == searched(pairs, items, k)
        n = [c[0] for c in counted]
        assert n == sorted(n, reverse=True)
    assert index.shards.count() > (2 if shard_bytes < 1 << 23 else 0)


def test_items_with_a_proof_stay_in_the_first_tier(spark):
    """A hundred documents share a word; an item that asks for rare words, too, needs only the best of its postings."""
    rng = random.Random(10)
    pairs = [(i, f"common u{i} " + words(rng, 1 + i % 7, 10_000)) for i in range(400)] + [(1000 + i, "common seldom seldom") for i in range(12)]
    items = [(1, "common seldom"), (2, "common")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    counted = []
    index = tiers.build_index(corpus(spark, pairs).coalesce(1))
    assert rows_of(tiers.search(index, asked, 10, counted)) == searched(pairs, items, 10)
    alone = []
    tiers.search(index, asked.where("item_id = 1"), 10, alone)
    assert len(alone) < tiers.TIERS and alone[0][1] < 412


def test_saved_index_is_opened_again(spark, library_of_texts):
    pairs, items = library_of_texts
    path = f"{shared_dir(spark)}/saved-tiers"
    tiers.build_index(corpus(spark, pairs), 2000).save(path)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(tiers.search(tiers.open_index(spark, path), asked, 5)) == searched(pairs, items, 5)


def test_tiered_search_of_empty_tables(spark):
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert tiers.ranked_search(corpus(spark, []), asked).count() == 0
    assert tiers.ranked_search(corpus(spark, [(1, "a"), (2, None)]), asked.limit(0)).count() == 0
    assert rows_of(tiers.ranked_search(corpus(spark, [(1, "a"), (2, None), (3, "c")]), asked)) == searched([(1, "a"), (2, None), (3, "c")], [(1, "a b")], 10)


def test_long_texts_are_indexed_in_parts(monkeypatch):
    rng = random.Random(12)
    text = words(rng, 2000, 300) + " É" * 50
    data = np.frombuffer(text.encode(), np.uint8)
    monkeypatch.setattr(textblocks, "BLOCK_BYTES", 64)
    parts = [p.tobytes().decode() for p, _ in textblocks.word_slices(data, np.array([0, len(data)]))]
    assert "".join(parts) == text and len(parts) > 10
    assert sum((terms(p) for p in parts), []) == terms(text)
