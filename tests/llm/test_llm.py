"""Corpus operators against brute force, with the edge cases their docstrings define."""

from __future__ import annotations

import hashlib
import json
import os
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brambleflow.llm import kdtree, licenses, minhash, packing, quality, queries, suffix_dedup, wrappers
from brambleflow.llm.common import shared_dir
from brambleflow.llm.jpeg import Picture, decode_bytes, encode_bytes
from brambleflow.llm.line_dedup import line_dedup
from brambleflow.llm.media import decode_media, media_digests, payload_of, store_payloads
from brambleflow.llm.pieces import MemoEncoder, decode_pieces, encode_pieces
from brambleflow.llm.textblocks import blocks
from brambleflow.llm.tokens import LONG_RUN, piece_encoder

BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, row string, h1 string, keep string, kept string, id string, part string"


def corpus(spark, pairs):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, *"abcdef") for i, t in pairs], SCHEMA)


def words(rng, n, vocabulary=40):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(5)
    base = words(rng, 120, 4000)
    out = [(0, None), (1, ""), (2, "  \n\t"), (3, "tiny"), (4, "Tiny "), (5, base), (6, base), (6, base), (7, base.replace("w1", "v1", 3)), (8, "é" * 60 + base[:200] + "日本語😀"), (9, "pre " + base[200:400]), (None, base + " end"), (None, None)]
    out += [(20 + i, base + " " + words(rng, 1 + i % 9, 4000)) for i in range(30)]
    out += [(100 + i, words(rng, rng.randrange(1, 90), 3000) + "\nA common line of text\n" + words(rng, 3)) for i in range(40)]
    out += [(200, words(rng, 40_000, 50_000))]
    return out


def run_line_dedup(pairs, least=10):
    space = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rank = lambda i: float("inf") if i is None else i
    key = lambda line: line.strip(space).translate(low)
    where: dict[str, set] = {}
    for i, t in pairs:
        for line in (t or "").split("\n"):
            where.setdefault(key(line), set()).add(rank(i))
    out = []
    for i, t in pairs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or len(where[key(x)]) < 2 or min(where[key(x)]) == rank(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def by_id(rows):
    return sorted(rows, key=repr)


def test_line_dedup(spark, pairs):
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup(corpus(spark, pairs)).collect()]
    assert by_id(got) == by_id(run_line_dedup(pairs))


def test_line_dedup_of_a_key_over_many_partitions(spark):
    rows = [(i, "the one hot line of all\n" * 3 + f"own line number {i}") for i in range(300)]
    df = corpus(spark, rows).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup(df).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert by_id(got) == by_id(run_line_dedup(rows))


def shingles(text, k=5):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(low)) if x]
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def run_near_duplicates(pairs):
    sets = [(i, shingles(t)) for i, t in pairs]
    parent = {i: i for i, _ in pairs if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and i is not None and j is not None and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    group = {}
    for i in parent:
        group.setdefault(find(i), []).append(i)
    low = {i: min(m) for m in group.values() for i in m}
    return [(i, len(s), None if i is None else low[i], i is None or low[i] == i) for i, s in sets]


def test_near_duplicates(spark, pairs):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(corpus(spark, pairs)).collect()]
    assert by_id(got) == by_id(run_near_duplicates(pairs))


def test_near_duplicates_of_a_document_with_several_texts(spark):
    rng = random.Random(21)
    a, b, c = (words(rng, 40, 3000) for _ in range(3))
    for rows in ([(5, a), (3, b), (5, b), (7, a)], [(5, a), (5, b), (9, b + " x"), (8, a + " y")], [(1, a), (2, b), (2, a), (3, c), (3, b), (4, c + " z"), (3, None), (6, None)]):
        got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(corpus(spark, rows)).collect()]
        assert by_id(got) == by_id(run_near_duplicates(rows))


def test_recall_just_above_the_threshold(spark):
    rng = random.Random(31)
    rows, n = [], 0
    while n < 400:
        base = [f"w{rng.randrange(9000)}" for _ in range(rng.randrange(60, 200))]
        other = list(base)
        for j in rng.sample(range(len(base)), rng.randrange(1, 6)):
            other[j] = f"x{rng.randrange(9000)}"
        x, y = shingles(" ".join(base)), shingles(" ".join(other))
        if 75 * len(x | y) <= 100 * len(x & y) <= 80 * len(x | y):
            rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(other))]
            n += 1
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(corpus(spark, rows)).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(n)) == n


def test_near_duplicates_in_blocks_and_chains(spark, monkeypatch):
    rng = random.Random(3)
    base = words(rng, 60, 5000).split()
    rows, now = [], list(base)
    for i in range(60):  # a chain: each near the one before, the ends far apart
        now = list(now)
        now[rng.randrange(len(now))] = f"x{i}"
        rows.append((i, " ".join(now)))
    for i in range(100, 160):
        own = list(base)
        for j in rng.sample(range(60), rng.randrange(1, 9)):
            own[j] = f"y{i}{j}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 7)
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(corpus(spark, rows)).collect()]
    assert by_id(got) == by_id(run_near_duplicates(rows))


def test_bit_estimate_is_unbiased_and_bitmaps_bound_from_above():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    a, b = np.sort(pool[:300]), np.sort(pool[100:])
    bounds = np.array([0, 300, 600])
    both = np.concatenate([a, b])
    low = minhash.packed(minhash.signatures(both, bounds)).view(np.uint64)
    x = low[0] ^ low[1]
    differ = int(np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(minhash.LOW)).sum())
    agree = 1 - differ / minhash.PERMS
    assert abs((agree - 0.25) / 0.75 - 0.5) < 0.2
    bits = minhash.bitmaps(both, bounds)
    one = [int(np.unpackbits(r).sum()) for r in bits]
    most = int(np.unpackbits(bits[0] & bits[1]).sum()) + min(300 - one[0], 300 - one[1])
    assert most >= 200


def run_suffix(pairs, n=50):
    rank = lambda i: float("inf") if i is None else i
    first: dict[bytes, float] = {}
    data = [(i, (t or "").encode()) for i, t in pairs]
    for i, b in data:
        for s in range(len(b) - n + 1):
            g = b[s : s + n]
            first[g] = min(first.get(g, float("inf")), rank(i))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - n + 1):
            if first[b[s : s + n]] < rank(i):
                gone[s : s + n] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + (len(gone) > 0 and gone[0]))
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_PLACES, 2])
def test_suffix_dedup(spark, pairs, hot):
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in suffix_dedup.suffix_dedup(corpus(spark, pairs), 50, True, hot).collect()]
    assert by_id(got) == by_id(run_suffix(pairs))


def test_suffix_dedup_of_repeats_within_texts(spark):
    rng = random.Random(12)
    line = words(rng, 20, 500)
    rows = [(1, "a" * 700), (2, "b" + "a" * 900 + line), (3, (line + " ") * 30), (4, (line + "; ") * 30 + "a" * 300), (5, "a" * 700), (None, line * 9), (None, (line + " ") * 30), (6, "-" * 80)]
    rows += [(10 + i, f"{i} " + (line + " ") * (1 + i % 4) + "a" * (40 + i)) for i in range(30)]
    for hot in (2000, 3):
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in suffix_dedup.suffix_dedup(corpus(spark, rows), 50, True, hot).collect()]
        assert by_id(got) == by_id(run_suffix(rows))


def test_suffix_dedup_survives_equal_hashes_of_texts(spark, monkeypatch, pairs):
    weak = lambda docs: docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.octet_length("text").cast("long"))
    monkeypatch.setattr(suffix_dedup, "keyed", weak)
    monkeypatch.setattr(suffix_dedup, "fingerprints", lambda: ["row", F.lit(0).cast("long").alias("more"), F.octet_length("text").alias("size")])
    rows = [x for x in pairs if x[0] is not None] + [(300, "x" * 99), (301, "y" * 99), (302, "z" + "y" * 98)]
    rows = list({i: (i, t) for i, t in rows}.values())
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in suffix_dedup.suffix_dedup(corpus(spark, rows), 50, True).collect()]
    assert by_id(got) == by_id(run_suffix(rows))


def test_hot_anchors_are_thinned_without_effect():
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(60):
        n = int(rng.integers(1, 200))
        docs = np.stack([rng.integers(0, 7, 12), rng.integers(0, 40, 12), rng.integers(0, 2, 12)], axis=1)
        value = np.where(rng.random(n) < 0.6, rng.integers(0, 4, n), rng.integers(0, 300, n)).astype(np.uint32)
        rows.append((int(len(rows) >= 40), value.tobytes(), rng.integers(0, 12, n).astype(np.uint16).tobytes(), docs.astype(np.int64).tobytes()))
    columns = list(zip(*rows, strict=True))
    batch = pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["part", "vals", "idx", "docs"])
    for hot in (3, 40):
        found = [[b.to_pylist() for b in suffix_dedup._shared(hot, most)[0](iter([batch.slice(i, 7) for i in range(0, 60, 7)]))] for most in (1 << 30, 100)]
        assert found[0] == found[1] and len(found[0]) == 2
        hots = np.concatenate([np.frombuffer(r["keys"], np.uint64) & np.uint64(1) for b in found[0] for r in b])
        assert 0 < hots.sum() < len(hots)


@pytest.mark.parametrize("chunk", [1 << 19, 700])
def test_equal_keys_of_different_windows_are_told_apart(monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk)
    rng = random.Random(3)
    windows = [bytes(rng.choice(b"ab") for _ in range(50)) for _ in range(18)]
    rows = sorted((key, doc, doc, 0, 1, 0, windows[2 * rng.randrange(9) + key % 2]) for key in (5, 6) for doc in range(60))
    whole = [(7, 1, 1, 0, 3, -1, b"one text" * 9), (7, 2, 2, 0, 3, -1, b"one text" * 9), (7, 3, 3, 0, 3, -1, b"two text" * 9)]
    schema = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("back", pa.int32()), ("ctx", pa.binary())])
    batches = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*(rows + whole), strict=True), schema.types, strict=True)], schema=schema).to_batches(max_chunksize=25)
    got = {(r["doc"], r["n"]) for b in suffix_dedup._decided(50)[0](batches) for r in b.to_pylist()}
    first: dict = {}
    for key, doc, *_, ctx in rows:
        first.setdefault((key, ctx), doc)
    assert got == {(doc, 1) for key, doc, *_, ctx in rows if first[(key, ctx)] < doc} | {(2, 3), (3, suffix_dedup.NO_COPY)}


def test_suffix_dedup_of_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(9)
    long = words(rng, 3000, 9000)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 12)
    h = [x.tolist() for x in suffix_dedup.anchor_runs(np.frombuffer(long.encode(), np.uint8), np.array([0, len(long)]), 50)]
    batch = pa.record_batch([pa.array([long])], names=["text"])
    windows = set()
    for _, data, offsets, _, ahead in suffix_dedup.pieces([batch], 50):
        _, place, first, last = suffix_dedup.anchor_runs(data, offsets, 50)
        for p, a, b in zip(place.tolist(), first.tolist(), last.tolist(), strict=True):
            windows |= {(p + ahead, s + ahead) for s in range(a, b + 1)}
    assert windows == {(p, s) for p, a, b in zip(h[1], h[2], h[3], strict=True) for s in range(a, b + 1)}


def test_suffix_order_is_that_of_the_bytes():
    rng = random.Random(2)
    data = np.frombuffer("".join(rng.choice("ab") for _ in range(3000)).encode() + b"abab" * 200, np.uint8)
    at = np.arange(len(data) - 60)
    order, equal = suffix_dedup.Suffixes(data, 50).order(at)
    texts = [data[i : i + 50].tobytes() for i in at[order].tolist()]
    assert texts == sorted(texts)
    assert equal.tolist() == [False] + [a == b for a, b in zip(texts[:-1], texts[1:], strict=True)]


def test_suffix_text_mode_keeps_whole_characters(spark):
    shared = "é" * 40
    rows = [(1, "a" + shared), (2, "b" + shared[:39] + "è")]
    got = {r.doc_id: r.kept for r in suffix_dedup.suffix_dedup(corpus(spark, rows)).collect()}
    assert got[1] == rows[0][1] and got[2] == "bè"


def test_licenses(spark):
    rows = [
        (1, "Released under the MIT License."),
        (2, "mit mit license, GENERAL public license; general PUBLIC-license mit  license"),
        (3, None),
        (4, ""),
        (5, "Licensed under the Apache Licence, Version 2.0."),
        (6, "This work is licensed under a GNU General Public License, version 3"),
        (7, "smit license mit licenses"),
        (7, "smit license mit licenses"),
        (None, "é mit license"),
    ]
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.scan_licenses(corpus(spark, rows)).collect()}
    assert got == {
        (1, 5, 1, 3, 3, "mit", "mit,mit-notice"),
        (2, 11, 4, 1, 9, "gpl,mit", "gpl,mit"),
        (3, 0, 0, None, None, "", ""),
        (4, 0, 0, None, None, "", ""),
        (5, 8, 0, None, None, "", "apache-2.0"),
        (6, 12, 1, 7, 7, "gpl", "gpl,gpl-notice"),
        (7, 4, 0, None, None, "", ""),
        (None, 3, 1, 1, 1, "mit", "mit"),
    }
    assert licenses.scan_licenses(corpus(spark, rows)).count() == len(rows)


def test_license_labels_do_not_depend_on_repeated_rows(spark):
    rng = random.Random(7)
    notices = [t.words.split() for t in licenses.TEMPLATES if not t.base]
    rows = []
    for i in range(120):
        w = list(rng.choice(notices))
        for _ in range(rng.randrange(0, len(w) // 2 + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    found = lambda r: {(x.doc_id, x.labels, x.score) for x in licenses.scan_licenses(corpus(spark, r)).collect()}
    once = found(rows)
    assert once == found(rows * 2) and any(labels for _, labels, _ in once) and not all(labels for _, labels, _ in once)


def test_license_notices_against_brute_force(spark):
    """Labels and score of altered notices against every window of the text."""
    from difflib import SequenceMatcher

    rng = random.Random(14)
    notices = [(t.label, t.words.split()) for t in licenses.TEMPLATES if not t.base]
    rows = []
    for i in range(150):
        w = [f"y{rng.randrange(50)}" for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(1, 3)):
            own = list(rng.choice(notices)[1])
            for j in rng.sample(range(len(own)), rng.randrange(0, max(1, len(own) // 3) + 1)):
                own[j] = f"x{rng.randrange(99)}"
            w += own + [f"y{rng.randrange(50)}" for _ in range(rng.randrange(5, 30))]
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r for r in licenses.scan_licenses(corpus(spark, rows)).collect()}
    exact = 0
    for i, text in rows:
        w = text.split()

        def found(most):
            """Labels of notices that stand in windows with up to so many further words, and the best cover."""
            best = {}
            for label, t in notices:
                part = max(sum(m.size for m in SequenceMatcher(None, t, w[s : s + len(t) + more], autojunk=False).get_matching_blocks()) / len(t) for s in range(len(w)) for more in range(most + 1))
                best[label] = max(best.get(label, 0), part)
            return {label for label, x in best.items() if x >= licenses.MIN_COVER}, max(best.values())

        base = {label for p, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) if f" {p} " in f" {text} "}
        own = set(filter(None, got[i].labels.split(",")))
        (least, low), (most, high) = found(0), found(3 * licenses.NEAR)
        assert base | least <= own <= base | most
        assert got[i].score == 1.0 if base else (low if least else 0.0) <= got[i].score <= (high if most else 0.0)
        exact += own == base | least
    assert exact > 0.9 * len(rows)


def test_license_places_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["MIT", "license", "general", "public", "apache", "x,"]) for _ in range(rng.randrange(60)))) for i in range(80)]
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    want = {}
    for i, t in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())
        at = sorted((s, label) for p, label in phrases.items() for s in range(len(w)) if w[s : s + len(p.split())] == p.split())
        want[i] = (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_licenses(corpus(spark, rows)).collect()}
    assert got == want


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vecs = [(i, rng.normal(size=6).tolist()) for i in range(0, 900)] + [(i, [0.5] * 6) for i in range(900, 1100)]
    odd = [(1200, None), (1300, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1400, [float("nan")] * 6), (1500, [float("inf")] * 6), (None, [1.0] * 6), (1600, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vecs + odd], "vec_id long, embedding array<double>, shard string").repartition(3)
    whole = {i: np.floor(1024 * np.array(v)).astype(np.int64) for i, v in vecs}
    want = []
    for q in (i for i in whole if i % 100 == 0):
        best = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    got = [tuple(r) for r in kdtree.exact_top_k(df, F.col("vec_id") % 100 == 0).collect()]
    assert sorted(got) == sorted(want)


def test_top_k_with_small_shards_and_few_candidates(spark, monkeypatch):
    rng = np.random.default_rng(7)
    for n, size in ((2, 4), (700, 3)):
        v = rng.integers(-3, 4, (n, size)).astype(np.float64)
        ids = np.arange(n)
        tree = kdtree.Tree(ids, v)
        for q in range(0, n, 50):
            want = sorted(((-float(v[q] @ x), i) for i, x in enumerate(v) if i != q))[:10]
            assert tree.search(v[q], q, 10, kdtree.LEAST) == [(-s, i) for s, i in want]


def test_top_k_of_repeated_ids_and_large_numbers(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(150)] + [(100, rng.normal(size=3).tolist()), (100, [1.0, 2.0, 3.0]), (7, [1.0, 2.0, 3.0])]
    rows += [(200 + i, (rng.normal(size=3) * 10.0 ** float(rng.uniform(3, 8))).tolist()) for i in range(60)] + [(300, [9e6, 9e6, -9e6]), (400, [3.0, 1e200, -1e300]), (401, [-3.0, 1e200, 1e300]), (500, [1e308, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    whole = [(i, [int(np.floor(1024 * x)) if abs(x) < 2**40 else int(x) * 1024 for x in v]) for i, v in rows if max(map(abs, v)) < 1e305]
    want = []
    for n, (q, a) in enumerate(whole):
        if q % 100 == 0:
            scores = [(-min(2**63 - 1, max(-(2**63), sum(x * y for x, y in zip(a, b, strict=True)))), i) for m, (i, b) in enumerate(whole) if m != n]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:10])]
    for size in (8192, 20):
        monkeypatch.setattr(kdtree, "BLOCK_QUERIES", size)
        got = [tuple(r) for r in kdtree.exact_top_k(df, F.col("vec_id") % 100 == 0).collect()]
        assert sorted(got) == sorted(want)


def fold_text(ids):
    return np.array(ids, np.uint32)


def test_packing(spark, pairs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BYTE_BPE)
    rows = packing.retrieval_packing(corpus(spark, pairs).coalesce(2), BYTE_BPE).collect()
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        total = 0
        for r in own:
            assert r.offset == total and r.length > 0 and len(r.ids) == r.length
            assert r.ids_crc32 == zlib.crc32(fold_text(r.ids))
            total += r.length
        assert total <= 2048 and total & (total - 1) == 0
    found: dict = {}
    for r in sorted(rows, key=lambda r: (r.start, r.sequence_id)):
        found.setdefault((r.doc_id, r.doc_tokens), {}).setdefault(r.start, []).append(r.ids)
    want: dict = {}
    for i, t in pairs:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        want.setdefault(i, []).append(ids)
    assert sum(r.length for r in rows) == sum(len(x) for v in want.values() for x in v)
    for i, own in want.items():
        if len(own) == 1:
            parts = found[(i, len(own[0]))]
            assert [x for s in sorted(parts) for p in parts[s] for x in p] == own[0]


def test_packing_prefers_neighbours():
    shard = packing.Shard()
    topics = ["alpha beta gamma delta", "one two three four"]
    for i in range(20):
        terms = np.unique([hash((topics[i % 2], j)) & 0xFFFFFFFF for j in range(4)] + [10_000 + i]).astype(np.uint32)
        shard.add(i, np.arange(100, dtype=np.uint32), terms, np.ones(len(terms), np.int64))
    shard.index(np.ones(packing.CELLS, np.float32), 5.0)
    packing_common, packing.COMMON = packing.COMMON, 1.0
    shard.index(np.ones(packing.CELLS, np.float32), 5.0)
    packing.COMMON = packing_common
    first = next(shard.pack(1000))
    assert {doc % 2 for doc, _, _ in first} == {0}


def test_packing_fills_windows_as_a_plain_search_does():
    """Every choice against BM25 over all unused documents, computed one by one."""
    rng = np.random.default_rng(11)
    shard = packing.Shard()
    for i in range(160):
        terms = np.unique(np.append(rng.integers(0, 60, rng.integers(0, 14)), rng.integers(1000 * (i % 5), 1000 * (i % 5) + 30, 6))).astype(np.uint32)
        shard.add(i, np.arange(rng.integers(1, 300), dtype=np.uint32), terms, rng.integers(1, 5, len(terms)).astype(np.uint32))
    idf = rng.random(packing.CELLS).astype(np.float32)
    shard.index(idf, 12.0)

    def score(seed, d):
        length = int(shard.counts[d].sum())
        return sum(float(idf[t]) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / 12)) for t, tf in zip(shard.terms[d].tolist(), shard.counts[d].tolist(), strict=True) if t in shard.terms[seed])

    unused, placed, rest, total = set(range(160)), [0] * 160, None, 0
    for sequence in shard.pack(512):
        assert sum(n for *_, n in sequence) == 512 or total + 512 > shard.tokens
        for at, (doc, start, n) in enumerate(sequence):
            if rest is not None:
                assert at == 0 and (doc, start) == rest
            elif at == 0:
                assert doc == min(unused)
            else:
                best = max(score(sequence[0][0], d) for d in unused)
                assert score(sequence[0][0], doc) >= best - 1e-4 if best > 1e-6 else doc == min(unused)
            unused.discard(doc)
            assert start == placed[doc]
            placed[doc] += n
            rest = (doc, placed[doc]) if placed[doc] < len(shard.docs[doc][1]) else None
            total += n
    assert total == shard.tokens and not unused


def test_packing_deals_like_documents_together(spark):
    rng = random.Random(23)
    topics = [[f"t{t}x{j}" for j in range(60)] for t in range(40)]
    rows = [(i, " ".join(rng.choices(topics[i % 40], k=50) + rng.choices(["the", "of", "and", "in"], k=30))) for i in range(800)] + [(i, None) for i in range(800, 810)]
    rows.append((900, "alone"))
    from brambleflow.llm.common import keyed

    docs = keyed(corpus(spark, rows)).repartition(5)
    figures = packing.corpus_figures(docs)
    dealt = docs.mapInArrow(packing._dealt(BYTE_BPE, spark.sparkContext.broadcast(figures)), packing.DEALT).select("doc_id", "key", "part").collect()
    groups: dict = {}
    for r in dealt:
        groups.setdefault(r.key, []).append(r.doc_id)
    assert len(dealt) == len(rows) and {r.key for r in dealt if r.doc_id >= 800} == {-1}
    met = sum(a % 40 == b % 40 for key, ids in groups.items() if key >= 0 for a in ids for b in ids if a < b)
    every = sum(1 for key, ids in groups.items() if key >= 0 for a in ids for b in ids if a < b)
    assert met > 0.9 * every and met > 0.05 * 40 * 20 * 19 / 2


def test_packing_looks_up_common_terms():
    rng = np.random.default_rng(3)
    for n in (5, 20, 90):
        shard = packing.Shard()
        chance = 0.95 * rng.random(50) ** 2
        for i in range(n):
            terms = np.append(np.flatnonzero(rng.random(50) < chance), [100 + i % 2, 1000 + i]).astype(np.uint32)
            shard.add(i, np.arange(100, dtype=np.uint32), terms, rng.integers(1, 5, len(terms)))
        idf = rng.random(packing.CELLS).astype(np.float32)
        shard.index(idf, 30.0)
        for seed in range(n):
            want = np.zeros(n)
            for d in range(n):
                length = shard.counts[d].sum()
                for t, tf in zip(shard.terms[d].tolist(), shard.counts[d].tolist(), strict=True):
                    if t in shard.terms[seed]:
                        want[d] += idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / 30))
            others = np.arange(n) != seed
            assert np.allclose(shard.scores(seed)[others], want[others], rtol=1e-4)
    topics = packing.Shard()
    for i in range(20):
        topics.add(i, np.arange(100, dtype=np.uint32), np.array([i % 2, 10 + i], np.uint32), np.ones(2, np.int64))
    topics.index(np.ones(packing.CELLS, np.float32), 2.0)
    assert {doc % 2 for doc, _, _ in next(topics.pack(1000))} == {0}


def test_piece_encoder_equals_the_library():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BYTE_BPE)
    rng = random.Random(1)
    parts = [" ", "  ", "a", "It's", "\n", "é", "日", "😀", "\t", "12", "...", " ", " ", "　", "<|endoftext|>", "ing", "\x1c", "'ll", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(50))) for _ in range(1500)]
    spaces = ["\t", "\n", " ", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u3000", "\x1c", "\u180e"]
    for k in range(40):  # around the length from which runs are cut out
        c = rng.choice(spaces)
        run = "".join(rng.choice([c, " ", rng.choice(spaces)]) if k % 2 else c for _ in range(rng.choice([LONG_RUN - 1, LONG_RUN, LONG_RUN + 1, 9000])))
        texts.append((rng.choice(["", "a", "é", ".", "日"]) + run + rng.choice(["", "a", " b", "é", ".", "<|endoftext|>"])) * rng.choice([1, 2]))
    texts += ["\n" * 1_000_000, "a" * 100_000, "hello <|endoftext|> world"]
    encoder = piece_encoder(BYTE_BPE)
    assert [encoder.encode(x).tolist() for x in texts] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts[-1]).tolist() == [31373, 220, 50256, 995]


def test_sentence_pieces_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(6)
    parts = [" ", "  ", "a", "b", "the", "\n", "é", "日", "😀", "▁", "\t", "x", "23", ".", "ing", "\0", "<s>", "<0x0A>", " ⁇ ", "tion", "Z"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500)] + [" " * k + s for k in range(1, 40) for s in ("", "a", " x", "\n")] + ["", "ab" * 3000]
    texts += ["  " + "a" * 50_000, " " * 30_000 + "x", "ab" * 20_000 + "   "]
    texts += ["".join(rng.choice([" " * rng.randrange(1, 40), rng.choice(["the", "ing", " of", "a", ".", "tion"])]) for _ in range(12)) for _ in range(1500)]
    encoder = MemoEncoder(PIECES)
    got = [x for _, data, offsets in blocks(pa.table({"text": texts}).to_batches()) for x in encoder.encode(data, offsets)]
    ids = library.encode(texts)
    assert [x[0] for x in got] == [b"".join(b"%d," % i for i in own) for own in ids]
    assert [x[1].decode() for x in got] == library.decode(ids)
    df = corpus(spark, [(1, "one  two"), (2, None), (None, "x▁y"), (1, "one  two")])
    coded = encode_pieces(df, PIECES)
    assert sorted((r.n_tokens, r.decoded) for r in coded.collect()) == sorted([(len(library.encode("one  two")), "one  two")] * 2 + [(0, ""), (len(library.encode("x▁y")), "x y")])
    assert {r.decoded for r in decode_pieces(coded.select("doc_id", "ids"), PIECES).collect()} == {"one  two", "", "x y"}


def test_media_round_trip(spark, pairs):
    got = {}
    for r in media_digests(corpus(spark, pairs)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in pairs:
        b = (t or "").encode()
        p = payload_of(b)
        assert len(p) % 192 == 0 and len(p) >= 192
        medium = encode_bytes(p)
        assert any((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(medium), hashlib.sha256(medium).hexdigest()) for r in got[i])


@pytest.mark.parametrize("n", [192, 384, 576, 192 * 33, 384 * 4095, 384 * 4096])
def test_bytes_survive_the_scans(n):
    p = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    assert decode_bytes(Picture(encode_bytes(p))) == p


def test_decoder_reads_foreign_progressive_files(spark):
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(70, 45, 1)
    for y in range(45):
        for x in range(70):
            image.setRGB(x, y, (x * 3) << 16 | (y * 5) << 8 | (x + y))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpg").next()
    how = writer.getDefaultWriteParam()
    how.setProgressiveMode(1)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), how)
    stream.flush()
    data = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    want = np.array([[back.getRGB(x, y) & 0xFFFFFF for x in range(70)] for y in range(45)])
    got = Picture(data).rgb().astype(int)
    assert np.abs(got - np.stack([want >> 16, want >> 8 & 255, want & 255], axis=2)).mean() < 2
    media = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(b"no file"))], "doc_id long, media binary")
    rows = {r.doc_id: r for r in decode_media(media).collect()}
    assert bytes(rows[1].rgb) == Picture(data).rgb().tobytes() and (rows[1].height, rows[1].width) == (45, 70)
    assert rows[2].rgb is None and rows[2].error is None and "ValueError" in rows[3].error
    assert decode_media(store_payloads(corpus(spark, [(1, "x"), (2, None)]))).where("rgb IS NOT NULL").count() == 2


def test_damaged_files_give_an_error_text(spark):
    whole = encode_bytes(bytes(range(192)))
    frame = whole.index(b"\xff\xc2")
    no_sampling = bytearray(whole)
    no_sampling[frame + 11] = 0
    huge = bytearray(whole)
    huge[frame + 5 : frame + 9] = b"\xff\xff\xff\xff"
    rng = random.Random(2)
    files = [b"", b"\xff\xd8\xff\xd9", bytes(no_sampling), bytes(huge)]
    for _ in range(60):
        cut = bytearray(whole[: rng.randrange(2, len(whole))])
        for _ in range(3):
            cut[rng.randrange(2, len(cut))] = rng.randrange(256)
        files.append(bytes(cut))
    media = spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(files)], "doc_id long, media binary")
    rows = {r.doc_id: r for r in decode_media(media).collect()}
    assert len(rows) == len(files) and all((r.rgb is None) != (r.error is None) for r in rows.values())
    assert all(rows[i].error for i in range(4))
    small = spark.createDataFrame([(1, bytearray(whole))], "doc_id long, media binary")
    assert "pixels" in decode_media(small, most_pixels=10).first().error and decode_media(small, most_pixels=None).first().error is None


PAGE = '<html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>x</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li><li>Menu</li></ul></nav><div class="ad banner">Buy</div><article><h1>{0}</h1><p><b>{1}<br>x<p>A &amp; b&nbsp;&#233;\n c</p><form>f</form><div class="comments"><p>reader</p></div></article><aside>s</aside><footer>&copy;</footer></body></html>'


def test_main_text(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", PAGE.format(f"Title {i}", f"body {i}")) for i in range(12)]
    rows += [(50, None, None), (51, "http://h0.example/x", ""), (52, "nourl", "just text &lt;here&gt;"), (53, "http://h3.example", "<body><div><p>one</p><p>two</p></div></body>"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = [(r.page_id, r.text) for r in wrappers.extract_main_text(df).collect()]
    want = [(i, f"Title {i}\nbody {i} x\nA & b é c") for i in range(12)] + [(50, ""), (51, ""), (52, "just text <here>"), (53, "one\ntwo"), (0, "Title 0\nbody 0 x\nA & b é c")]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize(
    "page, want",
    [
        ("<body class='has-sidebar'><p>a</p></body>", "a"),
        ("<body class='sidebar'><article><p>a</p></article></body>", "a"),
        ("<main id='search'><p>a</p></main>", "a"),
        ("<div class='content no-sidebar'><p>a</p><p>b</p></div>", "a\nb"),
        ("<article class='long-form post-12'><p>a</p></article>", "a"),
        ("<article><header><h1>t</h1><p>by x</p></header><p>a</p></article>", "t\na"),
        ("<article><header class='entry-header'><h2>t</h2></header><p>a</p></article>", "t\na"),
        ("<header><h1>site</h1></header><article><p>a</p></article>", "a"),
        ("<article><p>a</p><svg/><p>b</p><iframe src='x' /><p>c</p><script async/><p>d</p></article>", "a\nb\nc\nd"),
        ("<article><p>a</p><script src=/x/>var y;</script><p>b</p></article>", "a\nb"),
        ("<article><p>a</p><article class='comment'><p>c</p></article><div class='site-footer'>f</div><div class='cookie_notice'>g</div></article>", "a"),
    ],
)
def test_main_text_of_ambiguous_markup(page, want):
    assert wrappers.main_text(page, wrappers.containers(wrappers.page_wrapper(page))) == want


def test_the_wrapper_decides(spark):
    """Elements without telling names: what is the same on a host's pages, and links, are not its main text."""
    rng = random.Random(17)
    page = "<body><div id='a'>{0}</div><div id='b'><ul>{1}</ul></div><div id='c'><div id='d'><h2>{2}</h2>{3}</div></div><div id='e'>{0}</div></body>"
    rows, want = [], {}
    template = words(rng, 80)
    for i in range(9):
        body = [words(rng, 1 + rng.randrange(30)) for _ in range(rng.randrange(1, 7))]
        links = "".join(f"<li><a href='/{j}'>{words(rng, 9)}</a></li>" for j in range(rng.randrange(2, 9)))
        rows.append((i, f"https://host.example/{i}", page.format(template, links, f"head {i}", "".join(f"<p>{x}</p>" for x in body))))
        want[i] = "\n".join([f"head {i}", *body])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in wrappers.extract_main_text(df).collect()} == want
    for i, _, html in rows:  # a page alone doesn't tell its template
        alone = wrappers.main_text(html, [])
        assert alone != want[i] and want[i].split("\n")[-1] in alone


def test_parts_of_a_host_meet_again(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "PART_STRUCTURES", 3)
    monkeypatch.setattr(wrappers, "PART_WRAPPERS", 2)
    rng = random.Random(18)
    tags = ["p", "h2", "pre", "blockquote"]
    rows = [(i, f"http://one.example/{i}", "<body><div class='menu'>m</div><article>" + "".join(f"<{t}>{words(rng, 3)}</{t}>" for t in rng.choices(tags, k=rng.randrange(1, 9))) + "</article></body>") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = [json.loads(r.wrapper) for r in wrappers.infer_wrappers(df).collect()]
    assert len(found) == 1 and found[0]["pages"][0] == 40
    pattern = re.compile(expression_pattern(found[0]["nodes"]))
    for _, _, html in rows:
        assert pattern.fullmatch("".join(f"{x} " for x in wrappers.stream(html)))


def expression_pattern(nodes):
    """The wrapper as a pattern over tokens followed by spaces."""
    return "".join("(?:" + (re.escape(what + " ") if isinstance(what, str) else f"(?:{expression_pattern(what)})+") + ")" + ("*" if optional else "") for what, optional in nodes)


def test_alignment_is_longest_in_linear_space(monkeypatch):
    rng = np.random.default_rng(4)
    for _ in range(60):
        x, y = (rng.integers(0, 5, rng.integers(0, 40)) for _ in range(2))
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                table[i + 1][j + 1] = table[i][j] + 1 if x[i] == y[j] else max(table[i][j + 1], table[i + 1][j])
        for cells in (1 << 20, 8):
            monkeypatch.setattr(wrappers, "TABLE", cells)
            found = wrappers._matches(x, y)
            assert len(found) == table[-1][-1] and all(x[i] == y[j] for i, j in found)
            assert all(a < c and b < d for (a, b), (c, d) in zip(found[:-1], found[1:], strict=True))


def test_long_pages():
    rng = random.Random(19)
    page = lambda: "<body><article>" + "".join(f"<{t}>x</{t}>" for t in rng.choices(["p", "h2", "pre", "ul", "dl"], k=6000)) + "</article></body>"
    a, b = wrappers.page_wrapper(page()), wrappers.page_wrapper(page())
    both = wrappers.merged(a, b)
    assert wrappers.containers(both) == ["article"] and len(wrappers.main_text(page(), ["article"]).split("\n")) == 6000


class Independent(HTMLParser):
    """Blocks in article elements by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.blocks = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.skip += tag in ("nav", "footer", "aside", "script", "form") or ("class", "comments") in attrs
        self.blocks.append("") if tag not in ("b", "i", "a", "br") else None
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.skip -= tag in ("nav", "footer", "aside", "script", "form", "section")
        self.blocks.append("") if tag not in ("b", "i", "a", "br") else None

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.blocks[-1] += data


def test_main_text_against_an_independent_parser(spark):
    rng = random.Random(20)
    inline = lambda: rng.choice(["{}", "<b>{}</b>", "{} &amp; x", "<i>{}<br>y</i>", "<a href='/'>{}</a>", "&eacute;{}&#33;"]).format(words(rng, rng.randrange(1, 9)))
    around = ["<nav><ul><li>{}</li></ul></nav>", "<footer>{}</footer>", "<aside><p>{}</p></aside>", "<script>var x = '{}';</script>", "<form>{}</form>"]
    block = lambda: f"<{(t := rng.choice(['p', 'h2', 'blockquote', 'pre', 'li']))}>{inline()} {inline()}</{t}>"
    rows = []
    for i in range(150):
        inner = "".join(rng.choice(around).format(words(rng, 3)) if rng.random() < 0.15 else block() for _ in range(rng.randrange(1, 12)))
        if rng.random() < 0.3:
            inner += f"<section class='comments'><p>{words(rng, 5)}</p></section>"
        outer = "".join(rng.choice(around).format(words(rng, 4)) for _ in range(3))
        rows.append((i, f"http://h{i % 4}.example/", f"<html><body>{outer}<article class='{rng.choice(['post', 'story', 'x'])}'><h1>{inline()}</h1>{inner}</article><article>{block()}</article>{outer}</body></html>"))
    want = {}
    for i, _, html in rows:
        parser = Independent()
        parser.feed(html)
        want[i] = "\n".join(x for x in (" ".join(b.split()) for b in parser.blocks) if x)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in wrappers.extract_main_text(df).collect()} == want


def test_wrappers_have_groups_and_options():
    a = wrappers.folded(wrappers.stream("<ul><li>a</li><li>b</li><li>c</li></ul><p>x</p>"))
    b = wrappers.folded(wrappers.stream("<ul><li>a</li></ul>"))
    assert wrappers.expression(wrappers.aligned(a, b)) == "<ul ( <li # >li )+ >ul <p? #? >p?"
    assert wrappers.aligned(a, a) == a


def quality_docs(rng, n):
    good = lambda: ". ".join(words(rng, 12, 3000).capitalize() for _ in range(6))
    bad = [lambda: words(rng, 60).upper().replace(" ", "!! "), lambda: " | ".join(words(rng, 2) for _ in range(40)), lambda: ("again " * 20 + "\n") * 3, lambda: "### ".join(words(rng, 1) for _ in range(60))]
    return [(i, good() if i % 3 else rng.choice(bad)(), int(i % 3 > 0)) for i in range(n)]


def test_quality_ranks_held_out_rows(spark):
    rng = random.Random(8)
    docs = quality_docs(rng, 400)
    df = corpus(spark, [(i, t) for i, t, _ in docs] + [(None, "x"), (9999, None), (9999, None)])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in docs] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    ranker = quality.train_quality(df, labels)
    rows = quality.score_quality(df, ranker).collect()
    truth = {i: q for i, _, q in docs}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows) and len(rows) == 403
    none = quality.train_quality(df, labels.where("quality = 1"))
    assert {r.score for r in quality.score_quality(df, none).collect()} == {0.5}


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = quality_docs(random.Random(8), 200)
    df = corpus(spark, [(i, t) for i, t, _ in docs])
    labels = spark.createDataFrame([(i, q) for i, _, q in docs], "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train_quality(df, labels), quality.train_quality(df, turned)
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold


def test_empty_tables(spark):
    df = corpus(spark, [])
    assert line_dedup(df).count() == 0
    assert minhash.near_duplicates(df).count() == 0
    assert suffix_dedup.suffix_dedup(df).count() == 0
    assert licenses.scan_licenses(df).count() == 0
    assert packing.retrieval_packing(df, BYTE_BPE).count() == 0
    assert encode_pieces(df, PIECES).count() == 0
    assert media_digests(df).count() == 0
    assert wrappers.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert kdtree.exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).count() == 0
    assert quality.score_quality(df, quality.train_quality(df, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0


def test_empty_tables_through_the_pipeline(spark):
    import corpus_pipeline as p

    folder = shared_dir(spark) + "/empty-tables"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    assert p.run(spark, folder).count() == 0


def test_quality_of_very_long_texts(spark):
    rng = random.Random(13)
    df = corpus(spark, [(1, words(rng, 200_000, 900)), (2, "x" * 500_000), (3, "a\n" * 200_000), (4, ""), (5, "!" * 300_000)])
    scores = {r.doc_id: r.score for r in quality.score_quality(df, quality.train_quality(df, spark.createDataFrame([(1, 1), (2, 0), (3, 0), (5, 0)], "doc_id long, quality int"))).collect()}
    assert len(scores) == 5 and all(0 <= x <= 1 for x in scores.values())


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    import duckdb

    duck = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = duck.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    df = queries.queries()[name](spark, SMALL)
    assert sorted(df.columns) == sorted(columns)
    assert by_id(tuple(r[c] for c in columns) for r in df.collect()) == by_id(want.fetchall())


def test_shared_folder_is_the_named_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as p

    rng = random.Random(11)
    docs = quality_docs(rng, 150)
    base = docs[1][1]
    extra = [(1000 + i, base + f" tail{i}") for i in range(5)]
    pairs = [(i, t) for i, t, _ in docs] + extra + [(2000, None)]
    df = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in pairs], "doc_id long, text string, lang string, source string, n_chars long")
    folder = shared_dir(spark) + "/tables"
    df.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, _, q in docs], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    assert [name for name, _ in p.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "suffix-array dedup", "packing"]
    now = df
    for k, (name, stage) in enumerate(p.STAGES[:4]):
        out = stage(spark, now, folder)
        assert out.columns == p.COLUMNS
        before = [(r.doc_id, r.text) for r in now.collect()]
        path = f"{folder}/{k}"
        out.write.mode("overwrite").parquet(path)
        now = spark.read.parquet(path)
        after = {r.doc_id: r.text for r in now.collect()}
        if k == 0:
            assert {i for i, t, q in docs if q} <= after.keys() and sum(i in after for i, _, q in docs if not q) < 5
        elif k == 1:
            assert after == {i: t for i, _, _, t in run_line_dedup(before)}
        elif k == 2:
            assert after.keys() == {i for i, _, _, kept in run_near_duplicates(before) if kept}
        else:
            assert sum(len(t) for t in after.values()) == sum(n - gone for _, n, gone, _, _ in run_suffix(before))
    packed = p.run(spark, folder)
    assert packed.select("doc_id").distinct().count() == now.count() and packed.where("size(ids) <> length").count() == 0
