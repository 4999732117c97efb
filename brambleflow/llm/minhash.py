"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

Documents with the same shingle set form one class, stood for by its smallest
doc_id.  A class has 128 minima; bands of four rows each give candidate buckets,
and the two lowest bits of every minimum are packed into four longs.  Bit counts
of two packed signatures estimate similarity, corrected for the chance that two
different minima agree in their low bits; only candidates far below the
threshold (five standard errors and more) go unconfirmed.  A bitmap of hashed
shingles gives an upper bound of the true intersection, which refutes most of
the rest without reading a set.

Within a bucket all members are first held against its smallest id, which ties
large groups of copies together with as many pairs as members.  What a bucket
still holds of different components is then compared pair by pair, in blocks of
bounded size, so every candidate pair is either confirmed, refuted or already
connected.  Two sets of similarity 0.75 share no band with probability 5e-6.

Defined cases: a null, empty or blank text has no shingles and no links; a text
of fewer words than a shingle is one shingle; rows without doc_id are linked
with nothing and kept; rows that share a doc_id are one node, whatever their
texts; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, settle
from .graph import components
from .textblocks import blocks, gram_hashes, mixed, word_bounds, word_hashes

BANDS, ROWS, BITS = 32, 4, 2
PERMS = BANDS * ROWS
LANES = PERMS * BITS // 64
#: Standard errors of the estimate between the threshold and the lowest estimate that is confirmed.
SLACK = 5
BLOCK_MEMBERS = 2048
#: What tells classes apart, and the part of all documents above which a class is large.
CLASS, LARGE = ["fp1", "fp2", "n_shingles"], 4096
#: Bits of the bitmap of hashed shingles.
BITMAP = 4096
_mult = np.random.default_rng(20240229)
_XOR = _mult.integers(0, 1 << 32, PERMS, dtype=np.uint32)
_MUL = _mult.integers(0, 1 << 32, PERMS, dtype=np.uint32) | np.uint32(1)
LOW = 0x5555555555555555


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one row after the other, and the rows' bounds (n + 1)."""
    first, last, bounds = word_bounds(data, offsets, "space")
    words = word_hashes(data, first, last)
    grams = gram_hashes(words, k)
    parts, counts = [], np.zeros(len(bounds) - 1, np.int64)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if b - a >= k:
            own = np.sort(grams[a : b - k + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            own = own[keep]
        elif b > a:
            own = gram_hashes(words[a:b] ^ np.uint64(b - a), b - a)
        else:
            continue
        parts.append(own)
        counts[i] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)])


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The minima (32 bits each) of the non-empty rows' sets."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), PERMS), np.uint32)
    low = (sets >> np.uint64(32)).astype(np.uint32)
    turn = np.empty_like(low)
    for j in range(PERMS):
        np.bitwise_xor(low, _XOR[j], out=turn)
        np.multiply(turn, _MUL[j], out=turn)
        out[:, j] = np.minimum.reduceat(turn, starts)
    return out


def packed(minima: np.ndarray) -> np.ndarray:
    """The two lowest bits of the minima, as LANES longs a row."""
    spread = (minima ^ (minima >> np.uint32(16))) & np.uint32(3)
    bits = np.empty((len(minima), PERMS * BITS), np.uint8)
    bits[:, 0::2], bits[:, 1::2] = spread & 1, spread >> 1
    return np.packbits(bits, axis=1).view(np.int64)


def bitmaps(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which of BITMAP cells each row's shingles fall into, as bytes."""
    out = np.zeros((len(bounds) - 1, BITMAP), bool)
    out[np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), (sets & np.uint64(BITMAP - 1)).astype(np.int64)] = True
    return np.packbits(out, axis=1)


def _sign(k: int):
    lanes = [f"s{i}" for i in range(LANES)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            sets, bounds = shingle_sets(data, offsets, k)
            counts = np.diff(bounds)
            some = np.flatnonzero(counts)
            prints = np.zeros((2, rows.num_rows), np.int64)
            bands = np.zeros((rows.num_rows, BANDS), np.int64)
            lows = np.zeros((rows.num_rows, LANES), np.int64)
            if len(some):
                starts = bounds[some]
                prints[0, some] = np.add.reduceat(mixed(sets), starts).view(np.int64)
                prints[1, some] = np.add.reduceat(mixed(sets ^ np.uint64(LOW)), starts).view(np.int64)
                minima = signatures(sets, bounds)
                lows[some] = packed(minima)
                pairs = minima.view(np.uint64).reshape(len(some), BANDS, ROWS // 2)
                keys = mixed(pairs[:, :, 0]) ^ mixed(pairs[:, :, 1] + np.uint64(LOW))
                bands[some] = mixed(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(LOW)).view(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(rows.num_rows + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("row"), pa.array(counts), pa.array(prints[0]), pa.array(prints[1]), *(pa.array(lows[:, i].copy()) for i in range(LANES)), flat, pa.array(list(map(bytes, bitmaps(sets, bounds))), pa.binary())], names=["doc_id", "row", "n_shingles", "fp1", "fp2", *lanes, "bands", "bits"])

    schema = "doc_id long, row long, n_shingles long, fp1 long, fp2 long, " + ", ".join(f"{x} long" for x in lanes) + ", bands array<long>, bits binary"
    return run, schema


def _set_rows(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            sets, bounds = shingle_sets(data, offsets, k)
            blobs = [sets[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(blobs, pa.binary())], names=["id", "shingles"])

    return run, "id long, shingles binary"


def _confirmed(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(a), len(b)) * 100 >= max(len(a), len(b)) * percent:
                    both = np.concatenate([a, b])
                    both.sort()
                    same = int(np.count_nonzero(both[1:] == both[:-1]))
                    keep[i] = 100 * same >= percent * (len(a) + len(b) - same)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(mask), batch.column("v").filter(mask)], names=["u", "v"])

    return run


def least_estimate(percent: int) -> float:
    """The lowest estimate of pairs that are confirmed."""
    chance, j = 0.5**BITS, percent / 100
    agree = chance + (1 - chance) * j
    return j - SLACK * (agree * (1 - agree) / PERMS) ** 0.5 / (1 - chance)


def most_different(percent: int) -> int:
    """The most minima whose low bits may differ, so that the corrected estimate reaches ``least_estimate``."""
    chance = 0.5**BITS
    return int((1 - (chance + (1 - chance) * least_estimate(percent))) * PERMS)


def _different(a: str, b: str) -> Column:
    """How many minima of two packed signatures have different low bits."""
    total = F.lit(0)
    for i in range(LANES):
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(LOW)))
    return total


def _cross_pairs(limit: int, percent: int):
    """Over rows sorted by bucket and block pair: candidate pairs between components."""
    lanes = [f"s{i}" for i in range(LANES)]

    def pairs(ids, labels, side, low, n, bits) -> tuple[np.ndarray, np.ndarray]:
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        us, vs = [], []
        more = n - np.bitwise_count(bits).sum(axis=1)
        for i in left.tolist():
            x = low[right] ^ low[i]
            far = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(LOW)).sum(axis=1)
            hit = right[(far <= limit) & (labels[right] != labels[i]) & ((side[i] == 0) | (ids[right] > ids[i]))]
            if len(hit):
                most = np.bitwise_count(bits[hit] & bits[i]).sum(axis=1) + np.minimum(more[hit], more[i])
                hit = hit[100 * most >= percent * (n[hit] + n[i] - most)]
            us.append(np.full(len(hit), ids[i]))
            vs.append(ids[hit])
        if not us:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        u, v = np.concatenate(us), np.concatenate(vs)
        return np.minimum(u, v), np.maximum(u, v)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        seen: set[tuple[int, int]] = set()

        def flush() -> pa.RecordBatch | None:
            t = pa.Table.from_batches(held)
            held.clear()
            low = np.stack([t.column(x).to_numpy() for x in lanes], axis=1).view(np.uint64)
            bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(-1, BITMAP // 64)
            u, v = pairs(t.column("id").to_numpy(), t.column("label").to_numpy(), t.column("side").to_numpy(), low, t.column("n_shingles").to_numpy(), bits)
            fresh = [p for p in set(zip(u.tolist(), v.tolist(), strict=True)) if p not in seen]
            if len(seen) > 200_000:
                seen.clear()
            seen.update(fresh)
            if fresh:
                return pa.RecordBatch.from_arrays([pa.array([p[0] for p in fresh], pa.int64()), pa.array([p[1] for p in fresh], pa.int64())], names=["u", "v"])
            return None

        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, g = batch.column("h").to_numpy(), batch.column("g").to_numpy()
            edges = np.flatnonzero((h[1:] != h[:-1]) | (g[1:] != g[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(h)], strict=True):
                if held and (h[a], g[a]) != key and (found := flush()) is not None:
                    yield found
                key = (h[a], g[a])
                held.append(batch.slice(a, b - a))
        if held and (found := flush()) is not None:
            yield found

    return run


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    with_x = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("x")), "u")
    with_y = with_x.join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("y")), "v")
    return settle(with_y.select("u", "v", "x", "y").mapInArrow(_confirmed(percent), "u long, v long"), "links")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 75) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of ``percent`` or more of their word shingles.

    Returns one row per document: doc_id, row (hash of its text), n_shingles,
    component_id (smallest doc_id of its group), kept (it is that document).
    """
    rows = keyed(docs)
    signed = settle(rows.mapInArrow(*_sign(shingle_words)), "signatures")
    lanes = [f"s{i}" for i in range(LANES)]
    own = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Equal sets have equal signatures, so a class is made by aggregation, which meets its copies task by task.
    classes = settle(own.groupBy(*CLASS).agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in (*lanes, "bands", "bits"))), "classes")
    nodes = classes.select("id", "n_shingles", *lanes, "bands", "bits")
    # A doc_id on rows of several classes is one node.
    known = signed.where("doc_id IS NOT NULL").select("doc_id", *CLASS)
    several = settle(known.groupBy("doc_id").agg(F.min(F.struct(*CLASS)).alias("low"), F.max(F.struct(*CLASS)).alias("high")).where("low <> high").select("doc_id"), "several")
    tied = own.select("doc_id", *CLASS).join(several, "doc_id", "left_semi").join(classes.select(*CLASS, "id"), CLASS).where("doc_id <> id").select(F.col("id").alias("u"), F.col("doc_id").alias("v")).distinct()
    members = nodes.select("id", F.explode("bands").alias("h"))
    nodes = nodes.drop("bands")
    buckets = members.groupBy("h").agg(F.min("id").alias("center"), F.max("id").alias("other")).where("center <> other").select("h", "center")
    members = settle(members.join(buckets, "h").distinct(), "buckets")

    # The hint keeps one plan at every size; the texts' side is the large one.
    ids = members.select(F.col("id").alias("doc_id")).distinct().hint("merge")
    sets = settle(rows.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(*_set_rows(shingle_words)), "shingles")

    limit = most_different(percent)
    star = members.where("id <> center").select(F.col("center").alias("u"), F.col("id").alias("v")).distinct()
    a, b = nodes.alias("a"), nodes.alias("b")
    star = star.join(a, F.col("u") == F.col("a.id")).join(b, F.col("v") == F.col("b.id")).where(_different("a", "b") <= limit).select("u", "v")
    links = settle(_confirm(settle(star, "pairs"), sets, percent).union(tied), "links")
    labels = components(links)

    named = members.join(labels, "id", "left").select("h", "id", F.coalesce("component", "id").alias("label"))
    open_ = named.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low <> high")
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_MEMBERS)).cast("int")
    blocked = named.join(open_.select("h", parts.alias("parts")), "h").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct((F.least(j, F.col("part")) * F.col("parts") + F.greatest(j, F.col("part"))).alias("g"), F.when(j == F.col("part"), 2).when(F.col("part") < j, 0).otherwise(1).alias("side")))
    spread = blocked.select("h", "id", "label", F.explode(others).alias("x")).select("h", "x.g", "x.side", "id", "label").join(nodes, "id")
    cross = spread.select("h", "g", "side", "id", "label", "n_shingles", *lanes, "bits").repartition("h", "g").sortWithinPartitions("h", "g").mapInArrow(_cross_pairs(limit, percent), "u long, v long").distinct()
    more = _confirm(settle(cross, "pairs"), sets, percent)
    labels = components(links.union(more))

    named = classes.select(*CLASS, "id", "n").join(labels, "id", "left").select(*CLASS, "n", F.coalesce("component", "id").alias("component"))
    named = settle(named, "components")
    out = _with_classes(signed.where("n_shingles > 0").select("doc_id", "row", *CLASS), named)
    # A text without shingles belongs to its document, which may have others.
    others = own.select("doc_id", *CLASS).join(several, "doc_id", "left_semi").join(named, CLASS).groupBy("doc_id").agg(F.min("component").alias("component"))
    empty = signed.where("n_shingles = 0").select("doc_id", "row", *CLASS).join(others.hint("merge"), "doc_id", "left")
    out = out.unionByName(empty)
    group = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "row", "n_shingles", group.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _with_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows with their class's component.

    A class of more than a LARGE-th of all documents would fill one task of a
    join; there are fewer than LARGE of them, so they are broadcast.
    """
    least = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()["all"] // LARGE
    large = F.broadcast(classes.where(F.col("n") > least).select(*(F.col(c).alias(f"l_{c}") for c in CLASS), F.col("component").alias("large")))
    of = [F.col(c) == F.col(f"l_{c}") for c in CLASS]
    first = rows.join(large, of, "left").drop(*(f"l_{c}" for c in CLASS))
    rest = classes.where(F.col("n") <= least).drop("n").hint("merge")
    done = first.where("large IS NOT NULL").withColumnRenamed("large", "component")
    return done.unionByName(first.where("large IS NULL").drop("large").join(rest, CLASS, "left"))
