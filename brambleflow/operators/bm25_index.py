"""A saved BM25 index whose postings stand in blocks by falling impact, searched with an exact early end.

Postings are range-partitioned by token and impact, so those of a frequent token
lie in many tasks, and cut into blocks that tell their largest impact.  A table
of texts (tokens of each item) gives exact scores of chosen items.

A search reads the first block of each token that a query has, and takes the
exact scores of the best items in these as a threshold: the k-th of them.  What
a query's tokens can give at most tells which of them must stand in an item
that reaches the threshold, and which of their blocks can hold one (MaxScore
over blocks).  Only these blocks are read, and only items whose upper bound
reaches the threshold are scored.  The result is that of a search over all
postings.

Defined cases: as ``bm25``: an empty text counts for the mean length and is never
found; a query without known tokens finds nothing; items that repeat an id are
one item with the tokens of all its texts and the length of each row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.config import shared_folder
from .bm25 import B, K1, LEAST_MEAN, count_matches, query_tokens
from .ranking import ranked

#: Postings of a block, how many times k items get exact scores for the threshold, and postings of a task at most that can be summed.
BLOCK, TRIED, TASK_POSTINGS = 128, 3, 1 << 20
#: Two roundings of a score can differ by as much.
MARGIN = 2e-6
_BLOCKS = "token string, impact double, items array<string>, impacts array<double>"


def _in_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rest: pa.Table | None = None

    def cut(rows: pa.Table) -> pa.RecordBatch:
        token = rows.column("token").combine_chunks()
        n = rows.num_rows
        turns = np.asarray(pc.not_equal(token[1:], token[:-1])) if n > 1 else np.zeros(0, bool)
        begins = np.append(0, np.flatnonzero(turns) + 1)
        sizes = np.diff(np.append(begins, n))
        count = -(-sizes // BLOCK)
        first = np.repeat(begins, count) + BLOCK * (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))
        offsets = pa.array(np.append(first, n).astype(np.int32))
        at = pa.array(first)
        lists = [pa.ListArray.from_arrays(offsets, rows.column(c).combine_chunks()) for c in ("item_id", "impact")]
        return pa.RecordBatch.from_arrays([token.take(at), rows.column("impact").combine_chunks().take(at), *lists], names=["token", "impact", "items", "impacts"])

    for batch in batches:
        if batch.num_rows:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            whole = (rest.num_rows - 1) // BLOCK * BLOCK
            if whole >= 64 * BLOCK:
                # The last token's postings wait, if they fill no block yet.
                last = rest.column("token").combine_chunks()
                same = np.asarray(pc.equal(last, last[len(last) - 1]))
                begin = int(np.argmax(same))
                keep = begin + (rest.num_rows - begin) // BLOCK * BLOCK
                if keep:
                    yield cut(rest.slice(0, keep))
                    rest = rest.slice(keep)
    if rest is not None and rest.num_rows:
        yield cut(rest)


@dataclass
class ImpactIndex:
    """blocks (token, impact: the largest, items, impacts), terms (token, df, impact), texts (item_id, words: token and impact), corpus (n, mean)."""

    blocks: DataFrame
    terms: DataFrame
    texts: DataFrame
    corpus: DataFrame


def save_index(docs: DataFrame, path: str, item: str = "item_id", text: str = "text") -> None:
    """Index the texts and write the four tables."""
    spark = docs.sparkSession
    sized = docs.select(F.col(item).cast("string").alias("item_id"), tokens(F.col(text)).alias("tokens")).withColumn("dl", F.size("tokens"))
    sized.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"), F.greatest(F.coalesce(F.avg("dl"), F.lit(0.0)), F.lit(LEAST_MEAN)).alias("mean")).write.mode("overwrite").parquet(f"{path}/corpus")
    mean = F.lit(spark.read.parquet(f"{path}/corpus").first()["mean"])
    counted = sized.select("item_id", "dl", F.explode("tokens").alias("token")).groupBy("item_id", "token", "dl").agg(F.count("*").alias("tf"))
    impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean))
    texts = counted.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("token", impact.alias("impact")))).alias("words"))
    texts.write.mode("overwrite").parquet(f"{path}/texts")
    postings = spark.read.parquet(f"{path}/texts").select("item_id", F.inline("words"))
    order = ["token", F.desc("impact"), "item_id"]
    postings.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_in_blocks, _BLOCKS).write.mode("overwrite").parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    blocks.groupBy("token").agg(F.sum(F.size("items")).alias("df"), F.max("impact").alias("impact")).write.mode("overwrite").parquet(f"{path}/terms")


def open_index(spark: SparkSession, path: str) -> ImpactIndex:
    return ImpactIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("blocks", "terms", "texts", "corpus")))


def _exact(index: ImpactIndex, asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """Scores of (query_id, item_id) by the items' texts."""
    words = index.texts.join(pairs.select("item_id").distinct(), "item_id", "left_semi").select("item_id", F.inline("words"))
    met = pairs.join(asked.select("query_id", "token", "weight"), "query_id").join(words, ["item_id", "token"])
    return met.groupBy("query_id", "item_id").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))


def search(index: ImpactIndex, queries: DataFrame, k: int, counted: dict[str, int] | None = None) -> DataFrame:
    """The k best items of every query: query_id, item_id, score, rank.

    ``counted`` gets the postings of all tokens that queries have (once for each query), those that were read, and the scored items.
    """
    spark, path = queries.sparkSession, shared_folder(queries.sparkSession, "bm25")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = query_tokens(queries).join(index.terms, "token").crossJoin(F.broadcast(index.corpus)).select("query_id", "token", "df", (F.col("qf") * idf).alias("weight"), (F.col("qf") * idf * F.col("impact")).alias("most"), F.col("impact").alias("top"))
    asked = written(asked, "asked")
    blocks = index.blocks
    # The first blocks: lower bounds.
    first = asked.join(blocks, "token").where(F.col("impact") == F.col("top"))
    partly = first.select("query_id", "weight", F.explode(F.arrays_zip("items", "impacts")).alias("x")).groupBy("query_id", F.col("x.items").alias("item_id")).agg(F.sum(F.col("weight") * F.col("x.impacts")).alias("score"))
    tried = written(ranked(partly, ["query_id"], TRIED * k).select("query_id", "item_id"), "tried")
    known = ranked(_exact(index, asked, tried), ["query_id"], k)
    least = known.where(F.col("rank") == k).select("query_id", (F.col("score") - MARGIN).alias("least"))
    # Tokens that must stand in an item that reaches the threshold, by what the others give together at most.
    rising = Window.partitionBy("query_id").orderBy("most", "token")
    sums = asked.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    sums = sums.withColumn("below", F.sum("most").over(rising)).withColumn("total", F.sum("most").over(Window.partitionBy("query_id")))
    # What a needed token can add where none of its read blocks holds the item: less than would have made a block be read.
    unread = F.when(F.col("below") >= F.col("least"), F.least(F.col("most"), F.greatest(F.col("least") - F.col("total") + F.col("most"), F.lit(0.0)))).otherwise(F.col("most"))
    sums = sums.withColumn("unread", unread).withColumn("rest", F.sum("unread").over(Window.partitionBy("query_id")))
    needed = written(sums.where(F.col("below") >= F.col("least")), "needed")
    met = needed.join(blocks, "token").where(F.col("total") - F.col("most") + F.col("weight") * F.col("impact") >= F.col("least"))
    # Hardly two postings of a file are of one pair, so they are dealt before they are summed, to so many tasks that a task's pairs are bounded.
    tasks = min(2000, max(2 * spark.sparkContext.defaultParallelism, needed.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0] // TASK_POSTINGS))
    rows = met.select("query_id", "least", "rest", "weight", "unread", F.explode(F.arrays_zip("items", "impacts")).alias("x"))
    rows = rows.select("query_id", F.col("x.items").alias("item_id"), "least", "rest", (F.col("weight") * F.col("x.impacts") - F.col("unread")).alias("more")).repartition(tasks, "query_id", "item_id")
    bounds = rows.groupBy("query_id", "item_id").agg(F.first("least").alias("least"), (F.first("rest") + F.sum("more")).alias("upper"))
    candidates = written(bounds.where(F.col("upper") >= F.col("least")).select("query_id", "item_id"), "candidates")
    if counted is not None:
        counted["postings"] = asked.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
        counted["read"] = sum(x.agg(F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0] for x in (first, met))
        counted["scored"] = tried.count() + candidates.count()
        known = asked.select("token", "df").distinct()
        postings = blocks.join(known.select("token"), "token", "left_semi").select("token", F.explode("items").alias("item_id"))
        counted["matches"] = count_matches(asked, postings, known.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0])
    return ranked(_exact(index, asked, candidates).where("score > 0"), ["query_id"], k)
