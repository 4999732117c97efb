"""License scans by diagonal voting.

The hashes of all rolling word pairs of a text are joined with the places of the
same pairs in the templates (a broadcast table of fixed size).  A match votes
for the diagonal where the template would begin.  Votes are counted by document,
template and diagonal; neighbouring diagonals of a document, as insertions and
omissions leave them, are merged; and what gathers enough votes is verified word
by word in the text.

Phrases count wherever their words stand one after another.  Notices are longer
templates of which some words may differ: they are found where ``MIN_COVER`` of
their words stand in the template's order.

Defined cases: a null or empty text has no words, no places, no labels and score
0; rows without doc_id and rows that repeat one are scanned like all others; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed
from .textblocks import blocks, row_grams, word_bounds, word_hashes

K = 2
#: Diagonals at most so far apart are merged.
NEAR = 3
MIN_COVER = 0.8
MIN_VOTES = 0.5


class Template(NamedTuple):
    label: str
    words: str
    base: bool


#: Phrases with their labels, then customary wordings of notices with ours.
TEMPLATES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
    Template("all-rights-reserved", "all rights reserved", False),
    Template("apache-2.0", "licensed under the apache license version 2 0", False),
    Template("cc-by", "licensed under cc by 4 0", False),
    Template("cc-by-nc", "licensed under cc by nc 4 0", False),
    Template("gpl-notice", "this work is licensed under the gnu general public license version 3", False),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", False),
    Template("mit-notice", "released under the mit license", False),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", False),
    Template("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", False),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", False),
)


def _pair_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in blocks(batches):
        first, last, bounds = word_bounds(data, offsets, "alnum")
        grams, row = row_grams(word_hashes(data, first, last), bounds, K)
        if not len(grams):
            continue
        own = np.maximum(np.diff(bounds) - K + 1, 0)
        pos = np.arange(len(grams)) - np.repeat(np.cumsum(own) - own, own)
        index = pa.array(row)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(index), rows.column("row").take(index), pa.array(pos.astype(np.int32)), pa.array(grams.view(np.int64))], names=["doc_id", "row", "pos", "h"])


def template_places(templates: tuple[Template, ...]) -> list[tuple[int, int, int, int]]:
    """(hash, template, place, votes that a diagonal or merged diagonals need) of every word pair."""
    out = []
    for t, template in enumerate(templates):
        data = np.frombuffer(template.words.encode(), np.uint8)
        first, last, bounds = word_bounds(data, np.array([0, len(data)]), "alnum")
        grams, _ = row_grams(word_hashes(data, first, last), bounds, K)
        need = len(grams) if template.base else max(1, int(np.ceil(MIN_VOTES * len(grams))))
        out += [(int(h), t, i, need) for i, h in enumerate(grams.view(np.int64))]
    return out


def candidates(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Merged diagonals with enough votes: doc_id, row, template, low, high (the diagonals), votes."""
    spark = docs.sparkSession
    places = F.broadcast(spark.createDataFrame(template_places(templates), "h long, template int, place int, need int"))
    hits = keyed(docs).mapInArrow(_pair_rows, "doc_id long, row long, pos int, h long").join(places, "h")
    # A place votes once, however often a row stands in the table.
    voted = hits.groupBy("doc_id", "row", "template", "need", (F.col("pos") - F.col("place")).alias("diagonal")).agg(F.count_distinct("pos").alias("votes"))
    own = Window.partitionBy("doc_id", "row", "template").orderBy("diagonal")
    begins = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(own) > NEAR).cast("int"), F.lit(1))
    runs = voted.withColumn("begins", begins).withColumn("run", F.sum("begins").over(own))
    merged = runs.groupBy("doc_id", "row", "template", "need", "run").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.sum("votes").alias("votes"))
    return merged.where("votes >= need").select("doc_id", "row", "template", "low", "high", "votes")


def places_of(words: list[bytes], phrase: list[bytes], low: int, high: int) -> list[int]:
    n = len(phrase)
    return [i for i in range(max(low, 0), min(high, len(words) - n) + 1) if words[i : i + n] == phrase]


def cover(words: list[bytes], template: list[bytes], low: int, high: int) -> float:
    """The part of the template's words that stand, in order, where the diagonals say."""
    own = words[max(low, 0) : max(high, 0) + len(template)]
    found = SequenceMatcher(None, template, own, autojunk=False).get_matching_blocks()
    return sum(m.size for m in found) / len(template)


def _verified(templates: tuple[Template, ...]):
    split = [t.words.encode().split() for t in templates]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            first, last, bounds = word_bounds(data, offsets, "alnum")
            raw = data.tobytes()
            out = []
            for i, found in enumerate(rows.column("found").to_pylist()):
                a, b = int(bounds[i]), int(bounds[i + 1])
                starts: list[int] = []
                labels, base, score = set(), set(), 0.0
                if found:
                    words = [raw[x:y].lower() for x, y in zip(first[a:b].tolist(), last[a:b].tolist(), strict=True)]
                    for x in found:
                        t = templates[x["template"]]
                        if t.base:
                            own = places_of(words, split[x["template"]], x["low"], x["high"])
                            if own:
                                starts += own
                                base.add(t.label)
                                score = 1.0
                        elif (part := cover(words, split[x["template"]], x["low"], x["high"])) >= MIN_COVER:
                            labels.add(t.label)
                            score = max(score, part)
                out.append((b - a, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("row"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "row", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return run, "doc_id long, row long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """License wordings of every document.

    Returns doc_id, row (hash of the text), n_words, n_base (places of phrases),
    first_word and last_word (their smallest and largest start), base_labels,
    labels (phrases' and notices') and score: 1 with a phrase, else the largest
    part of a notice's words that stands there, 0 without one.
    """
    found = candidates(docs, templates).groupBy("doc_id", "row").agg(F.collect_list(F.struct("template", "low", "high")).alias("found")).alias("c")
    d = keyed(docs).alias("d")
    both = d.join(found.hint("merge"), F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.row") == F.col("c.row")), "left")
    return both.select("d.doc_id", "d.row", "d.text", "c.found").mapInArrow(*_verified(templates))
