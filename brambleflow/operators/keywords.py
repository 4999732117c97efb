"""Which keywords of a dictionary texts contain, by one pass over each text.

The keywords make an Aho-Corasick automaton, so the time of a text doesn't grow
with the dictionary.  A dictionary beyond PART keywords is dealt to parts by a
hash, each with an automaton and a pass of its own: what a task holds and what
is broadcast stay bounded.

Defined cases: null texts and null keywords meet nothing; the empty keyword is in
every text; keywords that repeat count once; texts are met as they stand (callers
lower-case both).  Texts that repeat should be met once, by ``distinct``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keywords of an automaton, about.
PART = 1 << 16

_automata: dict[tuple[int, int], object] = {}


def _automaton(words):
    """The worker's automaton of a broadcast list of keywords."""
    import ahocorasick

    key = (words.value[0], words.value[1])
    if key not in _automata:
        if len(_automata) >= 4:
            _automata.clear()
        out = ahocorasick.Automaton()
        for word in words.value[2]:
            out.add_word(word, word)
        if words.value[2]:
            out.make_automaton()
        _automata[key] = out
    return _automata[key]


def _found(words, everywhere: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(words)
        some = len(automaton) > 0
        for batch in batches:
            texts, rows, keywords = batch.column("text"), [], []
            for i, text in enumerate(texts.to_pylist()):
                if text is not None:
                    own = {word for _, word in automaton.iter(text)} if some else set()
                    own |= {""} if everywhere else set()
                    rows += [i] * len(own)
                    keywords += own
            yield pa.RecordBatch.from_arrays([texts.take(pa.array(rows, pa.int64())), pa.array(keywords, pa.string())], names=["text", "keyword"])

    return run


def contained(texts: DataFrame, dictionary: DataFrame, part: int = PART) -> DataFrame:
    """(text, keyword) of each text (text) and each distinct keyword (keyword) that it contains."""
    import uuid

    spark = texts.sparkSession
    words = dictionary.select("keyword").dropna().distinct()
    parts = 1 + words.count() // part
    number, out = uuid.uuid4().int >> 64, None
    for p in range(parts):
        own = [r[0] for r in words.where(F.pmod(F.xxhash64("keyword"), F.lit(parts)) == p).collect()]
        held = spark.sparkContext.broadcast((number, p, [w for w in own if w]))
        found = texts.select("text").mapInArrow(_found(held, "" in own), "text string, keyword string")
        out = found if out is None else out.unionByName(found)
    return out
