"""Where the expressions of a table stand in texts: one automaton a block of expressions, leftmost-longest resolution."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Expressions that form one automaton; a larger table is taken in blocks, each of which passes over the texts.
BLOCK_EXPRESSIONS = 100_000
#: So many places leave a task at once, however many a batch of texts holds.
ROWS_AT_ONCE = 20_000


def pieces(rows: Iterable[tuple], names: Sequence[str], most: int = ROWS_AT_ONCE) -> Iterator[pd.DataFrame]:
    """All rows, as frames of up to ``most`` rows: what a task holds at once doesn't grow with the hits of a batch."""
    rows = iter(rows)
    while part := list(islice(rows, most)):
        yield pd.DataFrame(part, columns=list(names))


def occurrences(texts: DataFrame, expressions: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK_EXPRESSIONS, whole: bool = True) -> DataFrame:
    """(key, expression, start, stop) of every place in a text where an expression stands, from 0, overlaps included; or (key, expression) once each.

    expressions has the column ``expression``; equal ones are one, null and empty ones are nowhere, as in null texts.
    Rows of texts that share a key keep their own places. An automaton of up to ``block`` expressions goes to all tasks.
    """
    kind = texts.select(key).schema.fields[0]
    schema = T.StructType([T.StructField(kind.name, kind.dataType), T.StructField("expression", T.StringType())] + ([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())] if whole else []))
    words = expressions.select("expression").filter("expression <> ''").distinct()
    n = max(1, -(-words.count() // block))
    found = None
    for part in range(n):
        own = [r["expression"] for r in (words.filter(F.pmod(F.xxhash64("expression"), F.lit(n)) == part) if n > 1 else words).collect()]  # about ``block`` rows

        def search(batches: Iterator[pd.DataFrame], own=tuple(own)) -> Iterator[pd.DataFrame]:
            automaton = ahocorasick.Automaton()
            for w in own:
                automaton.add_word(w, w)
            if own:
                automaton.make_automaton()

            def rows(batch: pd.DataFrame) -> Iterator[tuple]:
                for k, t in zip(batch[key], batch[text], strict=True):
                    if t and own:
                        if whole:
                            yield from ((k, w, stop - len(w) + 1, stop + 1) for stop, w in automaton.iter(t))
                        else:
                            yield from ((k, w) for w in {w for _, w in automaton.iter(t)})

            for batch in batches:
                yield from pieces(rows(batch), schema.names)

        part_ = texts.select(key, text).mapInPandas(search, schema)
        found = part_ if found is None else found.unionByName(part_)
    return found


def leftmost_longest(places: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of occurrences those that a scan from left to right takes: at each place the longest expression, then on behind it.

    The scan is a fold over one text's places in order. Only the longest expression at a place can be taken, so the others go before.
    """
    longest = F.row_number().over(Window.partitionBy(key, "start").orderBy(F.desc("stop"), "expression"))
    first = places.withColumn("longest", longest).filter("longest = 1").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "stop", "expression"))).alias("places"))
    # an expression is taken if it begins at or behind the end of the last one taken: the ends so far, then a comparison
    ends = F.aggregate(
        "places", F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("taken"), F.lit(0).alias("k")),
        lambda s, p: F.struct(
            F.when(p["start"] >= s["end"], p["stop"]).otherwise(s["end"]).alias("end"), F.when(p["start"] >= s["end"], F.concat(s["taken"], F.array(s["k"]))).otherwise(s["taken"]).alias("taken"), (s["k"] + 1).alias("k"),
        ), lambda s: s["taken"],
    )
    taken = first.select(key, "places", F.explode(ends).alias("k"))
    return taken.select(key, F.get("places", "k").alias("p")).select(key, "p.expression", "p.start", "p.stop")
