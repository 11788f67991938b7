"""All phrase lists in one pass over a text (LEX-01, LEX-09, LEX-12).

One automaton holds every phrase of every list, so the cost of a text does not
grow with the number of phrases.  It is built once for each Python worker from
the fixed lists (some 530 phrases) and runs over Arrow batches; a text that is
null gives null.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from baitscope.resources import lexicons as L

LISTS = [*L.CATEGORIES, ("brands", L.BODY_BRANDS), ("misspellings", L.MISSPELLINGS)]
SCHEMA = ", ".join(f"{name}: array<string>" for name, _ in LISTS)


@lru_cache(maxsize=1)
def automaton() -> tuple:
    """The automaton, and for each phrase its places (list, ordinal)."""
    import ahocorasick

    places: dict[str, list[tuple[int, int]]] = {}
    for k, (_, phrases) in enumerate(LISTS):
        for i, phrase in enumerate(phrases):
            places.setdefault(phrase, []).append((k, i))
    found = ahocorasick.Automaton()
    for n, phrase in enumerate(places):
        found.add_word(phrase, n)
    found.make_automaton()
    return found, list(places.values())


def substrings(texts: list[str | None]) -> list[list[list[str]]]:
    """For each list the phrases that each lower-cased text holds, in list order."""
    found, places = automaton()
    columns: list[list[list[str]]] = [[] for _ in LISTS]
    for text in texts:
        held: list[list[int]] = [[] for _ in LISTS]
        for n in {n for _, n in found.iter(text)} if text else ():
            for k, i in places[n]:
                held[k].append(i)
        for (_, phrases), column, ordinals in zip(LISTS, columns, held, strict=True):
            column.append([phrases[i] for i in sorted(ordinals)])
    return columns


def held_phrases(lowered: Column) -> Column:
    """Struct of arrays: the phrases of each list that occur in the text as substrings, in list order."""
    @F.arrow_udf(f"struct<{SCHEMA}>")
    def run(texts: pa.Array) -> pa.Array:
        columns = [pa.array(x, pa.list_(pa.string())) for x in substrings(texts.to_pylist())]
        return pa.StructArray.from_arrays(columns, [name for name, _ in LISTS])

    return run(lowered)
