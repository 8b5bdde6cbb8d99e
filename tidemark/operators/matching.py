"""Many patterns in one pass over a text.

All patterns form one automaton (Aho-Corasick), which reads each text once however many there are. It is built where the patterns are
few enough, counted first, and broadcast; more patterns are dealt by their hash into as many automata as they need, each of which
reads the texts in a pass of its own, so nothing but one bounded share of the patterns is ever held at once."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns and their characters in one automaton at most.
PATTERNS, CHARS = 1 << 17, 1 << 23
_SPACE = re.compile("[ \t\n\x0b\f\r]+")


def squeezed(text: str) -> str:
    return _SPACE.sub(" ", text.lower())


def _wordly(c: str) -> bool:
    return c.isalnum() or c == "_"


def _reader(shared, whole_words: bool, keep: int, schema: pa.Schema):
    def run(batches):
        machine = shared.value
        for batch in batches:
            rows, found = [], []
            for k, text in enumerate(batch.column(keep).to_pylist()):
                if text:
                    t, seen = squeezed(text), set()
                    for end, (number, pattern) in machine.iter(t):
                        if number not in seen:
                            start = end - len(pattern) + 1
                            if not whole_words or not (start and _wordly(t[start - 1])) and not (end + 1 < len(t) and _wordly(t[end + 1])):
                                seen.add(number)
                                found.append(pattern)
                    rows += [k] * len(seen)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(keep)), pa.array(found, pa.string())], schema=schema)

    return run


def occurrences(texts: DataFrame, text: str, patterns: DataFrame, pattern: str, whole_words: bool = True, most: int = PATTERNS) -> DataFrame:
    """The other columns of texts, and the pattern: a row for each text and different pattern that occurs in it, case and runs of white
    space aside (patterns come out lower-cased and squeezed). Whole words: no letter, digit or underscore stands beside an occurrence.

    Null texts and null or blank patterns occur nowhere. patterns may repeat."""
    spark, keep = texts.sparkSession, [c for c in texts.columns if c not in (text, pattern)]
    own = F.trim(F.regexp_replace(F.lower(pattern), r"[ \t\n\x0B\f\r]+", " "))
    wanted = patterns.select(own.alias(pattern)).filter(F.col(pattern) != "").distinct()
    n, chars = wanted.agg(F.count("*"), F.coalesce(F.sum(F.char_length(pattern)), F.lit(0))).first()
    passes = max(1, -(-n // most), -(-chars // CHARS))
    rows = texts.select(*keep, text)
    fields = [f for f in rows.schema.fields if f.name != text]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{pattern}` string"
    got = None
    for k in range(passes):
        share = wanted.filter(F.pmod(F.xxhash64(pattern), F.lit(passes)) == k)
        machine = ahocorasick.Automaton()
        for number, r in enumerate(share.toLocalIterator()):  # `most` patterns, about
            machine.add_word(r[0], (number, r[0]))
        if len(machine):
            machine.make_automaton()
            schema = pa.schema([pa.field(f.name, t) for f, t in zip(fields, _arrow(rows.select(*keep)), strict=True)] + [pa.field(pattern, pa.string())])
            found = rows.mapInArrow(_reader(spark.sparkContext.broadcast(machine), whole_words, len(keep), schema), kinds)
            got = found if got is None else got.unionByName(found)
    return spark.createDataFrame([], kinds) if got is None else got


def _arrow(df: DataFrame) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return [f.type for f in to_arrow_schema(df.schema)]
