"""Script conversion by chains of mapping tables, such as simplified to traditional characters with regional words.

A configuration is a chain of steps, and a step a set of mapping tables.  In a step
the text is read from left to right and the longest entry that begins at a place is
replaced, so phrases go before characters; what was replaced isn't read again in the
same step, but the next step reads it.  Tables are rows (config, step, rank, source,
target): of entries with one source in a step that of the lowest rank counts, so
phrase tables may override character tables.

A step becomes one automaton (some hundred bytes an entry), built once in each
worker; a text is read once a step, and of the entries found at a place the longest
is kept.  Entries are
counted before they are collected, and more than ``most_entries`` are refused, so
what is sent to the workers has a bound.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .unescape import mapped

#: The chains of the configurations in use (fixed values): the steps, and the tables of each.
CONFIGS = {
    "s2t": [("phrases_st", "characters_st")],
    "t2s": [("phrases_ts", "characters_ts")],
    "s2twp": [("phrases_st", "characters_st"), ("phrases_tw",), ("variants_tw",)],
    "s2hk": [("phrases_st", "characters_st"), ("variants_hk",)],
    "tw2sp": [("phrases_tw_back", "variants_tw_back"), ("phrases_ts", "characters_ts")],
}
_RESULT = StructType([StructField("text", StringType()), StructField("changed", LongType())])
#: The automata that a worker built last, by the name of their chain.
_BUILT: dict = {}


def chain(tables: dict[str, DataFrame], config: str) -> DataFrame:
    """The rows of a configuration from its named tables of (source, target)."""
    out = None
    for step, names in enumerate(CONFIGS[config]):
        for rank, name in enumerate(names):
            rows = tables[name].select(F.lit(config).alias("config"), F.lit(step).alias("step"), F.lit(rank).alias("rank"), "source", "target")
            out = rows if out is None else out.unionByName(rows)
    return out


def _automata(name: str, steps: list[list[tuple[str, str]]]) -> list:
    import ahocorasick

    if name not in _BUILT:
        _BUILT.clear()
        made = []
        for entries in steps:
            own = ahocorasick.Automaton()
            for source, target in entries:
                own.add_word(source, (len(source), target))
            own.make_automaton()
            made.append(own)
        _BUILT[name] = made
    return _BUILT[name]


def converted(text: str, automata: list) -> str:
    """The text after every step: from left to right the longest entry at each place."""
    for own in automata:
        longest: dict[int, tuple[int, str]] = {}
        for end, entry in own.iter(text):  # of one place the longer entries come later
            longest[end + 1 - entry[0]] = entry
        out, at = [], 0
        for start in sorted(longest):
            if start >= at:
                size, target = longest[start]
                out += (text[at:start], target)
                at = start + size
        text = "".join([*out, text[at:]]) if out else text
    return text


def changed_characters(before: str, after: str) -> int:
    """Places, up to the end of the shorter text, that hold different characters."""
    return sum(a != b for a, b in zip(before, after, strict=False))


def convert_script(df: DataFrame, table: DataFrame, config: str, text: str = "text", most_entries: int = 1_000_000) -> DataFrame:
    """``df`` with ``text`` converted by the rows of ``config`` in ``table``, and ``changed_chars``.

    Null texts stay null with a null count; empty sources and null targets are
    left out; a configuration without rows is an error.
    """
    own = table.where((F.col("config") == config) & (F.col("source") != "") & F.col("target").isNotNull())
    first = own.withColumn("_r", F.row_number().over(Window.partitionBy("step", "source").orderBy("rank", "target"))).where("_r = 1")
    rows = first.select("step", "source", "target").limit(most_entries + 1).collect()
    if not rows:
        raise ValueError(f"no entries for {config}")
    if len(rows) > most_entries:
        raise ValueError(f"more than {most_entries} entries for {config}")
    steps = [[(r["source"], r["target"]) for r in rows if r["step"] == s] for s in sorted({r["step"] for r in rows})]
    name, shared = uuid.uuid4().hex, df.sparkSession.sparkContext.broadcast(steps)

    @F.arrow_udf(_RESULT)
    def run(texts: pa.Array) -> pa.Array:
        automata, changed = _automata(name, shared.value), []

        def one(x: str) -> str:
            y = converted(x, automata)
            changed.append(changed_characters(x, y))
            return y

        after = mapped(texts, one)
        counts = iter(changed)
        numbers = pa.array([next(counts) if valid.as_py() else None for valid in after.is_valid()], pa.int64())
        return pa.StructArray.from_arrays([after, numbers], ["text", "changed"])

    out = df.withColumn("_c", run(F.col(text)))
    return out.withColumns({text: F.col("_c.text"), "changed_chars": F.col("_c.changed")}).drop("_c")
