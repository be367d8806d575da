"""Table functions for SQL text: a track's cues, a text's sections and a reading plan as rows.

    tables.register(spark)
    SELECT c.* FROM tracks, LATERAL subtitle_cues(text, 'captions') c

The functions keep nothing between rows; null texts give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.reading_plans import plan_of
from ..sources.markup import page_text
from ..sources.subtitle_files import cue_of
from ..sources.subtitles import DIALECTS
from .unescape import drop_inner_repeats, unescape_html


@udtf(returnType="pos int, idx int, start_ms long, end_ms long, text string")
class SubtitleCues:
    """``subtitle_cues(text, dialect)``: the cues of a track, numbered from 1."""

    def eval(self, text: str, dialect: str) -> Iterator[tuple]:
        if text is None:
            return
        options = DIALECTS[dialect]
        pos = 0
        for block in re.split(r"\n\s*\n" if options.blank_separator else r"\n\n+", text.replace("\r\n", "\n"), flags=re.ASCII):
            cue = cue_of(block, options)
            if cue:
                pos += 1
                yield (pos, *cue[:4])


@udtf(returnType="section int, heading string, n_lines int, text string")
class TextSections:
    """``text_sections(text, marker)``: the stretches of lines that begin with one that matches; section 0 stands before the first."""

    def eval(self, text: str, marker: str) -> Iterator[tuple]:
        if text is None:
            return
        begins = re.compile(marker)
        section, lines = 0, []
        for line in text.split("\n"):
            if begins.search(line):
                if lines:
                    yield section, lines[0] if section else None, len(lines), "\n".join(lines)
                section, lines = section + 1, []
            lines.append(line)
        if lines:
            yield section, lines[0] if section else None, len(lines), "\n".join(lines)


@udtf(returnType="part int, `offset` long, length long, label string")
class ReadingPlan:
    """``reading_plan(entries, lines, preset)``: the parts of a track to read."""

    def eval(self, entries: int, lines: int, preset: str) -> Iterator[tuple]:
        if entries is not None and lines is not None:
            for part, row in enumerate(plan_of(entries, lines, preset)):
                yield part, *row


def register(spark: SparkSession) -> None:
    """Make the table functions, and functions on texts that need Python, known to SQL by their names."""
    spark.udtf.register("subtitle_cues", SubtitleCues)
    spark.udtf.register("text_sections", TextSections)
    spark.udtf.register("reading_plan", ReadingPlan)
    spark.udf.register("unescape_html", unescape_html)
    spark.udf.register("drop_inner_repeats", drop_inner_repeats)
    spark.udf.register("page_text", page_text)
