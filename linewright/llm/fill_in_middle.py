"""Fill-in-middle transformation by DuckDB inside ``mapInArrow``.

A text of n code points is cut at two places drawn from the SHA-256 of a seed and
the document's id.  Three parts come out, prefix, middle and suffix, and the
output states them in one of two orders behind the marks ``<P>``, ``<S>`` and
``<M>``: prefix, suffix, middle (psm) or suffix, prefix, middle (spm).  A share
of the texts, every empty one and every text that holds a mark stays plain.
``restored`` is rebuilt from the output and its form alone.

Each Arrow batch is cut, without copying, into slices of about a megabyte of
text; each is registered with an in-memory DuckDB of one thread, and one SQL
statement does all the work: ``regexp_extract_all`` takes the code points,
``list_slice`` and ``array_to_string`` the parts, ``sha256`` draws and digests.
No row is touched in Python, nothing is shuffled, nothing spills; a code point
takes some 16 bytes while its slice is at work, so a very long text, which is a
slice of its own, takes that multiple of its length.

A null text counts as empty, a null id as the empty string; repeated rows give
equal rows; columns besides ``doc_id`` and ``text`` are not read, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that one statement takes at a time.
SLICE_BYTES = 1 << 20
#: Per cent of the texts that stay plain, and of the others that are spm.
PLAIN, SPM = 10, 20

_COLUMNS = {
    "n": "long",
    "form": "string",
    "prefix_chars": "long",
    "middle_chars": "long",
    "output": "string",
    "restored": "string",
    "output_sha256": "string",
    "restored_sha256": "string",
}
COLUMNS = ("n", "form", "prefix_chars", "middle_chars", "output", "restored")
DIGESTS = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")

_SQL = """
    WITH t AS (
        SELECT doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM batch),
    f AS (
        SELECT doc_id, text, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
               CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 - {plain} THEN 'plain'
                    WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form
        FROM t),
    u AS (
        SELECT *, CASE WHEN form <> 'plain' THEN regexp_extract_all(text, '(?s).') END AS points FROM f),
    v AS (
        SELECT *, coalesce(len(points), length(text)) AS n, least(h1 % (len(points) + 1), h2 % (len(points) + 1)) AS a, greatest(h1 % (len(points) + 1), h2 % (len(points) + 1)) AS b
        FROM u),
    p AS (
        SELECT doc_id, n, form, a, b, text,
               array_to_string(list_slice(points, 1, a), '') AS prefix,
               array_to_string(list_slice(points, a + 1, b), '') AS middle,
               array_to_string(list_slice(points, b + 1, n), '') AS suffix
        FROM v),
    o AS (
        SELECT doc_id, n, form, a, b,
               CASE form WHEN 'plain' THEN text
                         WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output
        FROM p),
    s AS (
        SELECT *, CASE WHEN form <> 'plain' THEN string_split_regex(output, '<[PSM]>') END AS parts FROM o),
    r AS (
        SELECT doc_id, CAST(n AS BIGINT) AS n, form,
               CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
               output,
               CASE form WHEN 'plain' THEN output
                         WHEN 'psm' THEN parts[2] || parts[4] || parts[3]
                         ELSE parts[3] || parts[4] || parts[2] END AS restored
        FROM s)
    SELECT doc_id, {columns} FROM r
"""


def slices(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about ``limit`` bytes together; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    i = 0
    while i < len(ends):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(i, j - i)
        i = j


def fill_in_middle(docs: DataFrame, *, columns: Sequence[str] = COLUMNS, seed: str = "1", plain: int = PLAIN, spm: int = SPM, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id and ``columns`` of every row of ``docs``: sizes, form, ``output``, ``restored``, and the SHA-256 of these two.

    ``columns`` chooses what DuckDB computes and Arrow carries back: texts
    (:data:`COLUMNS`) or digests (:data:`DIGESTS`).  ``plain`` and ``spm`` are
    per cent.
    """
    if not seed.isalnum():
        raise ValueError("the seed must be letters and digits")
    made = {"output_sha256": "sha256(output) AS output_sha256", "restored_sha256": "sha256(restored) AS restored_sha256"}
    statement = _SQL.format(seed=seed, plain=int(plain), spm=int(spm), columns=", ".join(made.get(c, c) for c in columns))
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([("doc_id", pa.int64()), *((c, kinds[_COLUMNS[c]]) for c in columns)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""}) as db:
            for batch in batches:
                for part in slices(batch, slice_bytes):
                    db.register("batch", pa.Table.from_batches([part]))
                    done = db.execute(statement).to_arrow_table().cast(schema)
                    db.unregister("batch")
                    yield from done.to_batches()

    text = docs["text"].cast("string").alias("text")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} {_COLUMNS[c]}" for c in columns))
