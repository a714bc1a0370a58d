"""Fill-in-the-middle forms of texts, by DuckDB SQL inside ``mapInArrow``.

A text is cut into units (runs of ASCII letters, and any other code point alone) and, at two places
drawn from a digest of seed and id, into prefix, middle and suffix.  The parts are then put into an order
that has the middle last (``psm`` or ``spm``), with sentinels between them, or the text stays as it is (``plain``).

Each Arrow batch that Spark hands over is registered with a DuckDB connection of its task, and one SQL statement makes
the rows of the result, in Arrow again: there is no Python per row.  Batches are bounded by bytes.  The
connection has one thread, a memory limit and no folder to spill to.  Rows are independent, so nothing is shuffled,
and a task that is lost is simply run again with the same result.

``restored`` is the way back, as a column of Spark: a text with a sentinel in it stays plain, and no sentinel can arise where parts
and sentinels meet (it begins with its only ``<`` and ends with its only ``>``), so that the first ones found are those put in.

Defined results.  A null text counts as empty; an empty text is plain, with no units.  A null id is an empty string in
the digest.  Repeated rows get equal results.  Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches

#: The sentinels, and what a unit is.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = "[A-Za-z]+|[^A-Za-z]"
FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string"

_SQL = """
WITH rows AS (
  SELECT id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(id::VARCHAR, '')) AS h FROM batch
), cut AS (
  SELECT id, text, regexp_extract_all(text, '{unit}') AS units,
    ('0x' || substr(h, 1, 8))::UBIGINT AS h1, ('0x' || substr(h, 9, 8))::UBIGINT AS h2,
    ('0x' || substr(h, 17, 8))::UBIGINT AS h3, ('0x' || substr(h, 25, 8))::UBIGINT AS h4
  FROM rows
), placed AS (
  SELECT id, text, units, len(units)::BIGINT AS n,
    least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS lo, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS hi,
    CASE WHEN text = '' OR contains(text, '{p}') OR contains(text, '{s}') OR contains(text, '{m}') OR h3 % 100 >= {rate} THEN 'plain'
      WHEN h4 % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT id, text, n, form,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, 1, lo), '') END AS pre,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, lo + 1, hi), '') END AS mid,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, hi + 1, n), '') END AS suf
  FROM placed)
SELECT id, n, form, length(pre)::BIGINT AS prefix_chars, length(mid)::BIGINT AS middle_chars,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{p}' || pre || '{s}' || suf || '{m}' || mid ELSE '{s}' || suf || '{p}' || pre || '{m}' || mid END AS output
FROM parts
"""


def _transform(seed: int, rate: int, spm: int, memory: str):
    sql = _SQL.format(seed=seed, unit=UNIT, p=PREFIX, s=SUFFIX, m=MIDDLE, rate=rate, spm=spm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": ""}) as con:
            for batch in batches:
                con.register("batch", pa.Table.from_batches([batch]))
                yield from con.sql(sql).to_arrow_table().to_batches()
                con.unregister("batch")

    return run


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = 90, spm: int = 20, memory: str = "800MB", batch_bytes: int = 4 << 20) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of each row.

    n counts units; rate is the share of texts (in hundredths) that are transformed, spm the share of these with the suffix first.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return bounded_batches(rows, batch_bytes).mapInArrow(_transform(seed, rate, spm, memory), f"id {kind}, {FIELDS}")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    head, last = F.split_part(output, F.lit(MIDDLE), F.lit(1)), F.split_part(output, F.lit(MIDDLE), F.lit(2))
    start = F.lit(len(PREFIX) + 1)
    first, second = (F.split_part(head.substr(start, F.length(head)), F.lit(mark), F.lit(k)) for mark, k in ((SUFFIX, 1), (SUFFIX, 2)))
    spm_suffix, spm_prefix = (F.split_part(head.substr(start, F.length(head)), F.lit(PREFIX), F.lit(k)) for k in (1, 2))
    return F.when(form == "psm", F.concat(first, last, second)).when(form == "spm", F.concat(spm_prefix, last, spm_suffix)).otherwise(output)
