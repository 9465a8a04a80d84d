"""Fill-in-the-middle forms of texts by in-place block rotation.

A text is cut at two places into prefix, middle and suffix, counted in code points.  The
UTF-8 bytes go into one bytearray; the sentinels ``<P>``, ``<M>`` and ``<S>`` are
inserted before the parts, and two neighbouring blocks are exchanged by three reversals:
``<M>middle`` with ``<S>suffix`` gives the form psm, ``<P>prefix<M>middle`` with
``<S>suffix`` the form spm.  ``restored`` finds the sentinels, makes the inverse rotation
and deletes them, which gives the exact text again: a plain form is any text that
is empty, holds a sentinel itself or is not drawn, so each sentinel occurs once in the others.
(An occurrence cannot straddle a sentinel's border, as ``<`` and ``>`` differ.)

The cuts and the form depend on the seed and the id alone: they are the first
four 8-digit groups of the hexadecimal SHA-256 of ``seed:id``.

Null and empty texts are plain and empty.  A null id counts as empty in ``seed:id``.  Repeated rows
get the same form.  An empty table gives no rows.  Other columns are not read.  One text is
held whole, with its form; no other row matters to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table, two_columns

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"


def exchanged(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """Exchanges the blocks [start, cut) and [cut, end) in place: each is reversed, then both together."""
    for a, b in ((start, cut), (cut, end), (start, end)):
        part = buffer[a:b]
        part.reverse()
        buffer[a:b] = part


def places(text: bytes, *units: int) -> list[int]:
    """Byte offsets of code points by number; the number after the last one is the end."""
    if len(text) == 0:
        return [0 for _ in units]
    starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return [int(starts[u]) if u < len(starts) else len(text) for u in units]


def transformed(text: bytes, form: str, prefix: int, middle: int) -> bytes:
    """The text in its form; ``prefix`` and ``middle`` are numbers of code points."""
    if form == "plain":
        return text
    first, second = places(text, prefix, prefix + middle)
    buffer = bytearray(text)
    buffer[second:second] = SUFFIX
    buffer[first:first] = MIDDLE
    buffer[0:0] = PREFIX
    m, s = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    if form == "psm":
        exchanged(buffer, m, s, len(buffer))
    else:
        exchanged(buffer, 0, s, len(buffer))
    return bytes(buffer)


def restored_text(output: bytes, form: str) -> bytes:
    """The text whose form is ``output``."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    if form == "psm":
        exchanged(buffer, buffer.index(SUFFIX), buffer.index(MIDDLE), len(buffer))
    else:
        exchanged(buffer, 0, buffer.index(PREFIX), len(buffer))
    m, s = buffer.index(MIDDLE), buffer.index(SUFFIX)
    del buffer[s : s + len(SUFFIX)], buffer[m : m + len(MIDDLE)], buffer[0 : len(PREFIX)]
    return bytes(buffer)


def planned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, infill_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """doc_id, text, n, form, prefix_chars, middle_chars: where each text is cut and which form it takes."""
    df = two_columns(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    df = df.withColumn("n", F.char_length("text").cast("long")).withColumn("_h", F.transform(F.array(*(F.lit(8 * k + 1) for k in range(4))), lambda k: F.conv(F.substring(digest, k, F.lit(8)), 16, 10).cast("long")))
    h = lambda k: F.col("_h")[k]
    a, b = h(0) % (F.col("n") + 1), h(1) % (F.col("n") + 1)
    marked = F.contains("text", F.lit(PREFIX.decode())) | F.contains("text", F.lit(SUFFIX.decode())) | F.contains("text", F.lit(MIDDLE.decode()))
    form = F.when((F.col("n") == 0) | marked | (h(2) % 100 >= infill_percent), "plain").when(h(3) % 100 < spm_percent, "spm").otherwise("psm")
    df = df.withColumn("form", form).withColumns({"_first": F.least(a, b), "_second": F.greatest(a, b)})
    some = F.col("form") != "plain"
    return df.select("doc_id", "text", "n", "form", F.when(some, F.col("_first")).alias("prefix_chars"), F.when(some, F.col("_second") - F.col("_first")).alias("middle_chars"))


def rotated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, infill_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: every text in its form."""
    plan = planned(docs, id_col, text_col, seed, infill_percent, spm_percent)
    kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            form, prefix, middle = (batch.column(c).to_pylist() for c in ("form", "prefix_chars", "middle_chars"))
            out = [transformed(t or b"", f, p, m) for t, f, p, m in zip(texts, form, prefix, middle)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.binary()).cast(pa.string())], [*kept, "output"])

    kind = plan.schema["doc_id"].dataType.simpleString()
    return plan.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(forms: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """The rows with ``restored``, the text rebuilt from output and form alone."""
    df = forms.drop("restored")
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, outputs in slices(batches, output_col):
            form = batch.column(batch.schema.get_field_index(form_col)).to_pylist()
            out = [restored_text(t or b"", f) for t, f in zip(outputs, form)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary()).cast(pa.string())], [*names, "restored"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, restored string")


def query(spark, sf_dir: str) -> DataFrame:
    both = restored(rotated(table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
g AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(a, b) AS i, greatest(a, b) AS j, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', substring(t, 1, i), '<S>', substring(t, j + 1), '<M>', substring(t, i + 1, j - i)) ELSE concat('<S>', substring(t, j + 1), '<P>', substring(t, 1, i), '<M>', substring(t, i + 1, j - i)) END) AS output_sha256, sha256(t) AS restored_sha256 FROM f"""
