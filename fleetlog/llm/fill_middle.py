"""Fill-in-the-middle: documents cut at two seeded lines and put together in another order.

A batch is worked on as a whole by Arrow kernels: texts are split into list arrays
of units, the units flattened with the index of their text, numbered inside it,
filtered by role (prefix, middle or suffix), put back into lists and joined.
Nothing is shuffled; the seeded numbers are Spark's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, lists_of, small_batches

PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
BATCH_BYTES = 8 << 20


def units(texts: pa.Array) -> pa.ListArray:
    """The units of each text: lines with their line feeds, and what follows the last line feed if that isn't empty."""
    pieces = pc.split_pattern(texts, "\n")
    flat, ends = pieces.flatten(), pieces.offsets.to_numpy()[1:] - pieces.offsets[0].as_py()
    last = np.zeros(len(flat), bool)
    last[ends[ends > np.concatenate([[0], ends[:-1]])] - 1] = True
    flat = pc.binary_join_element_wise(flat, pc.if_else(pa.array(last), "", "\n"), "")
    parents = pc.list_parent_indices(pieces)
    full = pc.or_(pa.array(~last), pc.greater(pc.binary_length(flat), 0))
    return lists_of(flat.filter(full), parents.filter(full), len(texts))


def transform(batch: pa.RecordBatch, markers: tuple[str, str, str]) -> pa.RecordBatch:
    """Adds n, form, prefix_chars, middle_chars and output to a batch with text, low, high (draws for the two cuts) and wanted (form)."""
    before, after, between = markers
    text = pc.fill_null(batch.column("text"), "")
    lists = units(text)
    flat, parents = lists.flatten(), pc.list_parent_indices(lists)
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.sort(np.stack([batch.column(c).to_numpy(zero_copy_only=False) % (n + 1) for c in ("low", "high")]), axis=0)
    of = parents.to_numpy(zero_copy_only=False)
    ordinal = np.arange(len(flat)) - np.concatenate([[0], np.cumsum(n)])[of]
    role = (ordinal >= cuts[0][of]).astype(np.int8) + (ordinal >= cuts[1][of])
    prefix, middle, suffix = (pc.binary_join(lists_of(flat.filter(own), parents.filter(own), len(text)), "") for own in (pa.array(role == r) for r in range(3)))
    plain = pc.equal(pc.binary_length(text), 0)
    for mark in markers:
        plain = pc.or_(plain, pc.match_substring(text, mark))
    form = pc.if_else(plain, "plain", batch.column("wanted"))
    psm = pc.binary_join_element_wise(before, prefix, after, suffix, between, middle, "")
    spm = pc.binary_join_element_wise(after, suffix, before, prefix, between, middle, "")
    output = pc.case_when(pc.make_struct(pc.equal(form, "psm"), pc.equal(form, "spm")), psm, spm, text)
    told = pc.not_equal(form, "plain")
    chars = (pc.if_else(told, pc.cast(pc.utf8_length(x), pa.int64()), None) for x in (prefix, middle))
    return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), form, *chars, output], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """One row per row of `docs`: id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output.

    A unit is a line with its line feed. Two draws from the SHA-256 of seed and
    id say after how many units prefix and middle end; a third, modulo 100, leaves
    texts from `rate` on as they are; a fourth takes spm under `spm_rate`, else
    psm. `markers` stand before prefix, suffix and middle. A text that is empty
    or has a marker in it is plain, and then prefix_chars and middle_chars are
    null. A null text is empty; a null id is drawn for as an empty one, so rows
    with equal ids are cut by the same draws. An empty table gives none; other
    columns are not read.
    """
    if len({m[:1] for m in markers} - {""}) != 1 or len(set(markers)) != 3 or any(m[0] in m[1:] for m in markers):
        raise ValueError("markers must differ, begin with the same character, and not have it again")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    wanted = F.when(draw[2] % 100 >= rate, "plain").when(draw[3] % 100 < spm_rate, "spm").otherwise("psm")
    base = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), draw[0].alias("low"), draw[1].alias("high"), wanted.alias("wanted"))

    def run(batches):
        for batch in batches:
            for start, part in batches_of(batch.column("text"), BATCH_BYTES):
                yield transform(batch.slice(start, len(part)), markers)

    made = base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("id", id_col)


def restored(output: str = "output", form: str = "form", markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that `output` was made of. Markers begin with a character that they don't have again, and no text with one in it is cut, so the first of each is the one that was put in."""
    before, after, between = markers
    whole = F.col(output)
    head = F.substring_index(whole, between, 1)
    middle = F.substring(whole, F.char_length(head) + len(between) + 1, F.char_length(whole))
    first = lambda mark, other: F.substring_index(F.substring(head, F.lit(len(mark) + 1), F.char_length(head)), other, 1)
    second = lambda mark: F.substring_index(head, mark, -1)
    return (
        F.when(F.col(form) == "psm", F.concat(first(before, after), middle, second(after)))
        .when(F.col(form) == "spm", F.concat(second(before), middle, first(after, before)))
        .otherwise(whole)
    )
