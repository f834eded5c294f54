"""Fill-in-middle transformation as a pyarrow.compute pipeline.

Spark computes each document's form and cut points from its id and length; the
texts then run batch by batch through ``mapInArrow``: a text is split into a
list of units (code points), the lists are flattened beside their parents'
indices, each unit gets its ordinal in its parent and by it a role (prefix,
middle or suffix), the units of one role are filtered out, lists are rebuilt
and joined, and the pieces are joined with their markers.

A batch is worked in blocks of ``BLOCK`` bytes.  A longer text is cut into
segments of that size at code point borders, whose ordinals go on where the
segment before ended, so memory stays bounded by a block and the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketflow.llm.common import ROW
from marketflow.session import ship_package

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK = 1 << 20
PLAIN_FROM = 90        # of 100: these documents stay plain
SPM_BELOW = 20         # of 100: these have the suffix before the prefix


def units(texts: pa.StringArray) -> pa.ListArray:
    """Each text as the list of its code points, over the texts' own bytes."""
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8, ends[-1]) if data is not None and ends[-1] else np.zeros(0, np.uint8)
    starts = np.flatnonzero((raw[ends[0]:] & 0xC0) != 0x80).astype(np.int32) + ends[0]
    flat = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, ends[-1]).astype(np.int32)), data or pa.py_buffer(b""))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, ends), pa.int32()), flat)


def pieces(texts: pa.StringArray, first: pa.Array, second: pa.Array, base: pa.Array) -> list[pa.Array]:
    """Prefix, middle and suffix of each text: its units below ``first``, up to
    ``second`` and beyond, where its own units count from ``base``."""
    lists = units(texts)
    parent, flat = pc.list_parent_indices(lists), lists.flatten()
    start = pc.subtract(pc.cast(lists.offsets[:-1], pa.int64()), base)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(start, parent))
    after = pc.greater_equal(ordinal, pc.take(second, parent))
    before = pc.less(ordinal, pc.take(first, parent))
    out = []
    for role in (before, pc.invert(pc.or_(before, after)), after):
        sizes = np.bincount(pc.filter(parent, role).to_numpy(), minlength=len(texts))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        out.append(pc.binary_join(pa.ListArray.from_arrays(offsets, pc.filter(flat, role)), ""))
    return out


def segments(text: bytes, block: int) -> Iterator[bytes]:
    """A text's UTF-8 bytes in parts of about ``block`` bytes, cut between code points."""
    at = 0
    while at < len(text):
        end = min(at + block, len(text))
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end += 1
        yield text[at:end]
        at = end


def long_pieces(text: str, first: int, second: int, block: int) -> list[pa.Array]:
    """``pieces`` of one long text, segment by segment."""
    parts, base = ([], [], []), 0
    for part in segments(text.encode("utf-8"), block):
        one = pa.array([part], pa.binary()).cast(pa.string())
        for held, got in zip(parts, pieces(one, *(pa.array([x], pa.int64()) for x in (first, second, base)))):
            held.append(got[0].as_py())
        base += pc.utf8_length(one)[0].as_py()
    return [pa.array(["".join(x)], pa.string()) for x in parts]


def joined(form: pa.Array, texts: pa.Array, prefix: pa.Array, middle: pa.Array, suffix: pa.Array) -> pa.Array:
    """Each document's output by its form."""
    psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    spm = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    return pc.if_else(pc.equal(form, "plain"), texts, pc.if_else(pc.equal(form, "spm"), spm, psm))


def transformed(batch: pa.RecordBatch, block: int) -> Iterator[pa.RecordBatch]:
    """The batch with ``output`` instead of ``text``, in batches of about ``block`` bytes."""
    sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(sizes):
        end, total = at + 1, int(sizes[at])
        while end < len(sizes) and total + sizes[end] <= block:
            total += int(sizes[end])
            end += 1
        part = batch.slice(at, end - at)
        texts, first, second, form = (part.column(c) for c in ("text", "first", "second", "form"))
        if total <= block:
            got = pieces(texts, first, second, pa.array(np.zeros(len(part), np.int64)))
        else:
            got = long_pieces(texts[0].as_py(), first[0].as_py(), second[0].as_py(), block)
        yield part.set_column(part.schema.get_field_index("text"), "output", joined(form, texts, *got))
        at = end


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers from 0 to 2**32 - 1 of a document's id and the seed."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, carry: list[str] | None = None, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """Every row of ``docs`` (``doc_id``, ``text``) with ``__row`` (its ``carry``
    columns, all by default), ``n`` (code points), ``form`` (plain, psm or spm),
    ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``.

    Null texts are empty texts; empty texts and texts that hold a marker stay
    plain; a null id draws as an empty id.  Equal ids draw equally, so repeated
    rows give equal outputs.  The rows of an empty table are none.
    """
    ship_package(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    n = F.length(text).cast("long")
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (n == 0) | marked | (h3 % 100 >= PLAIN_FROM)
    kept = F.struct(*[F.col(f"`{c}`") for c in (carry or docs.columns)])
    rows = docs.select(kept.alias(ROW), text.alias("text"), n.alias("n"),
                       F.when(plain, "plain").when(h4 % 100 < SPM_BELOW, "spm").otherwise("psm").alias("form"),
                       F.least(h1 % (n + 1), h2 % (n + 1)).alias("first"), F.greatest(h1 % (n + 1), h2 % (n + 1)).alias("second"))
    schema = rows.select(ROW, F.col("text").alias("output"), "n", "form", "first", "second").schema

    def run(batches):
        for batch in batches:
            yield from transformed(batch, block)
    done = rows.mapInArrow(run, schema)
    cut = F.col("form") != "plain"
    return done.select(ROW, "n", "form", F.when(cut, F.col("first")).alias("prefix_chars"),
                       F.when(cut, F.col("second") - F.col("first")).alias("middle_chars"), "output")


def restored(output: Column, form: Column) -> Column:
    """The text rebuilt from an output and its form."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)      # a cut text holds no marker of its own
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))
