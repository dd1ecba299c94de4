"""Fill-in-the-middle examples as a pipeline of Arrow kernels; no text becomes a Python object.

A batch of texts is split into units (list arrays), the lists are flattened with the index of their text, every unit
gets its ordinal and from that its role (prefix, middle or suffix), the units of each role are filtered out and
rebuilt as lists, and the lists are joined to pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import arrow_schema, documents_of, sliced_by_bytes

# The marks of prefix, suffix and middle.
MARKS = (b"<P>", b"<S>", b"<M>")
# A unit ends where white space follows another character. No UTF-8 text holds the byte that is put there.
_BORDER, _CUT = rb"([^\x20\x09-\x0D])([\x20\x09-\x0D])", b"\xff"


def _scalar(value: bytes) -> pa.Scalar:
    return pa.scalar(value, pa.large_binary())


def _modulo(value: pa.Array, by) -> pa.Array:
    return pc.subtract(value, pc.multiply(pc.divide(value, by), by))


def _texts(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_string()).cast(pa.large_binary())


def _lists(counts: pa.Array, values: pa.Array) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts.to_numpy(zero_copy_only=False))])
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), values)


def units_of(texts: pa.Array) -> pa.Array:
    """Lists of units: white space with the characters after it; white space at the end is a unit of its own.

    The empty text is one empty unit.
    """
    return pc.split_pattern(pc.replace_substring_regex(texts, _BORDER, rb"\1" + _CUT + rb"\2"), _CUT)


def pieces_of(units: pa.Array, first: pa.Array, second: pa.Array) -> list[pa.Array]:
    """Prefix, middle and suffix of every list of units, cut before the units number `first` and `second`."""
    lengths = pc.list_value_length(units).cast(pa.int64())
    starts = pc.subtract(pc.cumulative_sum(lengths), lengths)
    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(starts, parent))
    before, until = pc.less(ordinal, pc.take(first, parent)), pc.less(ordinal, pc.take(second, parent))
    roles = [
        (before, first),
        (pc.and_not(until, before), pc.subtract(second, first)),
        (pc.invert(until), pc.subtract(lengths, second)),
    ]
    return [pc.binary_join(_lists(counts, flat.filter(mask)), _scalar(b"")) for mask, counts in roles]


def _joined(*parts) -> pa.Array:
    return pc.binary_join_element_wise(*parts, _scalar(b""))


def _transformed(batch: pa.RecordBatch, plain_share: int, spm_share: int) -> list[pa.Array]:
    h1, h2, h3, h4 = (batch.column(f"h{i}") for i in (1, 2, 3, 4))
    texts = _texts(batch.column("text"))
    units = units_of(texts)
    empty = pc.equal(pc.binary_length(texts), 0)
    n = pc.if_else(empty, 0, pc.list_value_length(units).cast(pa.int64()))
    marked = [pc.match_substring(texts, mark) for mark in MARKS]
    drawn = pc.greater_equal(_modulo(h3, 100), plain_share)
    plain = pc.or_(pc.or_(empty, drawn), pc.or_(marked[0], pc.or_(marked[1], marked[2])))
    form = pc.if_else(plain, "plain", pc.if_else(pc.less(_modulo(h4, 100), spm_share), "spm", "psm"))
    one, two = (_modulo(h, pc.add(n, 1)) for h in (h1, h2))
    prefix, middle, suffix = pieces_of(units, pc.min_element_wise(one, two), pc.max_element_wise(one, two))
    p, s, m = map(_scalar, MARKS)
    spm = _joined(s, suffix, p, prefix, m, middle)
    psm = _joined(p, prefix, s, suffix, m, middle)
    output = pc.if_else(plain, texts, pc.if_else(pc.equal(form, "spm"), spm, psm))
    chars = [pc.if_else(plain, None, pc.utf8_length(x.cast(pa.large_string())).cast(pa.int64())) for x in (prefix, middle)]
    return [batch.column("doc_id"), n, form, *chars, output]


def fill_in_middle(
    docs: DataFrame, seed: str = "42", shares: tuple[int, int] = (50, 80), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n (units), form (plain, spm or psm), prefix_chars, middle_chars, output.

    The draws come from SHA-256 of the seed, a colon and the id, so a document has one result wherever it is computed.
    `shares` are the percentages of documents that are rearranged and, of those, of the suffix-first form. Null texts
    count as empty; the empty text and texts that hold a mark stay plain, with null prefix_chars and middle_chars.
    A null id draws as the empty string does; repeated rows stay; an empty table gives no rows.
    """
    columns = documents_of(docs, id_col, text_col)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = {f"h{i + 1}": F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)}
    ddl = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in sliced_by_bytes(batches, "text"):
            made = _transformed(batch, *shares)
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(made, schema)], schema=schema)

    return columns.withColumns(draws).mapInArrow(run, ddl)


def _split(texts: pa.Array, mark: bytes) -> tuple[pa.Array, pa.Array]:
    """What is before and what is after the first of these marks; every text has one."""
    parts = pc.split_pattern(texts, mark, max_splits=1)
    return pc.list_element(parts, 0), pc.list_element(parts, 1)


def _restored(form: pa.Array, output: pa.Array) -> pa.Array:
    """The texts from their outputs; marks occur nowhere but where they were put, so the first of each is the one."""
    texts, made = _texts(output), pc.not_equal(form, "plain")
    at = pc.indices_nonzero(made)
    spm = pc.equal(pc.take(form, at), "spm")
    head, middle = _split(pc.take(texts, at), MARKS[2])
    places, starts, ends = [], [], []
    for mask, opening, between in ((spm, MARKS[1], MARKS[0]), (pc.invert(spm), MARKS[0], MARKS[1])):
        first, second = _split(_split(head.filter(mask), opening)[1], between)
        places.append(pc.indices_nonzero(mask))
        starts.append(second if between == MARKS[0] else first)
        ends.append(first if between == MARKS[0] else second)
    order = pc.sort_indices(pa.concat_arrays(places))
    prefix, suffix = (pa.concat_arrays(x).take(order) for x in (starts, ends))
    return pc.replace_with_mask(texts, made, _joined(prefix, middle, suffix))


def restore(transformed: DataFrame) -> DataFrame:
    """Rows of `fill_in_middle` with the column `restored`: the text, rebuilt from form and output alone."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in transformed.schema) + ", restored string"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in sliced_by_bytes(batches, "output"):
            text = _restored(batch.column("form"), batch.column("output")).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], schema=schema)

    return transformed.mapInArrow(run, ddl)
