"""Fill-in-middle: texts cut in three and put together in another order, and back.

Both ways every byte is moved by a shift. A difference array holds how the shift changes where a
part begins; its cumulative sum is the shift of every byte of a batch, and one scatter (or gather)
moves them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.llm.buffers import runs, strings

# Marks of the parts, all of one length: prefix, suffix, middle.
PREFIX, SUFFIX, MIDDLE = (np.frombuffer(mark, np.uint8) for mark in (b"<P>", b"<S>", b"<M>"))
MARK = 3
FORMS = np.array(["plain", "psm", "spm"])
MADE = ("n", "form", "prefix_chars", "middle_chars", "output")


def marks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where marks begin in the bytes of texts; a mark lies within one text."""
    at = np.flatnonzero((data[:-2] == PREFIX[0]) & (data[2:] == PREFIX[2])) if len(data) > 2 else np.empty(0, np.int64)
    at = at[np.isin(data[at + 1], [PREFIX[1], SUFFIX[1], MIDDLE[1]])]
    return at[at + MARK <= offsets[np.searchsorted(offsets, at, side="right")]]


def shifts(begins: np.ndarray, lands: np.ndarray, size: int) -> np.ndarray:
    """How far each of ``size`` bytes moves, for parts in order that begin and land at these places."""
    moved = (lands - begins).ravel()
    change = np.zeros(size + 1, np.int64)
    # Empty parts begin where the next one does: their changes add up to that one's.
    np.add.at(change, begins.ravel(), np.diff(moved, prepend=0))
    return np.cumsum(change[:size])


def cut(data: np.ndarray, offsets: np.ndarray, digits: np.ndarray, plain_from: int, spm_below: int):
    """(characters, form, prefix and middle characters, output bytes, output offsets) of texts.

    ``digits`` has four numbers a text: two choose the cuts, the others the form. ``form`` is a place
    in FORMS.
    """
    begin, end = offsets[:-1], offsets[1:]
    starts = (data & 0xC0) != 0x80
    starts[begin[end > begin]] = True
    character = np.append(np.flatnonzero(starts), len(data))
    first = np.searchsorted(character, offsets)
    n = np.diff(first)
    at = digits[:, :2] % (n + 1)[:, None]
    low, high = at.min(axis=1), at.max(axis=1)
    cut_1, cut_2 = character[first[:-1] + low], character[first[:-1] + high]

    marked = np.zeros(len(n), bool)
    marked[np.searchsorted(offsets, marks(data, offsets), side="right") - 1] = True
    form = np.where(digits[:, 3] % 100 < spm_below, 2, 1)
    form[(n == 0) | marked | (digits[:, 2] % 100 >= plain_from)] = 0

    prefix, middle, suffix = cut_1 - begin, cut_2 - cut_1, end - cut_2
    out = np.concatenate(([0], np.cumsum(end - begin + np.where(form > 0, 3 * MARK, 0))))
    here = out[:-1]
    psm, spm = form == 1, form == 2
    # Where the marks and, behind them, the parts land.
    mark_p = np.where(spm, here + MARK + suffix, here)
    mark_s = np.where(spm, here, here + MARK + prefix)
    mark_m = here + 2 * MARK + prefix + suffix
    lands = np.stack([mark_p, mark_m, mark_s], axis=1) + MARK
    lands[form == 0] = np.stack([here, here + prefix, here + prefix + middle], axis=1)[form == 0]
    moved = np.arange(len(data)) + shifts(np.stack([begin, cut_1, cut_2], axis=1), lands, len(data))
    output = np.empty(out[-1], np.uint8)
    output[moved] = data
    for places, mark in ((mark_p, PREFIX), (mark_s, SUFFIX), (mark_m, MIDDLE)):
        output[places[psm | spm][:, None] + np.arange(MARK)] = mark
    return n, form, low, high - low, output, out


def join(data: np.ndarray, offsets: np.ndarray, form: np.ndarray):
    """(bytes, offsets, valid) of the texts that outputs of these forms were made from.

    Not valid is what no text gives: other marks than one of each, in the form's order and the first in front.
    """
    begin, end = offsets[:-1], offsets[1:]
    at = marks(data, offsets)
    row = np.searchsorted(offsets, at, side="right") - 1
    count = np.bincount(row, minlength=len(form))
    valid = form == 0
    three = np.flatnonzero((form > 0) & (count == 3))
    places = at[np.cumsum(count)[three, None] - [3, 2, 1]].reshape(-1, 3)
    want = np.array([[PREFIX[1], SUFFIX[1], MIDDLE[1]], [SUFFIX[1], PREFIX[1], MIDDLE[1]]])[form[three] - 1]
    sound = (data[places + 1] == want).all(axis=1) & (places[:, 0] == begin[three])
    rows, places = three[sound], places[sound]
    valid[rows] = True
    out = np.concatenate(([0], np.cumsum(np.where(valid, end - begin - np.where(form > 0, 3 * MARK, 0), 0))))

    # The parts of the texts in their own order, and where the outputs have them.
    one, two, three_ = (places[:, i] for i in range(3))
    first, second, last = two - one - MARK, three_ - two - MARK, end[rows] - three_ - MARK
    is_psm = form[rows] == 1
    prefix = np.where(is_psm, first, second)
    begins = np.repeat(out[:-1, None], 3, axis=1)
    held = np.repeat(begin[:, None], 3, axis=1)
    begins[rows, 1] += prefix
    begins[rows, 2] += prefix + last
    held[rows, 0] = np.where(is_psm, one, two) + MARK
    held[rows, 1] = three_ + MARK
    held[rows, 2] = np.where(is_psm, two, one) + MARK
    # An output that is not valid gives nothing: it has no bytes, so its shift moves none.
    from_ = np.arange(out[-1]) + shifts(begins, held, out[-1])
    return data[from_], out, valid


def transform(
    docs: DataFrame, id: str = "doc_id", text: str = "text", seed: str = "1:", plain_from: int = 90, spm_below: int = 20
) -> DataFrame:
    """The documents with ``n`` (code points), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``,
    in place of columns so called.

    The first 32 digits of the SHA-256 of ``seed`` and the id give four numbers: two cut the text, anywhere
    from its beginning to its end; a text is plain if the third, in hundredths, is ``plain_from`` or more; the
    fourth, below ``spm_below``, puts the suffix first (spm), else the prefix (psm). Texts that are empty or
    hold a mark are plain too. The output of a plain text is the text, and it has no prefix and middle (null).

    A null text is an empty one, a null id an empty one. Rows equal in id and text come out alike, for each
    row. No row depends on another and nothing is shuffled. An empty table gives an empty table.
    """
    kept = [c for c in docs.columns if c not in MADE]
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(f"`{id}`").cast("string"), F.lit(""))).cast("binary"), 256)
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.unhex(F.substring(digest, 1, 32)).alias("digits"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    schema = base.select("row").schema
    for name, kind in zip(MADE, ("long", "string", "long", "long", "string")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digits = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(-1, 4).astype(np.int64)
            for first, beyond, data, offsets in runs(batch.column(2)):
                n, form, prefix, middle, out, out_offsets = cut(data, offsets, digits[first:beyond], plain_from, spm_below)
                none = form == 0
                columns = [
                    batch.column(0).slice(first, beyond - first), pa.array(n), pa.array(FORMS[form], pa.string()),
                    pa.array(prefix, mask=none), pa.array(middle, mask=none), strings(out, out_offsets),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return base.mapInArrow(run, schema).select("row.*", *MADE)


def restore(outputs: DataFrame, form: str = "form", output: str = "output") -> DataFrame:
    """The rows with ``restored``, the text that the output and its form were made from, in place of a column
    so called.

    Null where there is none: a null output or form, another form than the three, or an output without one
    mark of each kind in its form's order.
    """
    kept = [c for c in outputs.columns if c != "restored"]
    base = outputs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.when(F.col(f"`{output}`").isNotNull(), F.array_position(F.array(*map(F.lit, FORMS.tolist())), F.col(f"`{form}`")))
        .alias("kind"),
        F.coalesce(F.col(f"`{output}`"), F.lit("")).alias("text"),
    )
    schema = base.select("row").schema.add("restored", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) - 1
            for first, beyond, data, offsets in runs(batch.column(2)):
                here = kind[first:beyond]
                out, out_offsets, valid = join(data, offsets, np.maximum(here, 0))
                texts = strings(out, out_offsets)
                if (lost := ~valid | (here < 0)).any():
                    texts = pa.array([None if gone else t for t, gone in zip(texts.to_pylist(), lost.tolist())], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, beyond - first), texts], names=schema.names)

    return base.mapInArrow(run, schema).select("row.*", "restored")
