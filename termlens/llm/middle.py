"""Fill-in-the-middle rearrangement of texts by displacement scatter.

A text is cut into a prefix, a middle and a suffix at two token borders that a hash of
its doc_id draws, and is written as ``<P>prefix<S>suffix<M>middle`` (psm) or
``<S>suffix<P>prefix<M>middle`` (spm); the other texts stay plain. All texts of an Arrow
batch are moved at once: the cuts are found by one scan of the batch's bytes, every segment
has one displacement, the changes of displacement are put into a difference array at the
segments' first bytes, its running sum is every byte's displacement, and one scatter writes
the outputs. The way back finds the marks in the output and gathers each byte from its
displaced place.

A token is white space followed by a word, or white space that ends the text; white
space is ASCII, so cuts in bytes never split a code point.

Bounded memory: a batch is handled in pieces of 4 MB of text (a longer text alone), and displacements exist
for a window of ``WINDOW`` bytes only, whatever the length of a text.

Defined results: a null text is an empty one, which is plain; a null doc_id is drawn like the word "null"; rows that
repeat a doc_id get the same draws; an empty table gives an empty one. Columns other than doc_id
and text are not looked at, unless named in ``keep``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.llm.batches import pieces

SEED = "42"
#: Percent of texts that are rearranged, and percent of those that are spm.
RATE, SPM_RATE = 50, 80
#: Bytes whose displacements are held at once.
WINDOW = 1 << 20

PLAIN, PSM, SPM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"])
PREFIX_MARK, SUFFIX_MARK, MIDDLE_MARK = b"<P>", b"<S>", b"<M>"
#: Order in which the segments (0 prefix, 1 middle, 2 suffix) stand in the output, with the mark before each.
_LAYOUTS = {PSM: ((PREFIX_MARK, 0), (SUFFIX_MARK, 2), (MIDDLE_MARK, 1)), SPM: ((SUFFIX_MARK, 2), (PREFIX_MARK, 0), (MIDDLE_MARK, 1))}


# ------------------------------------------------------------------ displacements


def displacements(starts: np.ndarray, shifts: np.ndarray, total: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each window of ``total`` bytes its begin and, for every byte, where the byte goes or comes from.

    ``starts`` are the ascending first bytes of the segments and ``shifts`` their displacements. Of
    segments that start together all but the last are empty.
    """
    changes = np.diff(shifts, prepend=0)
    carried = 0
    for begin in range(0, total, WINDOW):
        size = min(WINDOW, total - begin)
        first, last = np.searchsorted(starts, [begin, begin + size])
        steps = np.zeros(size, np.int64)
        np.add.at(steps, starts[first:last] - begin, changes[first:last])
        steps[0] += carried
        shift = np.cumsum(steps)
        carried = int(shift[-1])
        yield begin, np.arange(begin, begin + size) + shift


def scatter(data: np.ndarray, starts: np.ndarray, shifts: np.ndarray, size: int) -> np.ndarray:
    """``size`` bytes into which every byte of ``data`` was moved by its segment's displacement."""
    moved = np.zeros(size, np.uint8)
    for begin, places in displacements(starts, shifts, len(data)):
        moved[places] = data[begin : begin + len(places)]
    return moved


def gather(data: np.ndarray, starts: np.ndarray, shifts: np.ndarray, size: int) -> np.ndarray:
    """``size`` bytes, each taken from ``data`` at its segment's displacement."""
    taken = np.empty(size, np.uint8)
    for begin, places in displacements(starts, shifts, size):
        taken[begin : begin + len(places)] = data[places]
    return taken


# ------------------------------------------------------------------------- scans


def token_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The byte after each token, ascending, of all texts; text i is ``data[offsets[i]:offsets[i + 1]]``."""
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    ending = np.zeros(len(data), bool)
    ending[:-1] = ~space[:-1] & space[1:]
    ending[offsets[1:][np.diff(offsets) > 0] - 1] = True
    return np.flatnonzero(ending) + 1


def marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all marks, ascending, and the texts that hold them."""
    open_at = np.flatnonzero(data[:-2] == ord("<")) if len(data) > 2 else np.zeros(0, np.int64)
    letters = np.frombuffer(PREFIX_MARK[1:2] + SUFFIX_MARK[1:2] + MIDDLE_MARK[1:2], np.uint8)
    found = open_at[np.isin(data[open_at + 1], letters) & (data[open_at + 2] == ord(">"))]
    owner = np.searchsorted(offsets, found, side="right") - 1
    inside = found + 3 <= offsets[owner + 1]
    return found[inside], owner[inside]


def _code_points(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Code points of the segments between neighbours of the ascending ``bounds``."""
    leading = (data & 0xC0) != 0x80
    counts = np.zeros(len(bounds) - 1, np.int64)
    filled = np.flatnonzero(np.diff(bounds) > 0)
    if len(filled):
        # bytes behind the last bound, if any, belong to no segment
        counts[filled] = np.add.reduceat(leading[: bounds[-1]], bounds[filled], dtype=np.int64)
    return counts


def draws(doc_ids: list[int | None], seed: str = SEED) -> np.ndarray:
    """Four unsigned 32-bit numbers for each id: the head of the SHA-256 of ``seed:id``."""
    heads = [hashlib.sha256(f"{seed}:{'null' if d is None else d}".encode()).digest()[:16] for d in doc_ids]
    return np.frombuffer(b"".join(heads), ">u4").reshape(-1, 4).astype(np.int64)


# ------------------------------------------------------------- texts of one piece


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column's texts one behind the other, and their offsets."""
    filled = column.cast(pa.binary()).fill_null(b"")
    offsets = np.frombuffer(filled.buffers()[1], np.int32)[filled.offset : filled.offset + len(filled) + 1].astype(np.int64)
    held = filled.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def _segments(bounds: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and displacements of segments that begin at ``bounds`` and go to ``targets``, in order of the starts."""
    return bounds.ravel(), (targets - bounds).ravel()


def rearrange(data: np.ndarray, offsets: np.ndarray, drawn: np.ndarray, rate: int, spm_rate: int) -> dict[str, np.ndarray]:
    """n, form, prefix and middle code points, and the outputs (bytes, offsets) of the texts of one piece."""
    begins, ends = offsets[:-1], offsets[1:]
    tokens = token_ends(data, offsets)
    first = np.searchsorted(tokens, begins, side="right")
    n = np.searchsorted(tokens, ends, side="right") - first

    def after(count: np.ndarray) -> np.ndarray:
        """The byte after that many tokens of each text."""
        return np.where(count > 0, np.append(tokens, 0)[np.maximum(first + count - 1, 0)], begins)

    one, two = drawn[:, 0] % (n + 1), drawn[:, 1] % (n + 1)
    bounds = np.stack([begins, after(np.minimum(one, two)), after(np.maximum(one, two))], axis=1)
    form = np.where(drawn[:, 2] % 100 >= rate, PLAIN, np.where(drawn[:, 3] % 100 < spm_rate, SPM, PSM))
    form[marks(data, offsets)[1]] = PLAIN
    form[begins == ends] = PLAIN

    marked = form != PLAIN
    out = np.concatenate(([0], np.cumsum(ends - begins + 9 * marked)))
    lengths = np.diff(np.concatenate([bounds, ends[:, None]], axis=1), axis=1)
    # a plain text moves as a whole: its segments keep their distances
    targets = bounds + (out[:-1] - begins)[:, None]
    places = []
    for kind, layout in _LAYOUTS.items():
        rows = np.flatnonzero(form == kind)
        at = out[:-1][rows]
        for mark, segment in layout:
            places.append((at, mark))
            targets[rows, segment] = at + 3
            at = at + 3 + lengths[rows, segment]
    moved = scatter(data, *_segments(bounds, targets), int(out[-1]))
    for at, mark in places:
        for step, byte in enumerate(mark):
            moved[at + step] = byte
    chars = _code_points(data, np.append(bounds.ravel(), offsets[-1])).reshape(-1, 3)
    return {"n": n, "form": form, "chars": chars, "data": moved, "offsets": out}


def rebuild(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts (bytes, offsets) that ``rearrange`` was given, from the outputs and forms alone."""
    begins, ends = offsets[:-1], offsets[1:]
    back = np.concatenate(([0], np.cumsum(ends - begins - 9 * (form != PLAIN))))
    places, owner = marks(data, offsets)
    kept = form[owner] != PLAIN
    cuts = places[kept].reshape(-1, 3)
    row_of = owner[kept].reshape(-1, 3)[:, 0]
    # where prefix, middle and suffix begin in the output, and their lengths
    sources = np.repeat(begins[:, None], 3, axis=1)
    lengths = np.zeros((len(form), 3), np.int64)
    lengths[:, 0] = ends - begins
    for kind, layout in _LAYOUTS.items():
        chosen = form[row_of] == kind
        rows, at = row_of[chosen], cuts[chosen]
        stops = np.stack([at[:, 1], at[:, 2], ends[rows]], axis=1)
        for place, (_, segment) in enumerate(layout):
            sources[rows, segment] = at[:, place] + 3
            lengths[rows, segment] = stops[:, place] - at[:, place] - 3
    starts = back[:-1, None] + np.concatenate([np.zeros((len(form), 1), np.int64), np.cumsum(lengths[:, :2], axis=1)], axis=1)
    return gather(data, *_segments(starts, sources), int(back[-1])), back


# -------------------------------------------------------------------- on tables


def _kept(documents: DataFrame, keep: list[str] | None) -> tuple[list[str], str]:
    names = ["doc_id"] if keep is None else ["doc_id", *[c for c in keep if c != "doc_id"]]
    fields = documents.select(*[F.col(f"`{c}`") for c in names]).schema.fields
    return names, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)


def fill_in_middle(
    documents: DataFrame, keep: list[str] | None = None, seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE
) -> DataFrame:
    """doc_id (and ``keep``), n tokens, form, prefix_chars and middle_chars (null if plain), output."""
    names, fields = _kept(documents, keep)
    source = documents.select(*[F.col(f"`{c}`") for c in names], F.col("text").cast("binary").alias("__text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "__text"):
            data, offsets = _texts(piece.column(piece.num_columns - 1))
            found = rearrange(data, offsets, draws(piece.column(0).to_pylist(), seed), rate, spm_rate)
            plain = found["form"] == PLAIN
            columns = [
                pa.array(found["n"], pa.int64()),
                pa.array(FORMS[found["form"]].tolist(), pa.string()),
                pa.array(found["chars"][:, 0], pa.int64(), mask=plain),
                pa.array(found["chars"][:, 1], pa.int64(), mask=plain),
                _column(found["data"], found["offsets"]),
            ]
            kept = [piece.column(i) for i in range(piece.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*names, "n", "form", "prefix_chars", "middle_chars", "output"])

    return source.mapInArrow(made, f"{fields}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(rows: DataFrame) -> DataFrame:
    """``rows`` with ``restored``: the text before the rearrangement, from output and form alone."""
    names = rows.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "output"):
            data, offsets = _texts(piece.column(names.index("output")))
            codes = {name: code for code, name in enumerate(FORMS.tolist())}
            form = np.array([codes[f] for f in piece.column(names.index("form")).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*piece.columns, _column(*rebuild(data, offsets, form))], names=[*names, "restored"])

    return rows.mapInArrow(made, f"{fields}, restored string")


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, the counts, and the SHA-256 of output and restored text."""
    return restore(rows).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )
