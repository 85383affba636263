"""Fill-in-the-middle text from seekable compressed frames.

A text is stored as independent zstandard frames of a fixed size, each with the number
of units and characters before it.  A unit is a run of the letters A-Z, a-z or any other
single character.  To cut a text after so many units, only the frame with the cut is
opened.  The output is a list of frames again: whole frames are taken over as they are,
a frame with a cut becomes two, and the marks are frames of their own.  Frames one after
the other are a valid zstandard stream, so digests and the text itself are read frame by
frame and no text is ever put together in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelens.llm import arrays

#: Bytes of text in a frame.
FRAME = 1 << 16
#: Bytes of text, or packed bytes, handled at a time.
STEP = 1 << 22
#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Fixed value: a unit.
UNIT = "[A-Za-z]+|[^A-Za-z]"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True

_FRAME_TYPE = pa.struct(
    [("unit", pa.int64()), ("char", pa.int64()), ("inside", pa.bool_()), ("data", pa.binary())]
)
_STORE_TYPE = pa.struct(
    [("n", pa.int64()), ("chars", pa.int64()), ("reserved", pa.bool_()), ("frames", pa.list_(_FRAME_TYPE))]
)
_STORE = "n long, chars long, reserved boolean, frames array<struct<unit long, char long, inside boolean, data binary>>"
_CUT_TYPE = pa.struct(
    [("output", pa.list_(pa.binary())), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
)


def pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpack(frame: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(frame)


def unit_starts(data: np.ndarray, inside: bool) -> np.ndarray:
    """Whether a unit starts at each byte; ``inside``: a letter stands right before."""
    letter = _LETTER[data]
    start = (data & 0xC0) != 0x80
    start[1:] &= ~(letter[1:] & letter[:-1])
    if inside and len(data):
        start[0] &= ~letter[0]
    return start


def stored(text: bytes, size: int = FRAME) -> dict:
    """The frames of one text, cut between characters, with what stands before each."""
    frames, at, units, chars = [], 0, 0, 0
    while at < len(text):
        stop = min(at + size, len(text))
        while stop < len(text) and text[stop] & 0xC0 == 0x80:
            stop += 1
        data = np.frombuffer(text, np.uint8, stop - at, at)
        inside = bool(at and _LETTER[text[at - 1]])
        frames.append({"unit": units, "char": chars, "inside": inside, "data": pack(text[at:stop])})
        units += int(unit_starts(data, inside).sum())
        chars += int(((data & 0xC0) != 0x80).sum())
        at = stop
    marks = (PREFIX, SUFFIX, MIDDLE)
    return {"n": units, "chars": chars, "reserved": any(m.encode() in text for m in marks), "frames": frames}


class Frames:
    """Ranges of units of one stored text; opens only the frames that a range cuts."""

    def __init__(self, n: int, chars: int, frames: list[dict]):
        self.n, self.chars, self._frames = n, chars, frames
        self._first = np.array([f["unit"] for f in frames], np.int64)
        self._open: dict[int, bytes] = {}

    def place(self, unit: int) -> tuple[int, int, int]:
        """Frame, byte in it and character of the text where a unit starts; ``n`` is the end."""
        if unit >= self.n:
            return len(self._frames), 0, self.chars
        if unit == 0:
            return 0, 0, 0
        # of frames that start with the same unit count, the last one holds the unit's start
        k = int(np.searchsorted(self._first, unit, "right")) - 1
        frame = self._frames[k]
        data = np.frombuffer(self._opened(k), np.uint8)
        byte = int(np.flatnonzero(unit_starts(data, frame["inside"]))[unit - frame["unit"]])
        return k, byte, frame["char"] + int(((data[:byte] & 0xC0) != 0x80).sum())

    def _opened(self, k: int) -> bytes:
        """Text of a frame; the last two, those of the two cuts, stay open."""
        if k not in self._open:
            if len(self._open) == 2:
                self._open.pop(next(iter(self._open)))
            self._open[k] = unpack(self._frames[k]["data"])
        return self._open[k]

    def between(self, begin: tuple[int, int, int], end: tuple[int, int, int]) -> Iterator[bytes]:
        """Frames that hold exactly the text between two places."""
        for k in range(begin[0], min(end[0] + 1, len(self._frames))):
            low = begin[1] if k == begin[0] else 0
            if k == end[0]:
                if end[1] > low:
                    yield pack(self._opened(k)[low : end[1]])
            elif low:
                yield pack(self._opened(k)[low:])
            else:
                yield self._frames[k]["data"]


def rearranged(row: dict, form: str, first: int, second: int) -> dict:
    """Output frames of one stored text cut after ``first`` and ``second`` units."""
    frames = row["frames"] or []
    if form == "plain":
        return {"output": [f["data"] for f in frames], "prefix_chars": None, "middle_chars": None}
    text = Frames(row["n"], row["chars"], frames)
    start, end = text.place(0), text.place(row["n"])
    a, b = text.place(first), text.place(second)
    parts = {PREFIX: (start, a), MIDDLE: (a, b), SUFFIX: (b, end)}
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    output = []
    for mark in order:
        output.append(pack(mark.encode()))
        output += text.between(*parts[mark])
    return {"output": output, "prefix_chars": a[2], "middle_chars": b[2] - a[2]}


def _found(output: list[bytes], marks: list[bytes]) -> dict[bytes, int]:
    """Byte of the stream at which each mark stands first, by one pass over the frames."""
    at, tail, places = 0, b"", {}
    for frame in output:
        data = tail + unpack(frame)
        for mark in marks:
            if mark not in places and (k := data.find(mark)) >= 0:
                places[mark] = at - len(tail) + k
        at += len(data) - len(tail)
        tail = data[-2:]
    return places


def _slice(output: list[bytes], begin: int, end: int) -> Iterator[bytes]:
    """Bytes [begin, end) of the stream, frame by frame."""
    at = 0
    for frame in output:
        size = zstandard.frame_content_size(frame)
        if at < end and at + size > begin:
            data = unpack(frame)
            yield data[max(0, begin - at) : max(0, end - at)]
        at += size


def original(output: list[bytes], form: str) -> Iterator[bytes]:
    """The text before the transformation, in pieces, from output and form alone."""
    if form == "plain":
        yield from map(unpack, output)
        return
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    marks = [m.encode() for m in order]
    places = _found(output, marks)
    size = sum(map(zstandard.frame_content_size, output))
    begin = {m: places[m.encode()] + len(m) for m in order}
    end = dict(zip(order, [*(places[m] for m in marks[1:]), size]))
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from _slice(output, begin[mark], end[mark])


# -- Spark -----------------------------------------------------------------------


def store(docs: DataFrame, frame: int = FRAME) -> DataFrame:
    """``docs`` with ``text`` replaced by ``n``, ``chars``, ``reserved`` and ``frames``.

    ``n`` counts units, ``reserved`` tells that the text holds a mark.  Null text is
    stored like empty text: no frames.  Columns of ``docs`` with these names are replaced;
    rows are handled one by one, so repeated rows and null ids stay as they are.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in arrays.steps(batch, STEP):
                yield pa.array([stored((t.as_py() or "").encode(), frame) for t in part], _STORE_TYPE)

    new = ("text", "n", "chars", "reserved", "frames")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    return docs.select(*rest, F.arrow_udf(run, _STORE)(F.col("text")).alias("_stored")).select(*rest, "_stored.*")


def transform(kept: DataFrame, form: Column, first: Column, second: Column) -> DataFrame:
    """A store with ``form``, ``output`` (frames), ``prefix_chars`` and ``middle_chars``.

    The text is cut after ``first`` and after ``second`` units, where
    0 <= first <= second <= n.  ``form`` is ``psm`` (prefix, suffix, middle), ``spm``
    (suffix, prefix, middle) or ``plain``; a null form counts as plain.  A text that is
    empty or holds a mark is plain whatever is asked, since it could not be put together
    again.  Plain texts have null counts.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out, held = [], 0
            for row in batch:  # one text at a time: no batch of opened frames is ever held
                out.append(_rearranged(row.as_py()))
                held += sum(map(len, out[-1]["output"]))
                if held >= STEP:
                    yield pa.array(out, _CUT_TYPE)
                    out, held = [], 0
            yield pa.array(out, _CUT_TYPE)

    safe = F.when((F.col("n") == 0) | F.col("reserved"), "plain").otherwise(F.coalesce(form, F.lit("plain")))
    rows = kept.withColumn("form", safe)
    own = ("form", "output", "prefix_chars", "middle_chars", "frames")
    rest = [F.col(f"`{c}`") for c in kept.columns if c not in own]
    given = F.struct(
        F.col("n"), F.col("chars"), F.col("frames"), F.col("form"),
        first.cast("long").alias("first"), second.cast("long").alias("second"),
    )
    cut = F.arrow_udf(run, "output array<binary>, prefix_chars long, middle_chars long")
    return rows.select(*rest, "form", cut(given).alias("_cut")).select(*rest, "form", "_cut.*")


def _rearranged(row: dict) -> dict:
    return rearranged(row, row["form"], row["first"], row["second"])


def _streamed(output: Column, form: Column, kind: str, work: Callable) -> Column:
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for outputs, forms in batches:
            yield pa.array([work(o.as_py() or [], f.as_py()) for o, f in zip(outputs, forms)], _arrow(kind))

    return F.arrow_udf(run, kind)(output, form)


def _arrow(kind: str) -> pa.DataType:
    if kind == "string":
        return pa.string()
    return pa.struct([(f.split()[0], pa.string()) for f in kind.split(", ")])


def _digest(pieces: Iterator[bytes]) -> str:
    done = hashlib.sha256()
    for piece in pieces:
        done.update(piece)
    return done.hexdigest()


def digests(output: Column, form: Column) -> Column:
    """struct<output_sha256, restored_sha256>: of the output, and of the text rebuilt from it."""

    def work(frames: list[bytes], kind: str) -> dict:
        return {"output_sha256": _digest(map(unpack, frames)), "restored_sha256": _digest(original(frames, kind))}

    return _streamed(output, form, "output_sha256 string, restored_sha256 string", work)


def text_of(output: Column, form: Column) -> Column:
    """The transformed text itself, for writers that want it whole."""
    return _streamed(output, form, "string", lambda frames, _: b"".join(map(unpack, frames)).decode())


def restored(output: Column, form: Column) -> Column:
    """The original text, from output and form."""
    return _streamed(output, form, "string", lambda frames, kind: b"".join(original(frames, kind)).decode())


def units(kept: DataFrame, begin: Column, end: Column) -> Column:
    """Text of units [begin, end) of a stored text; frames outside the range stay closed."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text = Frames(row["n"], row["chars"], row["frames"] or [])
                low = max(0, min(row["begin"], row["n"]))
                high = max(low, min(row["end"], row["n"]))
                parts = text.between(text.place(low), text.place(high))
                out.append(b"".join(map(unpack, parts)).decode())
            yield pa.array(out, pa.string())

    given = F.struct(
        kept["n"], kept["chars"], kept["frames"],
        begin.cast("long").alias("begin"), end.cast("long").alias("end"),
    )
    return F.arrow_udf(run, "string")(given)


def drawn(doc_id: Column, n: Column) -> tuple[Column, Column, Column]:
    """(form, first, second) by the digest of the id; a null id counts as the empty text.

    The cuts fall after h1 and h2 modulo n + 1 units; nine of ten texts are transformed,
    a fifth of these suffix first.
    """
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    form = F.when(h[2] % 100 >= 90, "plain").when(h[3] % 100 < 20, "spm").otherwise("psm")
    return form, F.least(a, b), F.greatest(a, b)


#: The query in SQL.
DRAWN_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || CAST(doc_id AS VARCHAR)) AS x
  FROM documents
),
h AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
         CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4
  FROM d
),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
),
p AS (
  SELECT *, coalesce(array_to_string(list_slice(u, 1, a), ''), '') AS pre,
         coalesce(array_to_string(list_slice(u, a + 1, b), ''), '') AS mid,
         coalesce(array_to_string(list_slice(u, b + 1, n), ''), '') AS suf
  FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
