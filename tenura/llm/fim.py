"""Fill-in-middle: texts cut at two token borders and put in another order, with a sparse index between bytes and code points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import SPACE, by_value, slices

by_value(__name__)

#: Marks of the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
FIELDS = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("prefix_bytes", pa.int64()), ("middle_bytes", pa.int64()), ("output", pa.string())]
KIND = pa.struct(FIELDS)
SCHEMA = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,prefix_bytes:bigint,middle_bytes:bigint,output:string>"


class Exceptions:
    """The multibyte characters of a UTF-8 text: their byte positions and the bytes they have beyond one, summed up.

    Nothing is kept for ASCII: between two exceptions byte and code-point positions differ by a constant. A text of only
    ASCII has an empty index.
    """

    def __init__(self, data: np.ndarray):
        high = np.flatnonzero(data >= 0xC0)  # first bytes of characters of two bytes and more
        lead = data[high]
        self.at = high
        self.excess = np.concatenate(([0], np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))))
        self.char = high - self.excess[:-1]  # code points before each exception

    def chars(self, cuts: np.ndarray) -> np.ndarray:
        """Code points before each byte cut (cuts lie between characters)."""
        return cuts - self.excess[np.searchsorted(self.at, cuts, side="left")]

    def bytes(self, cuts: np.ndarray) -> np.ndarray:
        """Bytes before each code-point cut."""
        return cuts + self.excess[np.searchsorted(self.char, cuts, side="left")]


def token_ends(data: np.ndarray) -> np.ndarray:
    """Byte ends of the tokens ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``: of each word, and of white space at the end."""
    if not len(data):
        return np.empty(0, np.int64)
    white = SPACE[data]
    ends = np.flatnonzero(~white[:-1] & white[1:]) + 1
    return np.concatenate((ends, [len(data)]))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, marks: tuple[str, str, str] = MARKS, out: str = "fim") -> DataFrame:
    """``docs`` with a struct ``out``: n, form, prefix_chars, middle_chars, prefix_bytes, middle_bytes, output.

    A text has n tokens: words with the white space before them, and white space at its end. Numbers h1 to h4 are the first
    four groups of 8 digits of the SHA-256 of ``seed:id``. The prefix ends after the smaller of h1 % (n + 1) and
    h2 % (n + 1) tokens, the middle after the larger. Of 100 texts ``rate`` are moved, ``spm`` of 100 of these in the order
    suffix, prefix, middle, the others prefix, suffix, middle; the rest is plain. Empty and null texts and texts that hold
    a mark are always plain. Plain texts have null cuts and themselves as output; a null text counts as empty, a
    null id as an empty one. Repeated rows come out alike and stay. A column named ``out`` is replaced, all others stay.
    An empty table gives no rows.

    Texts stay in their rows: nothing is shuffled, and a worker holds one slice of bounded size (or one text) at a time.
    """
    from pyspark.sql.functions import arrow_udf

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    moved = h[2] % 100 < rate
    form = F.when(moved, F.when(h[3] % 100 < spm, F.lit("spm")).otherwise(F.lit("psm"))).otherwise(F.lit("plain"))
    p, s, m = (x.encode() for x in marks)

    def one(raw: pa.Buffer | None, form: str, h1: int, h2: int) -> tuple:
        text = b"" if raw is None else raw.to_pybytes()
        data = np.frombuffer(text, np.uint8)
        ends = token_ends(data)
        n = len(ends)
        if form == "plain" or not text or any(x in text for x in (p, s, m)):
            return n, "plain", None, None, None, None, text
        units = np.sort([h1 % (n + 1), h2 % (n + 1)])
        cuts = np.concatenate(([0], ends))[units]
        chars = Exceptions(data).chars(cuts)
        a, b = (int(x) for x in cuts)
        pre, mid, suf = text[:a], text[a:b], text[b:]
        output = b"".join((s, suf, p, pre, m, mid) if form == "spm" else (p, pre, s, suf, m, mid))
        return n, form, int(chars[0]), int(chars[1] - chars[0]), a, b - a, output

    def run(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for text, form, h1, h2 in columns:
            done = []
            for part in slices(pa.RecordBatch.from_arrays([text.cast(pa.large_binary()), form, h1, h2], ["text", "form", "h1", "h2"]), "text"):
                got = [one(t.as_buffer(), f.as_py(), a.as_py(), b.as_py()) for t, f, a, b in zip(*part.columns)]
                arrays = [pa.array([None if x is None else x.decode() if isinstance(x, bytes) else x for x in column], kind) for column, (_, kind) in zip(zip(*got), FIELDS)]
                done.append(pa.StructArray.from_arrays(arrays, [name for name, _ in FIELDS]))
            yield pa.concat_arrays(done) if done else pa.array([], KIND)

    return docs.withColumn(out, arrow_udf(run, SCHEMA)(F.col(text_col).cast("string"), form, h[0], h[1]))


def restore(form: Column, output: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from a form and an output: the parts between the marks, put back in order.

    The parts hold no mark, and no mark can overlap another, so a cut at the marks finds the parts again.
    """
    parts = F.split(output, "|".join(f"\\Q{x}\\E" for x in marks), -1)
    prefix, suffix = (F.when(form == "spm", parts[i]).otherwise(parts[j]) for i, j in ((2, 1), (1, 2)))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, parts[3], suffix))
