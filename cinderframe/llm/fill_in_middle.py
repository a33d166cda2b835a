"""Fill-in-the-middle documents: both cuts are found by ranks in a wavelet matrix over character classes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cinderframe.llm.common import WHITE, pieces, text_rows
from cinderframe.llm.wavelet import WaveletMatrix

#: Classes of UTF-8 bytes: a later byte of a code point, a line feed, other white space, the first code point of a word, another one.
TAIL, FEED, BLANK, FIRST, OTHER = range(5)
CLASS_BITS = 3
#: For each unit the classes whose ranks add up to its boundaries, and whether a boundary stands behind its byte.
UNITS = {"char": ((FEED, BLANK, FIRST, OTHER), False), "word": ((FIRST,), False), "line": ((FEED,), True)}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[0x80:0xC0] = TAIL
_CLASS[[ord(c) for c in WHITE]] = BLANK
_CLASS[ord("\n")] = FEED


def classes_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The class of every byte of a piece; a document's first word starts anew."""
    found = _CLASS[data]
    fresh = np.ones(len(data) + 1, bool)
    fresh[1:] = (found == BLANK) | (found == FEED)
    fresh[offsets] = True
    found[(found == OTHER) & fresh[:-1]] = FIRST
    return found


class Cutter:
    """Counts and places of unit boundaries in the documents of a piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.matrix = WaveletMatrix(classes_of(data, offsets), CLASS_BITS)
        self.data, self.starts, self.ends = data, offsets[:-1], offsets[1:]

    def boundaries(self, unit: str, places: np.ndarray) -> np.ndarray:
        """Boundaries in front of byte places of the piece."""
        return sum(self.matrix.rank(symbol, places) for symbol in UNITS[unit][0])

    def counts(self, unit: str) -> np.ndarray:
        """Units of each document. Text behind the last line feed is a line; an empty text has no unit."""
        count = self.boundaries(unit, self.ends) - self.boundaries(unit, self.starts)
        if UNITS[unit][1] and len(self.data):
            count += (self.ends > self.starts) & (self.data[np.maximum(self.ends - 1, 0)] != ord("\n"))
        return count

    def places(self, unit: str, units: np.ndarray) -> np.ndarray:
        """The byte place behind the first `units` units of each document: 0 units end at its start, all units at its end.

        Bisection for the byte in front of which `units` boundaries stand (behind which, where boundaries follow their byte).
        """
        behind = UNITS[unit][1]
        wanted = self.boundaries(unit, self.starts) + units + (0 if behind else 1)
        low, high = self.starts.copy(), self.ends.copy()  # the least place with `wanted` boundaries in front of it
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            enough = self.boundaries(unit, middle) >= wanted
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        found = low if behind else low - 1
        return np.where(units <= 0, self.starts, np.where(units >= self.counts(unit), self.ends, found))


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", seed: str = "1", rate: int = 90, spm: int = 20
) -> DataFrame:
    """id, n (units), form, prefix_chars, middle_chars and the rearranged text as `output`; one row for each row, no shuffle.

    The first four 8-digit groups of the hex sha256 of `seed`:id draw both cuts among 0..n units, whether the text is
    rearranged (`rate` in 100), and whether the suffix leads (`spm` in 100 of those). Form `psm` is <P>prefix<S>suffix<M>middle, `spm` is
    <S>suffix<P>prefix<M>middle; an empty text, or one that holds a sentinel, is `plain` and stays as it is.

    Units are code points, words (each with the white space behind it; white space in front of all words goes with the first) or lines
    (each with its line feed). A null text is empty; a null id is hashed as the empty string; rows that repeat an id are cut alike if their texts are
    equal. An empty table gives an empty result, and other columns are left behind. Work and memory are bounded by a piece of text.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {sorted(UNITS)}")
    rows = text_rows(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    held = [F.col("text").contains(mark) for mark in (PREFIX, SUFFIX, MIDDLE)]
    plain = (F.col("text") == "") | held[0] | held[1] | held[2] | (drawn[2] % 100 >= rate)
    form = F.when(plain, "plain").when(drawn[3] % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("id", form.alias("form"), drawn[0].alias("h1"), drawn[1].alias("h2"), "text")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column(4)):
                part = batch.slice(i, j - i)
                cutter = Cutter(data, offsets)
                n = cutter.counts(unit)
                draws = [np.asarray(part.column(c).to_numpy(zero_copy_only=False), np.int64) % (n + 1) for c in (2, 3)]
                ends = [cutter.places(unit, draw(*draws)) for draw in (np.minimum, np.maximum)]
                chars = [cutter.boundaries("char", place) for place in (cutter.starts, *ends)]
                forms, outputs = part.column(1).to_pylist(), []
                for form_, a, b, c, d in zip(forms, cutter.starts.tolist(), *[e.tolist() for e in ends], cutter.ends.tolist()):
                    prefix, middle, suffix = (data[x:y].tobytes() for x, y in ((a, b), (b, c), (c, d)))
                    if form_ == "psm":
                        outputs.append(b"".join((b"<P>", prefix, b"<S>", suffix, b"<M>", middle)))
                    elif form_ == "spm":
                        outputs.append(b"".join((b"<S>", suffix, b"<P>", prefix, b"<M>", middle)))
                    else:
                        outputs.append(data[a:d].tobytes())
                untouched = np.array([f == "plain" for f in forms], bool)
                sizes = [pa.array(y - x, pa.int64(), mask=untouched) for x, y in zip(chars, chars[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), part.column(1), *sizes, pa.array(outputs, pa.binary()).cast(pa.string())],
                    ["id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return rows.mapInArrow(cut, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that `output` was made from. A rearranged text holds no sentinel, so the three that it got split it into its parts."""
    parts = F.split(output, "<[PSM]>", -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
