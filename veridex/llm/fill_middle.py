"""Fill-in-the-middle: texts cut into prefix, middle and suffix by arithmetic on whole texts as big integers.

bytes.translate marks the bytes of a class with 1, and int(..., 2) reads the marks as one integer whose leftmost
bit is the first byte. Shifted boolean operations then mark where units begin, bit_count says how many there are,
and the byte at which the unit of a rank begins is found by halving: count the bits of the left half, go on in
the half that holds the rank. No step looks at single characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from veridex.llm.common import ship, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("char", "word", "line")


def _class(members: Iterable[int]) -> bytes:
    """A table for bytes.translate that marks the bytes of a class."""
    table = bytearray(b"0" * 256)
    for b in members:
        table[b] = ord("1")
    return bytes(table)


#: Bytes that begin a code point; bytes of words; line feeds.
LEADING = _class(b for b in range(256) if b & 0xC0 != 0x80)
INSIDE = _class(b for b in range(256) if b not in b" \t\n\x0b\x0c\r")
FEED = _class(b"\n")
_BYTES = [_class([b]) for b in range(256)]


def marks(data: bytes, table: bytes) -> int:
    return int(data.translate(table), 2) if data else 0


def contains(data: bytes, found: bytes) -> bool:
    """Whether a byte string occurs: positions at which all its bytes stand, each shifted back to the first."""
    at = -1
    for shift, b in enumerate(found):
        at &= marks(data, _BYTES[b]) << shift
        if not at:
            return False
    return True


def beginnings(data: bytes, unit: str = "char") -> int:
    """The bits of the bytes at which units begin; the first unit begins at the first byte.

    char: code points. word: a word with the white space after it; white space before the first word belongs to
    it, and a text of white space is one unit. line: a line with its line feed.
    """
    if not data:
        return 0
    top = 1 << (len(data) - 1)
    if unit == "char":
        return marks(data, LEADING)
    if unit == "line":
        return marks(data, FEED) >> 1 | top
    if unit != "word":
        raise ValueError(f"unit must be one of {UNITS}, not {unit}")
    inside = marks(data, INSIDE)
    first = inside & ~(inside >> 1)
    return first ^ (1 << (first.bit_length() - 1)) | top if first else top


def places(bits: int, length: int, ranks: list[int]) -> list[int]:
    """The places, from the left, of the set bits of the given ascending ranks (from 0), among `length` bits."""
    if not ranks:
        return []
    if length <= 64:
        have = [i for i in range(length) if bits >> (length - 1 - i) & 1]
        return [have[r] for r in ranks]
    half = length // 2
    left, right = bits >> half, bits & ((1 << half) - 1)
    n = left.bit_count()
    return places(left, length - half, [r for r in ranks if r < n]) + [length - half + p for p in places(right, half, [r - n for r in ranks if r >= n])]


def draws(key: str) -> list[int]:
    """Four numbers of 32 bits that the key decides."""
    h = hashlib.sha256(key.encode()).digest()
    return [int.from_bytes(h[k : k + 4], "big") for k in (0, 4, 8, 12)]


def arranged(text: str, key: str, percent: int = 90, suffix_first: int = 20, unit: str = "char") -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, units of the prefix and of the middle, and the output."""
    data = text.encode()
    bits = beginnings(data, unit)
    n = bits.bit_count()
    a, b, chance, side = draws(key)
    if not n or chance % 100 >= percent or any(contains(data, m.encode()) for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, last = sorted((a % (n + 1), b % (n + 1)))
    cuts = places(bits, len(data), [r for r in (first, last) if r < n])
    cuts += [len(data)] * (2 - len(cuts))
    prefix, middle, suffix = (x.decode() for x in (data[: cuts[0]], data[cuts[0] : cuts[1]], data[cuts[1] :]))
    if side % 100 < suffix_first:
        return n, "spm", first, last - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, last - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_middle(docs: DataFrame, seed: str = "1", percent: int = 90, suffix_first: int = 20, unit: str = "char") -> DataFrame:
    """docs (doc_id, text, ...) with output instead of text, and n (units), form, prefix_<unit>s, middle_<unit>s.

    One row per row. The draws of a row depend on the seed and its doc_id alone, so rows of equal ids and texts are
    equal. A null text is empty, a null id reads as empty. Empty texts, texts that hold a mark, and those beyond
    `percent` stay plain, with null counts. restored() gives the text back. Columns of docs named like the new ones
    are replaced, others stay.
    """
    ship(docs.sparkSession)
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}, not {unit}")
    new = {"n": LongType(), "form": StringType(), f"prefix_{unit}s": LongType(), f"middle_{unit}s": LongType(), "output": StringType()}
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new])
    stays = [f for f in docs.schema.fields if f.name.lower() != "text"]
    names = [f.name for f in stays]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            ids = b.column("doc_id").cast(pa.string()).to_pylist()
            done = [arranged(t or "", f"{seed}:{'' if i is None else i}", percent, suffix_first, unit) for i, t in zip(ids, b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(c, t) for c, t in zip(zip(*done), types)], names=names + list(new))

    return docs.mapInArrow(run, StructType(stays + [StructField(k, t) for k, t in new.items()]))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: what stands between its marks, in the first order."""
    after, upto = lambda mark: F.substring_index(output, mark, -1), lambda c, mark: F.substring_index(c, mark, 1)
    prefix, suffix = upto(upto(after(PREFIX), SUFFIX), MIDDLE), upto(upto(after(SUFFIX), PREFIX), MIDDLE)
    return F.when(form == "plain", output).otherwise(F.concat(prefix, after(MIDDLE), suffix))
