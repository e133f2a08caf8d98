"""The residue alphabet, the substitution matrix and the gap costs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Residues in code order 0 to 23; any other character counts as the last.
ALPHABET = "ARNDCQEGHILKMFPSTWYVBZX*"
UNKNOWN = 23
#: The first residue of a gap, each further one, and the longest query.
GAP_OPEN = 10
GAP_EXTEND = 1
MAX_QUERY = 8192
#: A narrow cell is redone above this.
NARROW_LIMIT = 30000

#: BLOSUM62 in its published layout, a row and a column for each residue.
BLOSUM62 = """
   A  R  N  D  C  Q  E  G  H  I  L  K  M  F  P  S  T  W  Y  V  B  Z  X  *
A  4 -1 -2 -2  0 -1 -1  0 -2 -1 -1 -1 -1 -2 -1  1  0 -3 -2  0 -2 -1  0 -4
R -1  5  0 -2 -3  1  0 -2  0 -3 -2  2 -1 -3 -2 -1 -1 -3 -2 -3 -1  0 -1 -4
N -2  0  6  1 -3  0  0  0  1 -3 -3  0 -2 -3 -2  1  0 -4 -2 -3  3  0 -1 -4
D -2 -2  1  6 -3  0  2 -1 -1 -3 -4 -1 -3 -3 -1  0 -1 -4 -3 -3  4  1 -1 -4
C  0 -3 -3 -3  9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1 -3 -3 -2 -4
Q -1  1  0  0 -3  5  2 -2  0 -3 -2  1  0 -3 -1  0 -1 -2 -1 -2  0  3 -1 -4
E -1  0  0  2 -4  2  5 -2  0 -3 -3  1 -2 -3 -1  0 -1 -3 -2 -2  1  4 -1 -4
G  0 -2  0 -1 -3 -2 -2  6 -2 -4 -4 -2 -3 -3 -2  0 -2 -2 -3 -3 -1 -2 -1 -4
H -2  0  1 -1 -3  0  0 -2  8 -3 -3 -1 -2 -1 -2 -1 -2 -2  2 -3  0  0 -1 -4
I -1 -3 -3 -3 -1 -3 -3 -4 -3  4  2 -3  1  0 -3 -2 -1 -3 -1  3 -3 -3 -1 -4
L -1 -2 -3 -4 -1 -2 -3 -4 -3  2  4 -2  2  0 -3 -2 -1 -2 -1  1 -4 -3 -1 -4
K -1  2  0 -1 -3  1  1 -2 -1 -3 -2  5 -1 -3 -1  0 -1 -3 -2 -2  0  1 -1 -4
M -1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5  0 -2 -1 -1 -1 -1  1 -3 -1 -1 -4
F -2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6 -4 -2 -2  1  3 -1 -3 -3 -1 -4
P -1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7 -1 -1 -4 -3 -2 -2 -1 -2 -4
S  1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4  1 -3 -2 -2  0  0  0 -4
T  0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5 -2 -2  0 -1 -1  0 -4
W -3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11  2 -3 -4 -3 -2 -4
Y -2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7 -1 -3 -2 -1 -4
V  0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4 -3 -2 -1 -4
B -2 -1  3  4 -3  0  1 -1  0 -3 -4  0 -3 -3 -2  0 -1 -4 -3 -3  4  1 -1 -4
Z -1  0  0  1 -3  3  4 -2  0 -3 -3  1 -1 -3 -1  0 -1 -3 -2 -2  1  4 -1 -4
X  0 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2  0  0 -2 -1 -1 -1 -1 -1 -4
* -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4  1
"""


def read_matrix(text: str, alphabet: str = ALPHABET, other: int | None = None) -> np.ndarray:
    """The scores of a matrix in the published layout (a line of letters, then a letter and its scores a line), by code.

    Letters of the alphabet that the matrix lacks are an error, or score ``other`` with all.
    """
    head, *rows = [line.split() for line in text.splitlines() if line.strip() and not line.startswith("#")]
    by_letter = {row[0]: dict(zip(head, map(int, row[1:]), strict=True)) for row in rows}
    if other is None:
        return np.array([[by_letter[a][b] for b in alphabet] for a in alphabet], np.int8)
    return np.array([[by_letter.get(a, {}).get(b, other) for b in alphabet] for a in alphabet], np.int32)


MATRIX = read_matrix(BLOSUM62)

#: bytes.translate table: byte to code.
CODES = bytearray([UNKNOWN] * 256)
for _code, _letter in enumerate(ALPHABET):
    CODES[ord(_letter)] = CODES[ord(_letter.lower())] = _code
CODES = bytes(CODES)


def encode(seq: str | bytes) -> np.ndarray:
    """Codes of a sequence; every byte that is no letter of the alphabet, in either case, is unknown."""
    raw = seq.encode() if isinstance(seq, str) else seq
    return np.frombuffer(raw.translate(CODES), np.uint8)


def encode_all(column: pa.Array) -> list[np.ndarray]:
    """Codes of every sequence of a string column without nulls: one translation of the column's bytes, cut at its offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    codes = np.frombuffer((data.to_pybytes() if data is not None else b"")[offsets[0] : offsets[-1]].translate(CODES), np.uint8)
    at = (offsets - offsets[0]).tolist()
    return [codes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def encode_column(seq: Column) -> Column:
    """The codes of a sequence as array<tinyint>, by characters; equal to ``encode`` on ASCII.

    An explicit two-case alphabet: upper() would map some letters outside ASCII into it.
    """
    both = F.lit(ALPHABET + ALPHABET[:23].lower())
    position = lambda c: F.instr(both, c)
    code = lambda c: F.when(position(c) == 0, UNKNOWN).otherwise(F.pmod(position(c) - 1, F.lit(24))).cast("tinyint")
    return F.when(F.length(seq) == 0, F.array().cast("array<tinyint>")).otherwise(F.transform(F.split(seq, ""), code))


def matrix_rows(spark: SparkSession) -> DataFrame:
    """The matrix as 576 rows (a, b, s)."""
    rows = [(a, b, int(MATRIX[a, b])) for a in range(24) for b in range(24)]
    return spark.createDataFrame(rows, "a int, b int, s int")


def substitution(a: Column, b: Column) -> Column:
    """The score of two codes by array lookup: no join."""
    flat = F.array(*(F.lit(int(v)) for v in MATRIX.ravel()))
    return F.element_at(flat, a * 24 + b + 1)


def algorithm_name(algorithm: str) -> str:
    if algorithm not in ("nw", "sw"):
        raise ValueError(f"algorithm is 'nw' or 'sw', not {algorithm!r}")
    return algorithm
