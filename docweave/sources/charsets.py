"""The character set of files that do not say theirs: a likelihood over pairs of characters.

Bytes are read in each candidate encoding. Every character falls into a class, such as
small Cyrillic letters, and a text is as likely as its sequence of classes times one character out of
each class. The likeliest reading wins; UTF-8 with its faulty bytes left out takes part, at
a price for each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Candidates where bytes are neither marked nor UTF-8 or UTF-16; of equally likely ones the first counts.
CANDIDATES = ("windows-1252", "windows-1251", "shift_jis", "gb18030", "iso-8859-1")
#: Natural logarithm of the odds that a byte is one that UTF-8 has to leave out, or that an encoding cannot read.
FAULT = -12.0

# Classes of characters: their first code points in order, and how many common characters each has.
_BLANK, _MARK, _DIGIT, _UPPER, _LOWER, _CONTROL, _SYMBOL, _HIGH, _LOW, _CYR_UPPER, _CYR_LOWER, _KANA, _HALF, _HAN, _WIDE, _OTHER = range(16)
_SIZES = np.log([3, 32, 10, 26, 26, 60, 30, 30, 30, 32, 33, 170, 63, 3500, 40, 30000])
_STARTS = [
    (0, _CONTROL), (9, _BLANK), (11, _CONTROL), (13, _BLANK), (14, _CONTROL), (32, _BLANK), (33, _MARK), (48, _DIGIT), (58, _MARK), (65, _UPPER), (91, _MARK), (97, _LOWER), (123, _MARK), (127, _CONTROL),
    (0xA0, _SYMBOL), (0xC0, _HIGH), (0xD7, _SYMBOL), (0xD8, _HIGH), (0xDF, _LOW), (0xF7, _SYMBOL), (0xF8, _LOW), (0x100, _OTHER), (0x152, _HIGH), (0x153, _LOW), (0x154, _OTHER), (0x160, _HIGH), (0x161, _LOW), (0x162, _OTHER), (0x178, _HIGH), (0x179, _OTHER),
    (0x401, _CYR_UPPER), (0x402, _OTHER), (0x410, _CYR_UPPER), (0x430, _CYR_LOWER), (0x450, _OTHER), (0x451, _CYR_LOWER), (0x452, _OTHER), (0x2013, _MARK), (0x2027, _SYMBOL), (0x20AC, _MARK), (0x20AD, _SYMBOL), (0x2200, _OTHER),
    (0x3000, _WIDE), (0x3040, _KANA), (0x3100, _OTHER), (0x4E00, _HAN), (0x9FA6, _OTHER), (0xFF00, _WIDE), (0xFF61, _HALF), (0xFFA0, _OTHER),
]
_CUTS, _CLASSES = np.array([s for s, _ in _STARTS]), np.array([c for _, c in _STARTS])


def _transitions() -> np.ndarray:
    """Logarithms of the odds that a class follows another: letters stay in their script, capitals begin words, and so on."""
    odds = np.full((16, 16), 0.002)
    often = {
        (_BLANK, _MARK, _DIGIT): ((_BLANK, 0.2), (_MARK, 0.1), (_DIGIT, 0.1), (_UPPER, 0.15), (_LOWER, 0.3), (_HIGH, 0.01), (_LOW, 0.01), (_CYR_UPPER, 0.1), (_CYR_LOWER, 0.2), (_KANA, 0.1), (_HAN, 0.1), (_WIDE, 0.02)),
        (_UPPER, _LOWER): ((_BLANK, 0.15), (_MARK, 0.05), (_LOWER, 0.7), (_UPPER, 0.05), (_LOW, 0.04), (_DIGIT, 0.01)),
        (_HIGH,): ((_LOWER, 0.6), (_BLANK, 0.1), (_MARK, 0.03), (_UPPER, 0.1)),
        (_LOW,): ((_LOWER, 0.65), (_BLANK, 0.2), (_MARK, 0.05), (_LOW, 0.01)),
        (_CYR_UPPER,): ((_CYR_LOWER, 0.75), (_CYR_UPPER, 0.1), (_BLANK, 0.1), (_MARK, 0.04)),
        (_CYR_LOWER,): ((_CYR_LOWER, 0.8), (_BLANK, 0.14), (_MARK, 0.04)),
        (_KANA,): ((_KANA, 0.6), (_HAN, 0.2), (_WIDE, 0.1), (_MARK, 0.02), (_BLANK, 0.02)),
        (_HAN,): ((_HAN, 0.6), (_KANA, 0.2), (_WIDE, 0.12), (_MARK, 0.02), (_BLANK, 0.03)),
        (_WIDE,): ((_HAN, 0.45), (_KANA, 0.3), (_BLANK, 0.05), (_WIDE, 0.05), (_DIGIT, 0.03), (_LOWER, 0.02)),
        (_HALF,): ((_HALF, 0.5), (_BLANK, 0.1)),
    }
    for rows, columns in often.items():
        for row in rows:
            for column, value in columns:
                odds[row, column] = value
    return np.log(odds / odds.sum(axis=1, keepdims=True))


_LOG_ODDS = _transitions() - _SIZES[None, :]


def likelihood(text: str) -> float:
    """The logarithm of how likely a text is, by the classes of its characters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = _CLASSES[np.searchsorted(_CUTS, points, "right") - 1]
    return float(_LOG_ODDS[np.concatenate([[_BLANK], classes[:-1]]), classes].sum()) if len(classes) else 0.0


def _marked(raw: bytes) -> str | None:
    """What a byte order mark says, or zeros in every second byte of the start."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return name
    start = raw[: min(len(raw) // 2 * 2, 64)]
    for first, name in ((1, "utf-16-le"), (0, "utf-16-be")):
        if len(start) >= 4 and not any(start[first::2]) and all(start[1 - first :: 2]):
            return name
    return None


def detect(raw: bytes) -> str:
    """The name of the encoding of some bytes: by their mark, as UTF-8 if they are that, else by likelihood."""
    if found := _marked(raw):
        return found
    try:
        raw.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        pass
    kept = raw.decode("utf-8", "ignore")
    scores = {"utf-8": likelihood(kept) + FAULT * (len(raw) - len(kept.encode()))}
    for name in CANDIDATES:
        try:
            scores[name] = likelihood(raw.decode(name))
        except UnicodeDecodeError:
            text = raw.decode(name, "replace")
            scores[name] = likelihood(text.replace("�", "")) + FAULT * text.count("�")
    return max(scores, key=scores.get)


@F.pandas_udf(StringType())
def charset(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The encoding of a column of bytes; null for null."""
    for batch in batches:
        yield batch.map(lambda raw: None if raw is None else detect(bytes(raw)))


@F.pandas_udf(StringType())
def _read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda raw: None if raw is None else bytes(raw).decode(detect(bytes(raw)), "ignore"))


def decoded(content: Column) -> Column:
    """Bytes as text in the encoding that ``detect`` finds, faulty bytes left out."""
    return _read(content)
