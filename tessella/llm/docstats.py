"""Statistics of whole documents, counted once per text and shared by the quality operators.

Null and empty texts have all counts 0.  Words are ``[^\\x20\\x09-\\x0D]+``; characters are code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessella.llm import textkit as tk

COUNTS = [
    "n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_upper", "n_lower", "n_digit", "n_stop", "n_loud", "n_short", "n_caps_words", "n_distinct",
]


def _lut(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_CLASSES = {
    "n_symbols": _lut("#*$%&|<>"),
    "n_upper": _lut("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "n_lower": _lut("abcdefghijklmnopqrstuvwxyz"),
    "n_digit": _lut("0123456789"),
    "n_stop": _lut(".,;:"),
    "n_loud": _lut("!?"),
}
_HEAD = np.ones(256, bool)
_HEAD[0x80:0xC0] = False  # bytes that continue a code point


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def repeated_words(words: np.ndarray, n: int = 5) -> int:
    """Words inside an ``n``-word window that is found at least twice in the text."""
    if len(words) <= n:
        return 0
    _, which, count = np.unique(tk.ngrams(words, n), return_inverse=True, return_counts=True)
    often = count[which] > 1
    if not often.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: len(often)] += often
    edge[n : n + len(often)] -= often
    return int((np.cumsum(edge)[:-1] > 0).sum())


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """Every statistic of COUNTS for each text."""
    out = {k: np.zeros(len(texts), np.int64) for k in COUNTS}
    for lo, hi, data, offs in tk.blocks(texts):
        part = slice(lo, hi)
        for k, table in _CLASSES.items():
            out[k][part] = _sums(table[data], offs)
        head = _HEAD[data]
        out["n_chars"][part] = _sums(head, offs)
        out["word_chars"][part] = _sums(head & ~tk.SPACE[data], offs)
        starts, ends, at = tk.word_bounds(data, offs)
        words = tk.hashed(data, starts, ends, fold=False)
        out["n_short"][part] = _sums(ends - starts <= 3, at)
        upper, lower = (np.concatenate([[0], np.cumsum(_CLASSES[k][data], dtype=np.int64)]) for k in ("n_upper", "n_lower"))
        out["n_caps_words"][part] = _sums((upper[ends] > upper[starts]) & (lower[ends] == lower[starts]), at)
        out["n_words"][part] = np.diff(at)
        raw = data.tobytes()
        for i in range(hi - lo):
            own = words[at[i] : at[i + 1]]
            out["n_repeat_words"][lo + i] = repeated_words(own)
            out["n_distinct"][lo + i] = len(np.unique(own))
            lines = [x for x in raw[offs[i] : offs[i + 1]].split(b"\n") if x.strip()]
            out["n_lines"][lo + i] = len(lines)
            out["n_dup_lines"][lo + i] = len(lines) - len(set(lines))
    return out


def statistics(docs: DataFrame, keep: list[str], text: bool = False) -> DataFrame:
    """The columns ``keep`` and the COUNTS of ``text``; the text itself goes no further, or else as ``__text``."""
    given = docs.select(*keep, F.col("text").alias("__text"))
    passed = [*keep, *["__text"] * text]
    schema = StructType([*(given.schema[k] for k in passed), *(StructField(k, LongType()) for k in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = counts(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(passed)], *(pa.array(found[k]) for k in COUNTS)], [*passed, *COUNTS])

    return given.mapInArrow(tk.freeing(run), schema)


def ratio(num: str, den: str, floor: float) -> F.Column:
    """log(num / den + floor), with den at least 1."""
    return F.log(F.col(num) / F.greatest(F.col(den), F.lit(1)) + F.lit(floor))


#: The transformed statistics: (name, expression, smallest spread that a class or group is given).
FEATURES = [
    ("x_words", F.log1p, 0.5),
    ("x_length", ("word_chars", "n_words", 0.1), 0.1),
    ("x_symbols", ("n_symbols", "n_words", 0.02), 0.5),
    ("x_dup", ("n_dup_lines", "n_lines", 0.05), 0.5),
    ("x_repeat", ("n_repeat_words", "n_words", 0.02), 0.5),
    ("x_upper", ("n_upper", "n_chars", 0.01), 0.3),
    ("x_loud", ("n_loud", "n_words", 0.02), 0.5),
    ("x_caps", ("n_caps_words", "n_words", 0.05), 0.4),
    ("x_stop", ("n_stop", "n_words", 0.02), 0.3),
    ("x_digit", ("n_digit", "n_chars", 0.005), 0.5),
    ("x_short", ("n_short", "n_words", 0.05), 0.2),
    ("x_distinct", ("n_distinct", "n_words", 0.05), 0.2),
]


def features(names: list[str]) -> list[F.Column]:
    """The named transforms as columns over the COUNTS."""
    return [(F.log1p(F.col("n_words").cast("double")) if how is F.log1p else ratio(*how)).alias(name) for name, how, _ in FEATURES if name in names]


def spreads(names: list[str]) -> list[float]:
    return [floor for name, _, floor in FEATURES if name in names]
