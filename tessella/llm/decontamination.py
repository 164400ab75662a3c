"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are partitioned by their number of words (powers of two).  For each partition a document is cut into blocks
of twice its lower size, and every two adjacent blocks are a window, so a passage as long as an item lies whole in some
window and its containment means a Jaccard similarity of about a fifth.  A window is a candidate for an item if one of
128 minima agrees; an item spread over several windows meets more of them.  Every candidate (document, item) is then
verified once against the whole document's n-grams.

Items are the query side: they reach the executors in blocks of bounded bytes, whatever their number; documents are
read once a block and never shuffled.  Null and word-free items match nothing; items under five words are one n-gram of
their length and are looked up exactly; null and empty documents hold nothing; repeated items and documents each give
their own rows; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm import textkit as tk
from tessella.tables import drop_since, mark, stored, table

PERMUTATIONS = 128
BLOCK_BYTES = 4_000_000
_RNG = np.random.default_rng(77)
_ODD = _RNG.integers(1, 2**62, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TOP = np.uint64(2**64 - 1)


class Items:
    """A block of test items: n-gram sets, and their minima by size partition and permutation."""

    def __init__(self, rows: list[tuple[object, str]], n: int):
        self.n = n
        self.ids, self.sets, short, sized = [], [], {}, {}
        for item_id, text in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            words, _ = tk.word_hashes(raw, np.array([0, len(raw)]))
            if not len(words):
                continue
            k = len(self.ids)
            self.ids.append(item_id)
            self.sets.append(np.unique(tk.ngrams(words, n)))
            if len(words) < n:
                short.setdefault(len(words), []).append(k)
            else:
                sized.setdefault(len(words).bit_length() - 1, []).append(k)
        self.short = {m: self._table([(self.sets[k][0], k) for k in ks]) for m, ks in short.items()}
        self.sized = {}
        for level, ks in sized.items():
            self.sized[level] = [self._table([((self.sets[k] * a).min(), k) for k in ks]) for a in _ODD]

    @staticmethod
    def _table(pairs: list[tuple[np.uint64, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys, their items, and a bitmap of 2^16 low bits that most other values miss."""
        keys, of = np.array([k for k, _ in pairs], np.uint64), np.array([k for _, k in pairs])
        order = np.argsort(keys, kind="stable")
        bits = np.zeros(1 << 16, bool)
        bits[(tk.mix(keys) & np.uint64(0xFFFF)).astype(np.int64)] = True
        return keys[order], of[order], bits

    @staticmethod
    def _hits(table_, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in values, item) for equal keys."""
        keys, of, bits = table_
        at = np.flatnonzero(bits[(tk.mix(values) & np.uint64(0xFFFF)).astype(np.int64)])
        lo, hi = np.searchsorted(keys, values[at], "left"), np.searchsorted(keys, values[at], "right")
        count = hi - lo
        start = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) if len(count) else lo
        return np.repeat(at, count), of[start + np.arange(count.sum())] if len(count) else of[:0]

    def candidates(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
        """(text, item) pairs of a block of texts, given its word hashes and each text's first word."""
        found = set()
        n = self.n
        texts = len(at) - 1
        size = np.maximum(np.diff(at) - n + 1, 0)
        if self.short:
            owner = np.repeat(np.arange(texts), np.diff(at))
            for m, own in self.short.items():
                if len(words) >= m:
                    grams = tk.ngrams(words, m)
                    whole = owner[: len(grams)] == owner[m - 1 :]
                    where, item = self._hits(own, grams)
                    found.update((int(owner[w]), int(k)) for w, k in zip(where, item, strict=True) if whole[w])
        if not self.sized or not size.any():
            return iter(sorted(found))
        grams = tk.ngrams(words, n)
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        # The n-grams within texts, without those across a boundary.
        inside = np.repeat(at[:-1] - starts, size) + np.arange(size.sum())
        grams = grams[inside]
        for level, own in self.sized.items():
            block = 2 << level
            blocks = -(-size // block)
            owner = np.repeat(np.arange(texts), blocks)
            first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
            edge = np.repeat(starts, blocks) + (np.arange(blocks.sum()) - np.repeat(first, blocks)) * block
            joined = owner[1:] == owner[:-1]
            for a, table_ in zip(_ODD, own, strict=True):
                least = np.minimum.reduceat(grams * a, edge)
                window = least.copy()
                window[:-1] = np.where(joined, np.minimum(least[1:], least[:-1]), least[:-1])
                where, item = self._hits(table_, window)
                found.update(zip(owner[where].tolist(), item.tolist(), strict=True))
        return iter(sorted(found))


def _blocks_of_items(items: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """The items, streamed in blocks of bounded bytes."""
    held, size = [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += len(r["text"] or "") + 50
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def matches(docs: DataFrame, items: DataFrame, t: int = 75, n: int = 5) -> DataFrame:
    """doc_id, item_id, n_shared and n_item: pairs with 100 * shared n-grams >= t * the item's n-grams."""
    kinds = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(items.dtypes)['item_id']}, n_shared long, n_item long"
    docs = docs.select("doc_id", "text")
    item_type = to_arrow_type(items.schema["item_id"].dataType)

    def search(block: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0)
                out = []
                for lo, _, data, offs in tk.blocks(b.column(1)):
                    words, at = tk.word_hashes(data, offs)
                    last, whole = -1, {}
                    for i, k in block.candidates(words, at):
                        if i != last:
                            last, whole = i, {}
                        own = words[at[i] : at[i + 1]]
                        size = min(n, 0) if len(own) == 0 else n
                        if len(block.sets[k]) == 1 and len(own) >= 1:
                            shared = 1 if _holds(own, block, k, n) else 0
                        else:
                            if size not in whole:
                                whole[size] = np.unique(tk.ngrams(own, n))
                            shared = int(np.isin(block.sets[k], whole[size], assume_unique=True).sum())
                        if 100 * shared >= t * len(block.sets[k]):
                            out.append((ids[lo + i].as_py(), block.ids[k], shared, len(block.sets[k])))
                cols = list(zip(*out, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], ids.type), pa.array(cols[1], item_type), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["doc_id", "item_id", "n_shared", "n_item"])

        return run

    found = None
    for rows in _blocks_of_items(items):
        part = docs.mapInArrow(tk.freeing(search(Items(rows, n))), kinds)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], kinds)


def _holds(own: np.ndarray, block: Items, k: int, n: int) -> bool:
    """Whether a text holds an item that is a single n-gram of n words or fewer."""
    want = block.sets[k][0]
    return any(len(own) >= m and bool((tk.ngrams(own, m) == want).any()) for m in {*block.short, n})


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no test item.

    A match goes by a digest of the text and not by id: documents without an id, and those that share one, stay or go
    each by its own text, and no copy of the documents is written.
    """
    key = tk.row_digest("text")
    since = mark()
    found = stored(matches(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__row")).distinct(), "matched")
    drop_since(spark, since, found)
    return docs.join(found, key == found["__row"], "left_anti")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item with the item's five-word n-grams contained to 75 % or more."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_decontamination": op6_decontamination}
