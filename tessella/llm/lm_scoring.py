"""Deleted interpolation: bigram, unigram and uniform estimates mixed by buckets of the context's frequency.

The corpus is cut into batches of a few million tokens, written once as a table bucketed by batch, so no later step
moves tokens again.  Two rounds of requests and answers go through the shuffle as packed arrays:

1. every batch asks for the counts of its distinct words, by ranges of the word hash; an answer is the word's training
   count and a dense id,
2. every batch asks for the counts of its distinct id pairs, which as sorted ids compress well.

The mixture weights of each bucket are learned by expectation-maximisation on held-out counts: every training token
is held out in turn (its own count deleted from the estimates).  What EM needs from the corpus is a histogram of the
deleted estimates over fixed bins, summed over all training tokens.

Null and empty texts are the end token alone.  Repeated rows are scored once each and train once each.  A document
without an id is a training document.  Without training documents, every probability is 1.  An empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import textkit as tk
from tessella.tables import bucketed, partitions, stored, table

END = np.uint64(0x5DEECE66D1234567)
BATCH_TOKENS = 3_000_000
BUCKETS = 24  # of a context's count: 0, 1, 2-3, 4-7, ...
BINS = 4  # for each factor of two of an estimate


def pack(x: np.ndarray) -> bytes:
    """Integers in the fewest whole bytes, byte plane after byte plane, compressed."""
    x = np.ascontiguousarray(x, np.uint64)
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = x.view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view(np.uint64).reshape(-1)


def _train(doc_id, fold: int) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 != fold


def batches_of(docs: DataFrame, fold: int) -> DataFrame:
    """The corpus as a table of batches, bucketed by batch: ids, token numbers, distinct word hashes, their training
    counts, and every token as an index into them."""
    id_type = dict(docs.dtypes)["doc_id"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        ids, sizes, tokens, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal k
            k += 1
            flat = np.concatenate(tokens)
            words, index = np.unique(flat, return_inverse=True)
            trained = np.repeat([_train(i, fold) for i in ids], sizes)
            counts = np.bincount(index[trained], minlength=len(words))
            return pa.RecordBatch.from_arrays([pa.array([f"{part}-{k}"]), pa.array([ids]), pa.array([sizes], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (words.tobytes(), pack(counts), pack(index)))], ["batch", "ids", "sizes", "words", "counts", "tokens"])

        for b in rows:
            numbers = b.column(0).to_pylist()
            for lo, hi, data, offs in tk.blocks(b.column(1)):
                words, at = tk.word_hashes(data, offs)
                ends = at[1:] + np.arange(hi - lo)
                full = np.empty(len(words) + hi - lo, np.uint64)
                is_end = np.zeros(len(full), bool)
                is_end[ends] = True
                full[is_end], full[~is_end] = END, words
                ids += numbers[lo:hi]
                sizes += (np.diff(at) + 1).tolist()
                tokens.append(full)
                held += len(full)
                if held >= BATCH_TOKENS:
                    yield flush()
                    ids, sizes, tokens, held = [], [], [], 0
        if ids:
            yield flush()

    out = docs.select("doc_id", "text").mapInArrow(tk.freeing(run), f"batch string, ids array<{id_type}>, sizes array<bigint>, words binary, counts binary, tokens binary")
    return bucketed(out, "batch", "batches", "uncompressed")


def _word_requests(batches: DataFrame, shares: int) -> DataFrame:
    """(share, batch, hashes, counts): a batch's distinct words by range of hash, with its own training counts."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = [(i << 64) // shares for i in range(1, shares)]
        for b in rows:
            for batch, words, counts in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words, counts = np.frombuffer(words, np.uint64), unpack(counts)
                cuts = [0, *np.searchsorted(words, np.array(edges, np.uint64)), len(words)] if edges else [0, len(words)]
                spans = [(i, lo, hi) for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]
                yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in spans], pa.int32()), pa.array([batch] * len(spans)), pa.array([words[lo:hi].tobytes() for _, lo, hi in spans], pa.binary()), pa.array([pack(counts[lo:hi]) for _, lo, hi in spans], pa.binary())], ["share", "batch", "keys", "counts"])

    return batches.select("batch", "words", "counts").mapInArrow(tk.freeing(run), "share int, batch string, keys binary, counts binary")


def _totals(requests: DataFrame, shares: int, plain: bool) -> DataFrame:
    """The answer to each request: summed counts in the order of its keys, and dense ids (interleaved over shares)."""

    def answer(group: pa.Table) -> pa.Table:
        share = group.column("share")[0].as_py()
        keys = [np.frombuffer(x.as_py(), np.uint64) if plain else np.cumsum(unpack(x.as_py()), dtype=np.uint64) for x in group.column("keys")]
        flat, where = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([unpack(x.as_py()) for x in group.column("counts")]).astype(np.float64)
        total = np.bincount(where, counts, len(flat)).astype(np.uint64)
        rank = np.empty(len(flat), np.uint64)
        if plain:
            rank[np.argsort(~total, kind="stable")] = np.arange(len(flat), dtype=np.uint64) * np.uint64(shares) + np.uint64(share)
        cuts = np.cumsum([0, *map(len, keys)])
        spans = [where[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        n = len(spans)
        first = lambda x: [int(x), *[0] * (n - 1)]
        return pa.table({
            "batch": group.column("batch"), "share": group.column("share"), "totals": pa.array([pack(total[s]) for s in spans], pa.binary()),
            "ranks": pa.array([pack(rank[s]) if plain else b"" for s in spans], pa.binary()), "distinct": pa.array(first((total > 0).sum()), pa.int64()), "tokens": pa.array(first(total.sum()), pa.int64()),
            "top": pa.array(first(int(plain and len(rank) and int(rank.max()) >> 32 > 0)), pa.int64()),
        })

    return requests.groupBy("share").applyInArrow(tk.freeing_group(answer), "batch string, share int, totals binary, ranks binary, distinct long, tokens long, top long")


def _words(state: pa.Table, answers: pa.Table) -> tuple[dict, np.ndarray, np.ndarray]:
    """A batch's row, and count and id of each of its distinct words."""
    row = {k: state.column(k)[0].as_py() for k in ("batch", "ids", "sizes", "tokens")}
    first = sorted((r for r in answers.select(["share", "totals", "ranks"]).to_pylist() if r["ranks"]), key=lambda r: r["share"])
    return row, np.concatenate([unpack(r["totals"]) for r in first]), np.concatenate([unpack(r["ranks"]) for r in first])


def _pairs(row: dict, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word of each token, word before it, distinct id pairs, the pair of each token); before a text comes its end."""
    tokens = unpack(row["tokens"]).astype(np.int64)
    ends = np.cumsum(row["sizes"]) - 1
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.concatenate([[0], ends[:-1] + 1])] = tokens[ends[0]]
    pairs, which = np.unique((rank[before] << np.uint64(32)) | rank[tokens], return_inverse=True)
    return tokens, before, pairs, which


def _share_of(pairs: np.ndarray, shares: int) -> np.ndarray:
    return (tk.mix(pairs) % np.uint64(shares)).astype(np.int64)


def _pair_requests(batches: DataFrame, answers: DataFrame, shares: int, fold: int) -> DataFrame:
    def run(state: pa.Table, found: pa.Table) -> pa.Table:
        row, _, rank = _words(state, found)
        tokens, _, pairs, which = _pairs(row, rank)
        trained = np.repeat([_train(i, fold) for i in row["ids"]], row["sizes"])
        counts = np.bincount(which[trained], minlength=len(pairs))
        share = _share_of(pairs, shares)
        out = [(i, at) for i in range(shares) if len(at := np.flatnonzero(share == i))]
        return pa.table({"share": pa.array([i for i, _ in out], pa.int32()), "batch": pa.array([row["batch"]] * len(out)), "keys": pa.array([pack(np.diff(pairs[at], prepend=np.uint64(0))) for _, at in out], pa.binary()), "counts": pa.array([pack(counts[at]) for _, at in out], pa.binary())})

    return batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(tk.freeing_cogroup(run), "share int, batch string, keys binary, counts binary")


def _estimates(state: pa.Table, found: pa.Table, shares: int):
    """(row, counts of each token's word, of its context, of both together)."""
    row, total, rank = _words(state, found)
    tokens, before, pairs, which = _pairs(row, rank)
    both = np.zeros(len(pairs), np.uint64)
    share = _share_of(pairs, shares)
    for r in found.select(["share", "totals", "ranks"]).to_pylist():
        if not r["ranks"]:
            both[share == r["share"]] = unpack(r["totals"])
    return row, *(x.astype(np.float64) for x in (total[tokens], total[before], both[which]))


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for no count, else 1 + log2."""
    return np.minimum(np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0), BUCKETS - 1)


def em(rows: list[tuple[int, float, float, float]], uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights (bigram, unigram, uniform) by bucket from (bucket, bigram estimate, unigram estimate, tokens)."""
    weights = np.tile([0.0, 0.9, 0.1], (BUCKETS, 1))
    table_ = np.array(rows, float).reshape(-1, 4)
    for b in range(BUCKETS):
        own = table_[table_[:, 0] == b]
        if len(own):
            p, n = np.column_stack([own[:, 1], own[:, 2], np.full(len(own), uniform)]), own[:, 3]
            w = np.array([0.5, 0.4, 0.1]) if b else np.array([0.0, 0.9, 0.1])
            for _ in range(rounds):
                post = p * w
                post /= post.sum(1, keepdims=True)
                w = (post * n[:, None]).sum(0) / n.sum()
                w = np.maximum(w, [1e-6 if b else 0.0, 1e-6, 1e-6])
                w /= w.sum()
            weights[b] = w
        elif b > 1:
            weights[b] = weights[b - 1]
    return weights


def _binned(p: np.ndarray) -> np.ndarray:
    """The bin of an estimate, -1 for none."""
    return np.where(p > 0, np.round(-np.log2(np.maximum(p, 1e-300)) * BINS), -1).astype(np.int64)


def scores(docs: DataFrame, fold: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; fitted on ids hashing to another remainder."""
    spark = docs.sparkSession
    id_type = dict(docs.dtypes)["doc_id"]
    shares = 4 * partitions(spark)
    batches = batches_of(docs, fold)
    words = stored(_totals(_word_requests(batches, shares), shares, True), "words")
    n, v = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    if words.agg(F.max("top")).first()[0] or 0:
        raise ValueError("more distinct words than pairs of ids can hold")
    answers = words.drop("distinct", "tokens", "top")
    pairs = stored(_totals(_pair_requests(batches, answers, shares, fold), shares, False), "pairs")
    answers = answers.unionByName(pairs.drop("distinct", "tokens", "top"))
    sides = batches.select("batch", "ids", "sizes", "tokens").groupBy("batch").cogroup(answers.groupBy("batch"))
    uniform = 1.0 / (v + 1)

    def histogram(state: pa.Table, found: pa.Table) -> pa.Table:
        row, word, context, both = _estimates(state, found, shares)
        own = np.repeat([_train(i, fold) for i in row["ids"]], row["sizes"])
        word, context, both = word[own] - 1, context[own] - 1, both[own] - 1
        cells, count = np.unique(np.column_stack([bucket(context), _binned(both / np.maximum(context, 1)), _binned(word / max(n - 1, 1))]), axis=0, return_counts=True)
        return pa.table({"b": cells[:, 0], "p2": cells[:, 1], "p1": cells[:, 2], "n": pa.array(count, pa.int64())})

    cells = sides.applyInArrow(tk.freeing_cogroup(histogram), "b long, p2 long, p1 long, n long").groupBy("b", "p2", "p1").agg(F.sum("n").alias("n")).collect()
    value = lambda k: 0.0 if k < 0 else 2.0 ** (-k / BINS)
    weights = em([(r["b"], value(r["p2"]), value(r["p1"]), r["n"]) for r in cells], uniform)

    def final(state: pa.Table, found: pa.Table) -> pa.Table:
        row, word, context, both = _estimates(state, found, shares)
        w = weights[bucket(context)]
        p = w[:, 0] * both / np.maximum(context, 1) + w[:, 1] * word / max(n, 1) + w[:, 2] * uniform
        base = np.log10((word + 0.5) / (n + 0.5 * (v + 1)))
        at = np.concatenate([[0], np.cumsum(row["sizes"])[:-1]])
        mixed = np.log10(p) if n else np.zeros(len(p))
        return pa.table({
            "doc_id": state.column("ids")[0].values, "held_out": pa.array([not _train(i, fold) for i in row["ids"]]), "n_tokens": pa.array(row["sizes"], pa.int64()), "n_known": pa.array(np.add.reduceat((word > 0).astype(np.int64), at)),
            "train_tokens": pa.array([int(n)] * len(at), pa.int64()), "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(mixed, at),
        })

    return sides.applyInArrow(tk.freeing_cogroup(final), f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base and interpolated log10 probability."""
    return scores(table(spark, sf_dir, "documents"))


QUERIES = {"op4_lm_scoring": op4_lm_scoring}
