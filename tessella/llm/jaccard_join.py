"""Exact n-gram Jaccard self-join: rare-first prefix filtering with length, positional and suffix filters.

A text's set is its distinct word 5-grams, each by 48 bits of its hash.  Texts with equal sets are one node.  The corpus
is cut into batches, written once as a table bucketed by batch that holds every set; only packed requests and answers
cross the shuffle:

1. Every batch asks for its distinct n-grams, by range of hash, and for its distinct sets by digest.  The answers are
   how often each n-gram occurs and which node stands for equal sets.  The bits that a request spends on an n-gram
   grow with the logarithm of the corpus; where two n-grams share them, both only look more frequent.
2. Elements are ordered rare first.  N-grams of one document alone come before all others and can never be shared, so
   only the rest of a prefix becomes entries: most documents have none.  Two linked sets meet at an entry.
3. Each list of entries makes a star: candidates are (member, centre), never all pairs of a list.  In each round a
   list's centre is another member of the component that holds most of it, every node outside is verified against the
   centre of most of its lists, and components are joined.
4. What is left are lists whose members lie in different components: their pairs across components are verified too.
   An entry knows the first elements of its node's prefix, so a pair is made at the first element that both share and
   not at later ones.  Of these pairs every node's closest is verified first and components are joined, for a few
   rounds; then all that still lie across components.  Pairs within a component are never needed: copies are not
   expanded, and no link is lost.

Candidates pass the length and the positional filter, and parities of the elements by range of hash bound the symmetric
difference (the suffix filter).  Every pair is verified once, on whole sets.

Null and word-free texts have empty sets and are their own component; texts under five words are one n-gram; repeated
rows are equal sets; an empty table gives none.  Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import textkit as tk
from tessella.llm.lm_scoring import pack, unpack
from tessella.operators.components import star_components
from tessella.tables import bucketed, drop_since, mark, partitions, stored, table, with_row_key

U = np.uint64
BATCH_BYTES = 8_000_000
BITS = 48  # of an n-gram's hash
INDEX = 24  # bits of a node's id that number it within its batch
HEADS = 12  # elements of a node's prefix that its entries carry
RANGES = 2048  # of hash, whose parities stand for a set
PARITY = [f"p{i}" for i in range(RANGES // 64)]
ROUNDS = 3  # of stars, before what is left of the lists is searched
CLOSEST = 2  # rounds over the pairs left, each of every node's closest pair


def prefix_length(n: np.ndarray | int, t: int) -> np.ndarray | int:
    """Elements of the prefix: n - ceil(t n / 100) + 1."""
    return n - (n * t + 99) // 100 + 1


def batches_of(docs: DataFrame, n: int) -> DataFrame:
    """The corpus as a table of batches, bucketed by batch: ids, each row's set as an index (-1: empty), and of every
    distinct set its digest, size and sorted elements."""
    id_type = dict(docs.dtypes)["doc_id"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        ids: list = []
        index: list[int] = []
        known: dict[bytes, int] = {}
        sets: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal k
            if part >> 22 or k >> 17:
                raise ValueError("too many batches for their names")
            name = (part << 17) | k
            k += 1
            sizes = np.array([len(x) for x in sets], np.int64)
            steps = np.concatenate([np.diff(x, prepend=U(0)) for x in sets]) if sets else np.zeros(0, U)
            cols = [pa.array([name], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([index], pa.list_(pa.int32())), *(pa.array([x], pa.binary()) for x in (b"".join(known), pack(sizes), pack(steps))), pa.array([int(sizes.sum())], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["batch", "ids", "index", "digests", "sizes", "elements", "total"])

        for b in rows:
            kind, numbers, done = b.column(0).type, b.column(0).to_pylist(), 0
            for lo, hi, data, offs in tk.blocks(b.column(1)):
                words, at = tk.word_hashes(data, offs)
                for i in range(hi - lo):
                    grams = np.unique(tk.ngrams(words[at[i] : at[i + 1]], n) >> U(64 - BITS))
                    if not len(grams):
                        index.append(-1)
                        continue
                    digest = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
                    if digest not in known:
                        known[digest] = len(sets)
                        sets.append(grams)
                    index.append(known[digest])
                ids += numbers[lo:hi]
                size += len(data) + 64 * (hi - lo)
                if size >= BATCH_BYTES:
                    yield flush()
                    ids, index, known, sets, size = [], [], {}, [], 0
        if ids:
            yield flush()

    out = docs.select("doc_id", "text").mapInArrow(tk.freeing(run), f"batch long, ids array<{id_type}>, index array<int>, digests binary, sizes binary, elements binary, total long")
    return bucketed(out, "batch", "sets", "uncompressed")


class Batch:
    """A batch's nodes; everything can be made again from the table."""

    def __init__(self, state: pa.Table):
        row = {c: state.column(c)[0].as_py() for c in ("batch", "index", "digests", "sizes", "elements") if c in state.column_names}
        self.name = row["batch"]
        self.index = np.array(row.get("index", ()), np.int64)
        self.sizes = unpack(row["sizes"]).astype(np.int64)
        self.ids = (self.name << INDEX) + np.arange(len(self.sizes))
        self.digests = np.frombuffer(row["digests"], "S16") if "digests" in row else None
        if "elements" in row:
            steps = unpack(row["elements"])
            starts = np.cumsum(self.sizes) - self.sizes
            total = np.cumsum(steps, dtype=U)
            self.starts = starts
            self.grams = total - np.repeat(total[starts] - steps[starts], self.sizes) if len(starts) else steps

    def keys(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct requests for n-grams, which of them each element is, and how often each occurs."""
        return np.unique(self.grams >> U(BITS - bits), return_inverse=True, return_counts=True)

    def set_of(self, i: int) -> np.ndarray:
        return self.grams[self.starts[i] : self.starts[i] + self.sizes[i]]


def _ranges(keys: np.ndarray, bits: int, shares: int) -> list[tuple[int, int, int]]:
    """(share, from, to) of sorted keys, by range."""
    cuts = np.searchsorted(keys, np.array([(i << bits) // shares for i in range(1, shares)], U))
    cuts = [0, *cuts.tolist(), len(keys)]
    return [(i, lo, hi) for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]


def _by_digest(digests: np.ndarray, shares: int) -> list[tuple[int, np.ndarray]]:
    """(share, places) of digests."""
    raw = np.frombuffer(digests.tobytes(), U).reshape(-1, 2)[:, 0]
    share = (raw % U(shares)).astype(np.int64)
    order = np.argsort(share, kind="stable")
    return [(int(share[at[0]]), at) for at in np.split(order, np.flatnonzero(np.diff(share[order])) + 1) if len(at)]


REQUEST = "share int, batch long, kind int, keys binary, counts binary"
ANSWER = "batch long, kind int, share int, answer binary"


def _requests(batches: DataFrame, bits: int, shares: int) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for i in range(b.num_rows):
                batch = Batch(pa.Table.from_batches([b.slice(i, 1)]))
                keys, _, counts = batch.keys(bits)
                out = [(s, batch.name, 1, pack(np.diff(keys[lo:hi], prepend=U(0))), pack(counts[lo:hi])) for s, lo, hi in _ranges(keys, bits, shares)]
                out += [(s, batch.name, 0, batch.digests[at].tobytes(), batch.ids[at].tobytes()) for s, at in _by_digest(batch.digests, shares)]
                cols = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["share", "batch", "kind", "keys", "counts"])

    return batches.select("batch", "digests", "sizes", "elements").mapInArrow(tk.freeing(run), REQUEST)


def _answer(group: pa.Table) -> pa.Table:
    """Of one share: the node for each digest, and for each n-gram its frequency in half steps of log2, 0 for one."""
    rows = group.to_pylist()
    out = []
    for kind in (0, 1):
        own = [r for r in rows if r["kind"] == kind]
        if not own:
            continue
        if kind:
            keys = [np.cumsum(unpack(r["keys"]), dtype=U) for r in own]
        else:
            keys = [np.frombuffer(r["keys"], "S16") for r in own]
        cuts = np.cumsum([0, *map(len, keys)])
        flat, where = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        if kind:
            times = np.bincount(where, np.concatenate([unpack(r["counts"]) for r in own]).astype(np.float64), len(flat))
            value = np.where(times > 1, np.round(2 * np.log2(np.maximum(times, 1))), 0).astype(np.uint64)
        else:
            nodes = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in own])
            least = np.full(len(flat), np.iinfo(np.int64).max)
            np.minimum.at(least, where, nodes)
            value = least.astype(np.uint64)
        out += [(r["batch"], kind, r["share"], pack(value[where[lo:hi]])) for r, lo, hi in zip(own, cuts[:-1], cuts[1:], strict=True)]
    cols = zip(*out, strict=True)
    return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["batch", "kind", "share", "answer"])


def _node_of(batch: Batch, found: pa.Table, shares: int) -> np.ndarray:
    """The node that stands for each of the batch's sets."""
    answers = {r["share"]: r["answer"] for r in found.to_pylist() if r["kind"] == 0}
    out = np.zeros(len(batch.ids), np.int64)
    for s, at in _by_digest(batch.digests, shares):
        out[at] = unpack(answers[s]).astype(np.int64)
    return out


def _members(batches: DataFrame, answers: DataFrame, shares: int) -> DataFrame:
    """doc_id, n_shingles and node of every row."""
    id_type = dict(batches.dtypes)["ids"].removeprefix("array<").removesuffix(">")

    def run(state: pa.Table, found: pa.Table) -> pa.Table:
        batch = Batch(state)
        node = _node_of(batch, found, shares)
        none = pa.array(batch.index < 0)
        at = np.maximum(batch.index, 0)
        sizes, nodes = (x[at] if len(x) else np.zeros(len(at), np.int64) for x in (batch.sizes, node))
        return pa.table({"doc_id": state.column("ids")[0].values, "n_shingles": pa.array(np.where(batch.index < 0, 0, sizes)), "node": pa.array(nodes, mask=none.to_numpy(zero_copy_only=False))})

    sides = batches.select("batch", "ids", "index", "digests", "sizes").groupBy("batch").cogroup(answers.where("kind = 0").groupBy("batch"))
    return sides.applyInArrow(tk.freeing_cogroup(run), f"doc_id {id_type}, n_shingles long, node long")


def _entries(batches: DataFrame, answers: DataFrame, bits: int, shares: int, t: int) -> DataFrame:
    """element, node, size, position and heads: the shared elements of each node's prefix, and before each the first
    few of them."""

    def run(state: pa.Table, found: pa.Table) -> pa.Table:
        batch = Batch(state)
        mine = _node_of(batch, found, shares) == batch.ids
        keys, where, _ = batch.keys(bits)
        level = np.zeros(len(keys), np.uint8)
        spans = {s: (lo, hi) for s, lo, hi in _ranges(keys, bits, shares)}
        for r in found.to_pylist():
            if r["kind"] == 1:
                lo, hi = spans[r["share"]]
                level[lo:hi] = unpack(r["answer"])
        level = level[where]
        owner = np.repeat(np.arange(len(batch.sizes)), batch.sizes)
        shared = np.flatnonzero((level > 0) & mine[owner])
        alone = batch.sizes - np.bincount(owner, level > 0, len(batch.sizes)).astype(np.int64)
        owner, grams, level = owner[shared], batch.grams[shared], level[shared]
        order = np.lexsort((grams, level, owner))
        owner, grams = owner[order], grams[order]
        first = np.searchsorted(owner, np.arange(len(batch.sizes)))
        rank = np.arange(len(owner)) - first[owner]
        position = alone[owner] + rank
        keep = np.flatnonzero(position < prefix_length(batch.sizes, t)[owner])
        owner, grams, rank, position = owner[keep], grams[keep], rank[keep], position[keep]
        many = np.minimum(rank, HEADS)
        begin = np.searchsorted(owner, owner)
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        heads = grams[np.repeat(begin, many) + step] if len(owner) else grams
        offs = np.concatenate([[0], np.cumsum(many)])
        heads = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(heads.view(np.int64)))
        return pa.table({"element": pa.array(grams.view(np.int64)), "node": pa.array(batch.ids[owner]), "size": pa.array(batch.sizes[owner]), "position": pa.array(position), "heads": heads})

    sides = batches.select("batch", "digests", "sizes", "elements").groupBy("batch").cogroup(answers.groupBy("batch"))
    return sides.applyInArrow(tk.freeing_cogroup(run), "element long, node long, size long, position long, heads array<long>")


def may_link(size_a: str, position_a: str, size_b: str, position_b: str, t: int) -> F.Column:
    """Length filter and positional filter of two entries of one list.

    The positional filter takes the entry for the first element that the two sets share: nothing before it counts.
    A linked pair passes at its first shared element; at later ones it need not.
    """
    a, b, i, j = (F.col(x) for x in (size_a, size_b, position_a, position_b))
    most = F.least(a - i, b - j)
    return (100 * F.least(a, b) >= t * F.greatest(a, b)) & ((100 + t) * most >= t * (a + b))


def _sets(batches: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, size, packed set and range parities of the wanted nodes, bucketed by node; a node's id names its batch."""
    asked = wanted.select(F.shiftright("node", INDEX).alias("batch"), "node").groupBy("batch").agg(F.collect_list("node").alias("nodes"))
    names = ["node", "size", "elements", *PARITY]
    kinds = (pa.int64(), pa.int64(), pa.binary(), *(pa.int64() for _ in PARITY))

    def run(state: pa.Table, found: pa.Table) -> pa.Table:
        if not found.num_rows or not state.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        batch, out = Batch(state), []
        for node in found.column("nodes")[0].as_py():
            own = batch.set_of(node - (batch.name << INDEX))
            odd = np.bincount((own % U(RANGES)).astype(np.int64), minlength=RANGES) & 1
            out.append((node, len(own), pack(np.diff(own, prepend=U(0))), *np.packbits(odd).view(np.int64).tolist()))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    sides = batches.select("batch", "sizes", "elements").groupBy("batch").cogroup(asked.groupBy("batch"))
    return bucketed(sides.applyInArrow(tk.freeing_cogroup(run), "node long, size long, elements binary, " + ", ".join(f"{x} long" for x in PARITY)), "node", "wanted", "uncompressed")


def apart(other: str) -> F.Column:
    """A lower bound of the symmetric difference: ranges of different parity each hold an element of it."""
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(x).bitwiseXOR(F.col(f"{other}{x}"))) for x in PARITY))


def may_agree(size_a: str, size_b: str, other: str, t: int) -> F.Column:
    """Suffix filter by ``apart``."""
    both = F.col(size_a) + F.col(size_b)
    return (100 + t) * F.floor((both - apart(other)) / 2) >= t * both


def suffix_filtered(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """The pairs (a, b) that pass the suffix filter."""
    slim = sets.select("node", "size", *PARITY)
    near = pairs.join(slim.withColumnRenamed("node", "a"), "a").join(slim.select(F.col("node").alias("b"), *(F.col(c).alias(f"other_{c}") for c in ("size", *PARITY))), "b")
    return stored(near.where(may_agree("size", "other_size", "other_", t)).select("a", "b"), "near")


def verified(near: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = (np.cumsum(unpack(z.as_py()), dtype=U) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= t * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    # Both sets of a pair come from one reading of the table.
    sides = near.select("a", "b", F.explode(F.array("a", "b")).alias("node")).join(sets.select("node", "elements"), "node")
    full = sides.groupBy("a", "b").agg(F.min_by("elements", "node").alias("x"), F.max_by("elements", "node").alias("y"))
    return full.mapInArrow(tk.freeing(exact), "a long, b long")


def _labelled(links: DataFrame) -> DataFrame:
    """id and component of every linked node."""
    return stored(star_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "label")


def _placed(rows: DataFrame, label: DataFrame, *names: str) -> DataFrame:
    """``rows`` with of_<name>, the component of each named node."""
    for x in names:
        rows = rows.join(label.select(F.col("id").alias(x), F.col("component").alias(f"of_{x}")), x, "left").withColumn(f"of_{x}", F.coalesce(f"of_{x}", x))
    return rows


def _mixed(lists: DataFrame, label: DataFrame) -> DataFrame:
    """The lists whose members lie in different components: each entry with ``of_node``, its component, and ``main``,
    the component of most of the list."""
    entries = _placed(lists.drop("of_node", "main"), label, "node")
    sizes = entries.groupBy("element", "of_node").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("element").agg(F.count(F.lit(1)).alias("parts"), F.max_by("of_node", F.struct("k", "of_node")).alias("main")).where("parts > 1").select("element", "main")
    return stored(entries.join(main, "element"), "mixed")


def _stars(lists: DataFrame, tried: DataFrame | None, t: int, k: int) -> DataFrame:
    """One new candidate (a, b) of each node outside its lists' main component: a member of the main component that
    stands for a list in this round ``k``, and for most of the node's lists."""
    centres = lists.where("of_node = main").groupBy("element").agg(F.min_by(F.struct("node", "size"), F.struct(F.xxhash64("node", F.lit(k)), "node")).alias("c"))
    near = (F.col("of_node") != F.col("main")) & (100 * F.least("size", "c.size") >= t * F.greatest("size", "c.size"))
    stars = lists.join(centres, "element").where(near).groupBy(F.col("node").alias("x"), F.col("c.node").alias("y")).agg(F.count(F.lit(1)).alias("times"))
    stars = stars.select("x", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "times")
    if tried is not None:
        stars = stars.join(tried, ["a", "b"], "left_anti")
    return stars.groupBy("x").agg(F.max(F.struct("times", "a", "b")).alias("m")).select("m.a", "m.b").distinct()


def _across(lists: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """The distinct candidates (a, b) of mixed lists, across components: each has a member outside the main one; and
    ``far``, how far apart they are by the suffix filter."""
    lists = lists.join(sets.select("node", *PARITY), "node")
    other = lists.select("element", *(F.col(c).alias(f"other_{c}") for c in ("node", "size", "position", "heads", "of_node", *PARITY)))
    once = (F.col("other_of_node") == F.col("main")) | (F.col("of_node") < F.col("other_of_node"))
    first = may_link("size", "position", "other_size", "other_position", t) & ~F.arrays_overlap("heads", "other_heads")
    pairs = lists.where("of_node <> main").join(other, "element").where((F.col("of_node") != F.col("other_of_node")) & once & first & may_agree("size", "other_size", "other_", t))
    far = apart("other_") / (F.col("size") + F.col("other_size"))
    return pairs.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b"), far.alias("far")).distinct()


def _closest(pairs: DataFrame) -> DataFrame:
    """The closest pair of every node."""
    ends = pairs.select("a", "b", "far", F.explode(F.array("a", "b")).alias("x"))
    return ends.groupBy("x").agg(F.min(F.struct("far", "a", "b")).alias("m")).select("m.a", "m.b").distinct()


def components(docs: DataFrame, t: int = 75, n: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    spark, since = docs.sparkSession, mark()
    shares = partitions(spark)
    batches = batches_of(docs, n)
    total = batches.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    bits = min(BITS, max(24, int(total).bit_length() + 8))
    requests = _requests(batches, bits, shares).repartition(shares, "share")
    answers = stored(requests.groupBy("share").applyInArrow(tk.freeing_group(_answer), ANSWER), "answers", "none")
    members = stored(_members(batches, answers, shares), "members")
    entries = stored(_entries(batches, answers, bits, shares, t), "entries")
    label = spark.createDataFrame([], "id long, component long")
    lists = _mixed(entries, label)  # of two members at least
    sets = _sets(batches, lists.select("node").distinct())
    drop_since(spark, since, members, lists, sets)
    links, tried = [], None
    for k in range(ROUNDS):
        best = stored(_stars(lists, tried, t, k), "best")
        if best.isEmpty():
            break
        tried = best if tried is None else tried.unionByName(best)
        links.append(stored(verified(suffix_filtered(best, sets, t), sets, t), "links"))
        label = _labelled(reduce(DataFrame.unionByName, links))
        lists = _mixed(lists, label)
        drop_since(spark, since, members, lists, sets, label, tried, *links)
    rest = _across(lists, sets, t)
    rest = stored(rest if tried is None else rest.join(tried, ["a", "b"], "left_anti"), "rest")
    for k in range(CLOSEST + 1):
        if rest.isEmpty():
            break
        best = stored(_closest(rest), "best") if k < CLOSEST else rest
        links.append(stored(verified(best, sets, t), "links"))
        label = _labelled(reduce(DataFrame.unionByName, links))
        if k < CLOSEST:
            rest = _placed(rest.join(best, ["a", "b"], "left_anti"), label, "a", "b").where("of_a <> of_b")
            rest = stored(rest.select("a", "b", "far"), "rest")
        drop_since(spark, since, members, sets, label, rest, *links)
    # Components of smallest document ids.
    owner = members.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("owner"))
    owner = stored(_placed(owner, label, "node"), "owner")
    least = owner.groupBy("of_node").agg(F.min("owner").alias("component_id"))
    drop_since(spark, since, members, owner)
    owner = owner.join(least, "of_node").select("node", "component_id")
    return members.join(owner, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, the one of smallest id (rows without an id last, then the first written); rows that
    share an id but not a text each stand for their own text."""
    since = mark()
    rows = with_row_key(docs, "jaccard_rows")
    found = stored(components(rows.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "component_id"), "components")
    drop_since(spark, since, rows, found)
    several = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("component_id")
    inside = found.join(several, "component_id").join(rows.select("__row", "doc_id"), "__row")
    kept = inside.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "__row")).alias("m")).select(F.col("m.__row").alias("__row"))
    gone = inside.join(kept, "__row", "left_anti").select("__row")
    return rows.join(gone, "__row", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents under five-word Jaccard similarity of 0.75 or more."""
    return components(table(spark, sf_dir, "documents"))


QUERIES = {"op10_jaccard_join": op10_jaccard_join}
