"""Byte-exact removal of passages that an earlier document holds too, with suffix arrays by linear grouping.

Every byte covered by a ``SPAN``-byte string that also starts in a document of smaller id is removed.  Any such string
holds an anchor, a position whose 16-byte hash is the least of a window, chosen by the string's bytes alone; so equal
strings share an anchor hash and meet there.  Documents are cut into batches, written once as a table bucketed by
batch; only packed requests and answers by hash cross the shuffle:

1. anchor hashes: which occur in two documents at least,
2. the 84-byte windows around shared anchors, as digests: a window that a smaller document has too is a hit as a
   whole; of different windows with one anchor, those that agree with another beyond the anchor need a comparison,
3. those windows' bytes: a suffix array over many windows puts equal strings side by side, and a string is a hit
   where a smaller document has it.  Anchors with very many different windows send digests of their strings instead,
   spread by digest, so no hot anchor gathers in one task.

The suffix array (``suffix_array``) is built by Lyndon grouping: groups of suffixes are processed in descending order,
each group's previous-smaller pointers split lower groups by how often they are pointed at, and then every group's
order is read off its next-smaller suffixes, in ascending order, without renaming or recursion.

Null and empty texts have no bytes; texts under SPAN bytes lose none; rows of equal id never remove from each other;
a null id is larger than any other; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tessella.llm import textkit as tk
from tessella.llm.lm_scoring import pack, unpack
from tessella.tables import bucketed, partitions, stored, table

SPAN, GRAM = 50, 16
REACH = SPAN - GRAM  # bytes of a string before or after its anchor, together
WIDE = GRAM + 2 * REACH
BATCH_BYTES = 16_000_000
SA_BYTES = 3_000_000
HOT = 5_000  # different windows of one anchor beyond which their strings travel as digests
_rng = np.random.default_rng(424242)
_T = _rng.integers(1, 2**63, 257, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M = np.uint64(0xA24BAED4963EE407)
U = np.uint64
CHUNK = 1 << 18
_UP, _DOWN = (np.cumprod(np.concatenate([np.ones(1, U), np.full(CHUNK + 2 * WIDE - 1, U(x))]), dtype=U) for x in (int(_M), pow(int(_M), -1, 2**64)))
NONE = np.uint64(2**63 - 1)
#: Parts of a window, each shared by all strings with so many bytes before the anchor: (from, to) within the window.
#: Strings with 26 to 34, 18 to 25, 9 to 17 and 0 to 8 bytes before the anchor.
BEFORE = [(26, 34), (18, 25), (9, 17), (0, 8)]
PARTS = [(REACH - 26, REACH + GRAM), (REACH - 18, REACH + GRAM + 9), (REACH - 9, REACH + GRAM + 17), (REACH, REACH + GRAM + 26)]


# ---------------------------------------------------------------- suffix array


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``text``; zeros end a string, and a suffix is compared to its string's end only."""
    n = len(text)
    order = np.argsort(text, kind="stable").astype(np.int64)
    count = np.bincount(text, minlength=1)
    start_of = np.cumsum(count) - count
    group = start_of[text].astype(np.int64)  # a group is named by its first place in order
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    end = np.zeros(n + 1, np.int64)
    end[start_of[count > 0]] = (start_of + count)[count > 0]
    before = np.arange(-1, n - 1, dtype=np.int64)
    floor = int(count[0])  # places of the ends
    chosen = np.zeros(n, bool)
    v_order, v_group, v_place, v_end, v_before = (memoryview(x) for x in (order, group, place, end, before))
    top = n
    while top > floor:
        low = v_group[v_order[top - 1]]
        if top - low < 24:
            points: dict[int, int] = {}
            own = sorted(v_order[low:top]) if top - low > 1 else (v_order[low],)
            for i in own:
                j = v_before[i]
                while j >= 0 and v_group[j] >= low:
                    j = v_before[j]
                v_before[i] = j
                if j >= 0 and v_group[j] >= floor:
                    points[j] = points.get(j, 0) + 1
            if points:
                ranked = sorted(points.items(), key=lambda x: (v_group[x[0]], -x[1])) if len(points) > 1 else list(points.items())
                i, m = 0, len(ranked)
                while i < m:  # each pointed-at group: those pointed at most often go last
                    h = v_group[ranked[i][0]]
                    stop = v_end[h]
                    while i < m and v_group[ranked[i][0]] == h:
                        times, fresh_end, k = ranked[i][1], stop, i
                        while i < m and ranked[i][1] == times and v_group[ranked[i][0]] == h:
                            j = ranked[i][0]
                            stop -= 1
                            a, q = v_place[j], v_order[stop]
                            v_order[a], v_order[stop] = q, j
                            v_place[q], v_place[j] = a, stop
                            i += 1
                        for x in range(k, i):
                            v_group[ranked[x][0]] = stop
                        v_end[stop] = fresh_end
                        if stop == h:
                            break
                    if stop > h:
                        v_end[h] = stop
        else:
            own = order[low:top]
            while True:
                j = before[own]
                far = (j >= 0) & (group[j] >= low)
                if not far.any():
                    break
                before[own[far]] = before[j[far]]
            j = j[(j >= 0)]
            j = j[group[j] >= floor]
            if len(j):
                x, times = np.unique(j, return_counts=True)
                h = group[x]
                by = np.lexsort((times, h))
                x, times, h = x[by], times[by], h[by]
                first = np.concatenate([[True], h[1:] != h[:-1]])
                at = np.flatnonzero(first)
                size = np.diff(np.append(at, len(x)))
                slot = np.arange(len(x)) - np.repeat(at, size) + np.repeat(end[h[at]] - size, size)
                chosen[x] = True
                there = order[slot]
                leave = there[~chosen[there]]
                gap = place[x]
                gap = gap[gap < np.repeat(end[h[at]] - size, size)]
                order[gap], place[leave] = leave, gap
                order[slot], place[x] = x, slot
                chosen[x] = False
                run = first | np.concatenate([[True], times[1:] != times[:-1]])
                r = np.flatnonzero(run)
                length = np.diff(np.append(r, len(x)))
                rest = end[h[at]] - size
                group[x] = np.repeat(slot[r], length)
                end[h[at]] = np.where(rest > h[at], rest, end[h[at]])
                end[slot[r]] = slot[r] + length
        top = low
    # The next suffix that is smaller (or of the same group, which is the next smaller one too).
    after = np.arange(1, n + 1, dtype=np.int64)
    bound = np.append(group, -1)
    live = np.flatnonzero(group >= floor)
    while len(live):
        j = after[live]
        live = live[bound[j] > group[live]]
        after[live] = after[after[live]]
    # Emit each group's order by the rank of its members' next smaller suffixes, in ascending order.
    rank, v_rank, v_after, v_bound = place, v_place, memoryview(after), memoryview(bound)
    starts = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
    size = np.diff(np.append(starts, n))
    for s, m in zip(starts[(size > 1) & (starts >= floor)].tolist(), size[(size > 1) & (starts >= floor)].tolist(), strict=True):
        if m < 24:
            left_, now_ = [], []
            for i in v_order[s : s + m]:
                (left_ if v_bound[v_after[i]] == s else now_).append(i)
            done = s
            while now_:
                now_.sort(key=lambda i: v_rank[v_after[i]])
                for i in now_:
                    v_order[done] = i
                    v_rank[i] = done
                    done += 1
                if not left_:
                    break
                placed = set(now_)
                now_, left_ = [i for i in left_ if v_after[i] in placed], [i for i in left_ if v_after[i] not in placed]
            continue
        own = order[s : s + m].copy()
        nxt = after[own]
        inner = bound[nxt] == s
        if not inner.any():
            own = own[np.argsort(rank[nxt], kind="stable")]
            order[s : s + m] = own
            rank[own] = np.arange(s, s + m)
            continue
        done = s
        now = own[~inner]
        now = now[np.argsort(rank[after[now]], kind="stable")]
        left = own[inner]
        while len(now):
            order[done : done + len(now)] = now
            rank[now] = np.arange(done, done + len(now))
            done += len(now)
            ready = np.isin(after[left], now)
            now, left = left[ready], left[~ready]
            now = now[np.argsort(rank[after[now]], kind="stable")]
    return order


# ---------------------------------------------------------------- batches


def anchors(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Positions such that every SPAN-byte string within a text holds one chosen by its bytes alone."""
    found = [np.zeros(0, np.int64)]
    w = SPAN - GRAM + 1
    values = _T[data]
    size = 1
    while size < GRAM:
        values = values[:-size] * U(pow(int(_M), size, 2**64)) + values[size:] if len(values) > size else values[:0]
        size *= 2
    values = tk.mix(values)
    for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        if hi - lo < SPAN:
            continue
        own = values[lo : hi - GRAM + 1]
        least = tk.sliding(own, w, np.minimum)
        edge = np.zeros(w - 1, U)
        most = tk.sliding(np.concatenate([edge, least, edge]), w, np.maximum)
        found.append(np.flatnonzero(most == own) + lo)
    return np.concatenate(found)


def run_hashes(data: np.ndarray, at: np.ndarray, froms: np.ndarray, tos: np.ndarray) -> np.ndarray:
    """For each position of ``at`` (ascending), hashes of runs around it, one a column: from and to are within WIDE bytes
    of it.  A run costs two running sums, whatever its length."""
    out = np.zeros(froms.shape, U)
    for lo in range(0, len(data), CHUNK):
        a, z = np.searchsorted(at, [lo, lo + CHUNK])
        if a == z:
            continue
        base = max(0, lo - WIDE)
        own = data[base : lo + CHUNK + WIDE]
        total = np.zeros(len(own) + 1, U)
        np.cumsum(_T[own] * _UP[: len(own)], out=total[1:])
        begin = froms[a:z] - base
        out[a:z] = (total[tos[a:z] - base] - total[begin]) * _DOWN[begin]
    return out


class Batch:
    """A batch of documents and what it asks and is answered; everything can be made again from the table."""

    def __init__(self, state: pa.Table, shares: int, answers: dict | None = None):
        row = {k: state.column(k)[0].as_py() for k in ("batch", "ids", "sizes", "text", "anchors")}
        self.name, self.ids, self.shares = row["batch"], row["ids"], shares
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"]), np.uint8)
        self.offs = np.concatenate([[0], np.cumsum(row["sizes"])]).astype(np.int64)
        self.key = np.array([NONE if i is None else np.int64(i).astype(U) ^ U(2**63) for i in self.ids], U) if self.ids else np.zeros(0, U)
        known = [x for (kind, _), x in (answers or {}).items() if kind == 0]
        self.placed_before = bool(known)  # then only the shared anchors are left
        self.at = np.cumsum(unpack(known[0] if known else row["anchors"])).astype(np.int64)
        self.doc = np.searchsorted(self.offs, self.at, "right") - 1
        h = np.zeros(len(self.at), U)
        for i in range(GRAM):
            h = h * _M + _T[self.data[self.at + i]]
        self.h = tk.mix(h)
        self.owner = self.key[self.doc]

    def spread(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        share = (tk.mix(keys ^ U(0x1F83D9ABFB41BD6B)) % U(self.shares)).astype(np.int64)
        order = np.argsort(share, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(share[order])) + 1):
            if len(at):
                yield int(share[at[0]]), at

    # round 1: distinct hashes
    def hashes(self) -> None:
        order = np.argsort(self.h)
        h, owner = self.h[order], self.owner[order]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.h1, self.which = h[first], np.empty(len(h), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.many = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first) if len(h) else np.zeros(0, bool)

    def shared(self, answers: dict) -> None:
        if not self.placed_before:
            self.hashes()
            hit = np.zeros(len(self.h1), bool)
            for s, at in self.spread(self.h1):
                hit[at] = np.unpackbits(np.frombuffer(answers[1, s], np.uint8), count=len(at)).astype(bool)
            good = hit[self.which]
            self.at, self.doc, self.h, self.owner = self.at[good], self.doc[good], self.h[good], self.owner[good]
        # Windows, cut where the text ends.
        lo, hi = self.offs[self.doc], self.offs[self.doc + 1]
        self.left, self.right = np.minimum(self.at - lo, REACH), np.minimum(hi - self.at - GRAM, REACH)
        self.window = self.parts_of([(0, WIDE)])[0]
        order = np.lexsort((self.owner, self.window, self.h))
        self.order = order
        h, w = self.h[order], self.window[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])]) if len(h) else np.zeros(0, bool)
        self.rep = order[new]  # the least owner's anchor of each distinct window
        self.of = np.empty(len(h), np.int64)
        self.of[order] = np.cumsum(new) - 1

    def parts_of(self, parts: list[tuple[int, int]]) -> list[np.ndarray]:
        """Hashes of parts of the windows; parts that the text's ends cut differently differ."""
        begin, end = (self.at - self.left)[:, None], (self.at + GRAM + self.right)[:, None]
        froms, tos = (self.at[:, None] - REACH + np.array(x) for x in zip(*parts, strict=True))
        found = run_hashes(self.data, self.at, np.clip(froms, begin, end), np.clip(tos, begin, end))
        found += (np.maximum(begin - froms, 0) * 256 + np.maximum(tos - end, 0)).astype(U) * _M
        return [tk.mix(x) for x in found.T]

    def placed(self, answers: dict) -> None:
        self.shared(answers)
        self.status = np.zeros(len(self.rep), np.uint8)
        for s, at in self.spread(self.h[self.rep]):
            self.status[at] = np.frombuffer(answers[2, s], np.uint8)
        self.ask = self.rep[self.status >= 16]
        # A window is asked only as far as the strings of its parts reach.
        agree = self.status[self.status >= 16] - 16
        most, least = np.zeros(len(agree), np.int64), np.full(len(agree), REACH)
        for k, (lo, hi) in enumerate(BEFORE):
            own = (agree >> k) & 1 == 1
            most[own], least[own] = np.maximum(most[own], hi), np.minimum(least[own], lo)
        self.ask_left, self.ask_right = np.minimum(self.left[self.ask], most), np.minimum(self.right[self.ask], REACH - least)
        # Strings of hot windows: digests and their least owner here.
        members = np.flatnonzero(self.status[self.of] == 4)
        before, at = np.arange(REACH + 1), self.at[members, None]
        begin = at - before
        ok = (self.left[members, None] >= before) & (self.right[members, None] >= REACH - before)
        begin = np.where(ok, begin, at)  # a run of no bytes
        found = run_hashes(self.data, self.at[members], begin, np.where(ok, begin + SPAN, at))
        self.digest, self.gram_at = tk.mix(found[ok]), begin[ok]
        self.gram_owner = self.key[np.searchsorted(self.offs, self.gram_at, "right") - 1] if len(self.gram_at) else np.zeros(0, U)
        order = np.lexsort((self.gram_owner, self.digest))
        d = self.digest[order]
        new = np.concatenate([[True], d[1:] != d[:-1]]) if len(d) else np.zeros(0, bool)
        self.grams, self.gram_least = d[new], self.gram_owner[order][new]

    def windows(self, at: np.ndarray) -> np.ndarray:
        """The asked windows' bytes, zero where the text ends."""
        lo, hi = self.offs[self.doc[at]], self.offs[self.doc[at] + 1]
        where = self.at[at][:, None] + np.arange(-REACH, GRAM + REACH)
        return np.where((where >= lo[:, None]) & (where < hi[:, None]), self.data[np.clip(where, 0, max(0, len(self.data) - 1))], 0).astype(np.uint8)

    def removed(self, answers: dict) -> tuple[np.ndarray, np.ndarray]:
        """Flags of removed bytes."""
        self.placed(answers)
        edge = np.zeros(len(self.data) + 1, np.int64)

        def cover(starts: np.ndarray, ends: np.ndarray) -> None:
            np.add.at(edge, starts, 1)
            np.add.at(edge, ends, -1)

        least = self.owner[self.rep]
        whole = (self.status[self.of] == 1) | (self.owner > least[self.of])
        whole &= self.left + self.right >= REACH
        cover(self.at[whole] - self.left[whole], self.at[whole] + GRAM + self.right[whole])
        masks = np.zeros(len(self.ask), U)
        for s, at in self.spread(self.h[self.ask]):
            masks[at] = unpack(answers[3, s])
        mask_of = np.zeros(len(self.rep), U)
        mask_of[self.status >= 16] = masks
        mine = np.flatnonzero((self.status[self.of] >= 16) & (self.owner == least[self.of]) & (mask_of[self.of] > 0))
        for j in range(REACH + 1):
            own = mine[(mask_of[self.of[mine]] >> U(j)) & U(1) == 1]
            own = own[(self.left[own] >= j) & (self.right[own] >= REACH - j)]
            cover(self.at[own] - j, self.at[own] - j + SPAN)
        if len(self.grams):
            known = np.empty(len(self.grams), U)
            for s, at in self.spread(self.grams):
                known[at] = np.frombuffer(answers[4, s], U)
            hit = known[np.searchsorted(self.grams, self.digest)] < self.gram_owner
            cover(self.gram_at[hit], self.gram_at[hit] + SPAN)
        return np.cumsum(edge)[:-1] > 0


def batches_of(docs: DataFrame) -> DataFrame:
    id_type = dict(docs.dtypes)["doc_id"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, ids, sizes, texts, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal k
            k += 1
            data = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
            offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            found, step = [np.zeros(0, np.int64)], 1 << 19
            lo = 0
            while lo < len(ids):
                hi = min(len(ids), max(lo + 1, int(np.searchsorted(offs, offs[lo] + step, "right")) - 1))
                found.append(anchors(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]) + offs[lo])
                lo = hi
            at = np.concatenate(found)
            text = zstandard.ZstdCompressor(level=3).compress(data.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([f"{part}-{k}"]), pa.array([ids]), pa.array([sizes], pa.list_(pa.int64())), pa.array([text], pa.binary()), pa.array([pack(np.diff(at, prepend=0))], pa.binary())], ["batch", "ids", "sizes", "text", "anchors"])

        for b in rows:
            numbers = b.column(0).to_pylist()
            for lo, hi, data, offs in tk.blocks(b.column(1)):
                ids += numbers[lo:hi]
                sizes += np.diff(offs).tolist()
                texts.append(data.copy())
                size += len(data)
                if size >= BATCH_BYTES:
                    yield flush()
                    ids, sizes, texts, size = [], [], [], 0
        if ids:
            yield flush()

    out = docs.select("doc_id", "text").mapInArrow(tk.freeing(run), f"batch string, ids array<{id_type}>, sizes array<bigint>, text binary, anchors binary")
    return bucketed(out, "batch", "texts", "uncompressed")


REQUEST = "share int, batch string, kind int, keys binary, values binary, owners binary"
ANSWER = "batch string, kind int, share int, answer binary"


def _request(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * 6
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["share", "batch", "kind", "keys", "values", "owners"])


def _answers(found: pa.Table) -> dict:
    return {(r["kind"], r["share"]): r["answer"] for r in found.to_pylist()}


def _sorted_pack(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=U(0)))


def _answer(group: pa.Table) -> pa.Table:
    """The answers of one share to all batches, by kind of request."""
    rows = group.to_pylist()
    out = []
    for kind in sorted({r["kind"] for r in rows}):
        own = [r for r in rows if r["kind"] == kind]
        if kind == 0:  # a batch's own note of its shared anchors, for the rounds to come
            out += [(r["batch"], kind, r["share"], r["keys"]) for r in own]
            continue
        keys = [np.cumsum(unpack(r["keys"]), dtype=U) for r in own]
        cuts = np.cumsum([0, *map(len, keys)])
        flat = np.concatenate(keys)
        if kind == 1:
            many = np.concatenate([np.unpackbits(np.frombuffer(r["values"], np.uint8), count=len(k)) for r, k in zip(own, keys, strict=True)])
            _, where, count = np.unique(flat, return_inverse=True, return_counts=True)
            hit = (np.bincount(where, many) + (count > 1) > 0)[where]
            got = [np.packbits(hit[a:z]).tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        elif kind == 2:
            body = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(r["values"]), U).reshape(2, -1) for r in own], 1)
            owners = np.concatenate([unpack(r["owners"]) for r in own])
            window, parts = body[0], body[1]
            # The least owner of each window.
            by = np.lexsort((owners, window, flat))
            new = np.concatenate([[True], (flat[by][1:] != flat[by][:-1]) | (window[by][1:] != window[by][:-1])])
            of = np.empty(len(by), np.int64)
            of[by] = np.cumsum(new) - 1
            least = owners[by[new]]
            status = np.where(owners > least[of], 1, 3).astype(np.uint8)
            # Different windows of an anchor that agree in a part.
            h, p = flat[by[new]], parts[by[new]]
            need = np.zeros(len(h), np.uint8)
            for k in range(len(PARTS)):
                part = (p >> U(16 * k)) & U(0xFFFF)
                o = np.lexsort((part, h))
                same = (h[o][1:] == h[o][:-1]) & (part[o][1:] == part[o][:-1])
                need[o[1:][same]] |= 1 << k
                need[o[:-1][same]] |= 1 << k
            _, inverse = np.unique(h, return_inverse=True)
            count = np.bincount(inverse, need > 0)[inverse] if len(h) else np.zeros(0)
            want = np.where(need > 0, np.where(count > HOT, 4, 16 + need), 3)
            status = np.where(status == 1, 1, want[of]).astype(np.uint8)
            got = [status[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        elif kind == 3:
            texts = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(r["values"]), np.uint8).reshape(-1, WIDE + 2) for r in own])
            owners = np.concatenate([unpack(r["owners"]) for r in own])
            masks = compared(flat, texts, owners)
            got = [pack(masks[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        else:
            owners = np.concatenate([unpack(r["owners"]) for r in own])
            by = np.lexsort((owners, flat))
            new = np.concatenate([[True], flat[by][1:] != flat[by][:-1]])
            of = np.empty(len(by), np.int64)
            of[by] = np.cumsum(new) - 1
            known = owners[by[new]][of]
            got = [known[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        out += [(r["batch"], kind, r["share"], x) for r, x in zip(own, got, strict=True)]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["batch", "kind", "share", "answer"])


def compared(keys: np.ndarray, windows: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """For each window (its bytes, then the bytes before and after the anchor), bit j is set if the string that begins
    j bytes before the anchor starts in a document of a smaller owner too.  Whole anchors go to one suffix array."""
    masks = np.zeros(len(keys), U)
    order = np.argsort(keys, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1], [True]]))
    lo = 0
    while lo < len(edges) - 1:
        hi = lo + 1
        while hi < len(edges) - 1 and (edges[hi + 1] - edges[lo]) * WIDE <= SA_BYTES:
            hi += 1
        _compare(order[edges[lo] : edges[hi]], windows, owners, masks)
        lo = hi
    return masks


def _compare(rows: np.ndarray, windows: np.ndarray, owners: np.ndarray, masks: np.ndarray) -> None:
    left, right = windows[rows, WIDE].astype(np.int64), windows[rows, WIDE + 1].astype(np.int64)
    size = left + GRAM + right
    total = int((size + 1).sum())
    start = np.cumsum(size + 1) - (size + 1)
    text = np.zeros(total, np.int64)
    cell = np.arange(WIDE)[None, :]
    inside = (cell >= REACH - left[:, None]) & (cell < REACH + GRAM + right[:, None])
    text[(start[:, None] + cell - (REACH - left[:, None]))[inside]] = windows[rows][:, :WIDE][inside].astype(np.int64) + 1
    owner_row = np.repeat(np.arange(len(rows)), size + 1)
    offset = np.arange(total) - start[owner_row]
    sa = suffix_array(text)
    sa = sa[offset[sa] + SPAN <= size[owner_row[sa]]]
    if len(sa) < 2:
        return
    same = np.ones(len(sa) - 1, bool)
    for k in range(SPAN):
        live = np.flatnonzero(same)
        same[live] = text[sa[live] + k] == text[sa[live + 1] + k]
    run = np.concatenate([[0], np.cumsum(~same)])
    own = owners[rows[owner_row[sa]]]
    least = np.minimum.reduceat(own, np.flatnonzero(np.concatenate([[True], ~same])))
    hit = sa[own > least[run]]
    r = owner_row[hit]
    np.bitwise_or.at(masks, rows[r], U(1) << (left[r] - offset[hit]).astype(U))


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    spark = docs.sparkSession
    id_type = dict(docs.dtypes)["doc_id"]
    shares = 4 * partitions(spark)
    texts = batches_of(docs)

    def first(state: pa.Table) -> pa.Table:
        b = Batch(state, shares)
        b.hashes()
        return _request([(s, b.name, 1, _sorted_pack(b.h1[at]), np.packbits(b.many[at]).tobytes(), b"") for s, at in b.spread(b.h1)])

    def second(state: pa.Table, found: pa.Table) -> pa.Table:
        b = Batch(state, shares)
        b.shared(_answers(found))
        rep = b.rep
        parts = sum(((p[rep] & U(0xFFFF)) << U(16 * k) for k, p in enumerate(b.parts_of(PARTS))), np.zeros(len(rep), U))
        zip_ = zstandard.ZstdCompressor(level=1)
        places = (zlib.crc32(b.name.encode()) % shares, b.name, 0, pack(np.diff(b.at, prepend=0)), b"", b"")
        return _request([places, *((s, b.name, 2, _sorted_pack(b.h[rep[at]]), zip_.compress(np.stack([b.window[rep[at]], parts[at]]).tobytes()), pack(b.owner[rep[at]])) for s, at in b.spread(b.h[rep]))])

    def third(state: pa.Table, found: pa.Table) -> pa.Table:
        answers = _answers(found)
        b = Batch(state, shares, answers)
        b.placed(answers)
        zip_ = zstandard.ZstdCompressor(level=3)
        out = []
        for s, at in b.spread(b.h[b.ask]):
            own = b.ask[at]
            body = np.concatenate([b.windows(own), b.ask_left[at, None].astype(np.uint8), b.ask_right[at, None].astype(np.uint8)], 1)
            out.append((s, b.name, 3, _sorted_pack(b.h[own]), zip_.compress(body.tobytes()), pack(b.owner[own])))
        out += [(s, b.name, 4, _sorted_pack(b.grams[at]), b"", pack(b.gram_least[at])) for s, at in b.spread(b.grams)]
        return _request(out)

    def final(state: pa.Table, found: pa.Table) -> pa.Table:
        answers = _answers(found)
        b = Batch(state, shares, answers)
        gone = b.removed(answers)
        n, runs, digest = [], [], []
        for lo, hi in zip(b.offs[:-1].tolist(), b.offs[1:].tolist(), strict=True):
            own = gone[lo:hi]
            n.append(int(own.sum()))
            runs.append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()) if n[-1] else 0)
            digest.append(hashlib.sha256(b.data[lo:hi][~own].tobytes() if n[-1] else b.data[lo:hi].tobytes()).hexdigest())
        return pa.table({"doc_id": state.column("ids")[0].values, "n_bytes": pa.array(np.diff(b.offs)), "n_removed": pa.array(n, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": digest})

    def answered(requests: DataFrame, label: str) -> DataFrame:
        return stored(requests.groupBy("share").applyInArrow(tk.freeing_group(_answer), ANSWER), label)

    def asked(f, answers: DataFrame, schema: str) -> DataFrame:
        return texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(tk.freeing_cogroup(f), schema)

    answers = answered(texts.groupBy("batch").applyInArrow(tk.freeing_group(first), REQUEST), "shared")
    answers = answers.unionByName(answered(asked(second, answers, REQUEST), "placed"))
    answers = answers.unionByName(answered(asked(third, answers, REQUEST), "compared"))
    return asked(final, answers, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that an earlier one has in strings of 50."""
    return deduplicated(table(spark, sf_dir, "documents"))


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
