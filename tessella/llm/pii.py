"""Personal data: plain patterns, and a character-level bidirectional LSTM with CRF transitions that adds to them.

The model is written and trained in numpy from labelled spans (``train`` takes any; ``labelled_examples`` makes them
from a seed: writings of each kind, patterned and not, between words, and look-alikes that are none).  All four kinds
hold a digit or an at sign, so characters far from any of these are outside every span by definition; the text around
them is cut into overlapping windows on a fixed grid.  Each window's emissions are computed on their own, reconciled by
weights that favour a window's middle, and one Viterbi pass decodes each run of windows as a whole.  A decoded span
counts if it is likelier than not on average, it has its kind's form (a card's digits pass Luhn, ...), and no pattern's
span overlaps it.

Null and empty texts have no spans.  Equal starts are ordered by kind (email, ip, card, phone).  Repeated rows are
treated alike.  A document is one unit of work; patterns take time in proportion to its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessella.llm.textkit import release
from tessella.tables import table

KINDS = ["email", "ip", "card", "phone"]
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
WINDOW, STRIDE, MARGIN = 96, 48, 24
CONFIDENT = 0.5

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns, leftmost and not overlapping within a kind, in order."""
    out, end, floor = [], 0, 0
    at = text.find("@")
    while at >= 0:
        low = max(end, floor)
        local = at - low - len(text[low:at].rstrip(_LOCAL)) if low < at else 0
        m = _DOMAIN.match(text, at) if local else None
        if m:
            end = m.end()
            out.append((at - local, 0, end))
        floor = at + 1
        at = text.find("@", max(end, floor))
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _octets(m[0])]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def codes(text: str) -> np.ndarray:
    """0 padding, printable ASCII, then one code each for new lines, other letters and the rest."""
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    out = np.where((raw >= 32) & (raw < 127), raw - 31, np.where(raw >= 0xC0, 97, 98))
    out[raw == 10] = 96
    return out


ALPHABET = 99


class Tagger:
    """Embedding, two LSTM directions, a linear layer to tag scores, and CRF start and transition scores."""

    def __init__(self, hidden: int = 20, embed: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.h = hidden
        self.p = {"E": rng.normal(0, 0.5, (ALPHABET, embed)), "out": draw(2 * hidden, TAGS), "ob": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS)), "start": np.zeros(TAGS)}
        for d in "fb":
            self.p |= {f"W{d}": draw(embed, 4 * hidden), f"U{d}": draw(hidden, 4 * hidden), f"c{d}": np.concatenate([np.ones(hidden), np.zeros(3 * hidden)])}
        allowed = np.zeros((TAGS, TAGS), bool)
        allowed[:, 0] = allowed[:, 1::2] = True
        for k in range(len(KINDS)):
            allowed[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
        self.ban = np.where(allowed, 0.0, -1e4)
        self.ban_start = np.where(np.arange(TAGS) % 2 == 1, 0.0, -1e4)
        self.ban_start[0] = 0

    def _lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        h, n = self.h, len(x)
        pre = x @ self.p[f"W{d}"] + self.p[f"c{d}"]
        state, cell, out, tape = np.zeros((n, h)), np.zeros((n, h)), np.empty((n, x.shape[1], h)), []
        for t in range(x.shape[1]):
            z = pre[:, t] + state @ self.p[f"U{d}"]
            s = 1 / (1 + np.exp(-z[:, : 3 * h]))
            f, i, o, g = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :], np.tanh(z[:, 3 * h :])
            before, old = cell, state
            cell = f * cell + i * g
            tc = np.tanh(cell)
            state = o * tc
            out[:, t] = state
            tape.append((f, i, o, g, before, tc, old))
        return out, tape

    def _lstm_back(self, x: np.ndarray, d: str, tape: list, dout: np.ndarray, grad: dict) -> np.ndarray:
        h = self.h
        dz = np.empty((*x.shape[:2], 4 * h))
        dstate, dcell = np.zeros_like(dout[:, 0]), np.zeros_like(dout[:, 0])
        gu = np.zeros_like(self.p[f"U{d}"])
        for t in reversed(range(x.shape[1])):
            f, i, o, g, before, tc, old = tape[t]
            dstate = dstate + dout[:, t]
            dcell = dcell + dstate * o * (1 - tc * tc)
            z = np.concatenate([dcell * before * f * (1 - f), dcell * g * i * (1 - i), dstate * tc * o * (1 - o), dcell * i * (1 - g * g)], 1)
            dz[:, t] = z
            gu += old.T @ z
            dstate, dcell = z @ self.p[f"U{d}"].T, dcell * f
        flat = dz.reshape(-1, 4 * h)
        grad[f"U{d}"], grad[f"W{d}"], grad[f"c{d}"] = gu, x.reshape(-1, x.shape[2]).T @ flat, flat.sum(0)
        return dz @ self.p[f"W{d}"].T

    def emissions(self, chars: np.ndarray) -> np.ndarray:
        """Tag scores of each character of equally long windows."""
        x = self.p["E"][chars]
        both = np.concatenate([self._lstm(x, "f")[0], self._lstm(x[:, ::-1], "b")[0][:, ::-1]], 2)
        return both @ self.p["out"] + self.p["ob"]

    def marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log partition, tag marginals, expected transitions) of a batch of score sequences."""
        trans = self.p["trans"] + self.ban
        n, length, _ = scores.shape
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)

        def lse(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis, keepdims=True)
            return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

        alpha[:, 0] = scores[:, 0] + self.p["start"] + self.ban_start
        for t in range(1, length):
            alpha[:, t] = scores[:, t] + lse(alpha[:, t - 1, :, None] + trans, 1)
        for t in reversed(range(length - 1)):
            beta[:, t] = lse(trans + (scores[:, t + 1] + beta[:, t + 1])[:, None], 2)
        z = lse(alpha[:, -1], 1)
        tags = np.exp(np.minimum(alpha + beta - z[:, None, None], 0))
        moves = np.zeros((TAGS, TAGS))
        for t in range(1, length):
            moves += np.exp(np.minimum(alpha[:, t - 1, :, None] + trans + (scores[:, t] + beta[:, t])[:, None] - z[:, None, None], 0)).sum(0)
        return z, tags, moves

    def gradient(self, chars: np.ndarray, gold: np.ndarray) -> dict:
        """Of the mean negative log-likelihood a character."""
        grad: dict[str, np.ndarray] = {}
        x = self.p["E"][chars]
        forth, tape_f = self._lstm(x, "f")
        back, tape_b = self._lstm(x[:, ::-1], "b")
        both = np.concatenate([forth, back[:, ::-1]], 2)
        scores = both @ self.p["out"] + self.p["ob"]
        _, tags, moves = self.marginals(scores)
        hot = np.eye(TAGS)[gold]
        d = (tags - hot) / gold.size
        real = np.zeros((TAGS, TAGS))
        np.add.at(real, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        grad["trans"], grad["start"] = (moves - real) / gold.size, d[:, 0].sum(0)
        flat = d.reshape(-1, TAGS)
        grad["out"], grad["ob"] = both.reshape(-1, 2 * self.h).T @ flat, flat.sum(0)
        dboth = d @ self.p["out"].T
        dx = self._lstm_back(x, "f", tape_f, dboth[:, :, : self.h], grad)
        dx = dx + self._lstm_back(x[:, ::-1], "b", tape_b, dboth[:, ::-1, self.h :], grad)[:, ::-1]
        grad["E"] = np.zeros_like(self.p["E"])
        np.add.at(grad["E"], chars.ravel(), dx.reshape(-1, dx.shape[2]))
        return grad

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """Best tags of one sequence."""
        trans = self.p["trans"] + self.ban
        best, back = scores[0] + self.p["start"] + self.ban_start, np.zeros(scores.shape, np.int8)
        for t in range(1, len(scores)):
            reach = best[:, None] + trans
            back[t] = reach.argmax(0)
            best = reach[back[t], np.arange(TAGS)] + scores[t]
        tags = np.empty(len(scores), np.int64)
        tags[-1] = best.argmax()
        for t in range(len(scores) - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags


def train(examples: list[tuple[str, list[tuple[int, int, int]]]], steps: int = 1400, batch: int = 32, length: int = 48, seed: int = 11) -> Tagger:
    """Adam over random windows of labelled texts; spans are (start, kind, end)."""
    model, rng = Tagger(), np.random.default_rng(seed)
    chars, gold = [], []
    for text, spans in examples:
        c, g = codes(text), np.zeros(len(text), np.int64)
        for a, k, z in spans:
            g[a], g[a + 1 : z] = 1 + 2 * k, 2 + 2 * k
        lack = max(0, length - len(c))
        chars.append(np.concatenate([c, np.zeros(lack, np.int64)]))
        gold.append(np.concatenate([g, np.zeros(lack, np.int64)]))
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(chars), batch)
        at = [int(rng.integers(0, len(chars[r]) - length + 1)) for r in rows]
        x, y = (np.stack([src[r][i : i + length] for r, i in zip(rows, at, strict=True)]) for src in (chars, gold))
        cut = y[:, 0] % 2 == 0  # a window that begins within a span
        y[:, 0] = np.where(cut & (y[:, 0] > 0), y[:, 0] - 1, y[:, 0])
        grad = model.gradient(x, y)
        rate = 0.04 * min(1, step / 20) * (0.1 if step > 0.8 * steps else 1)
        for k, g in grad.items():
            g = np.clip(g, -1, 1)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            model.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def labelled_examples(n: int = 1500, seed: int = 3) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled texts from a seed: each kind in several writings, and look-alikes without a label."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda k: "".join(pick("0123456789") for _ in range(k))
    syllables = ["the", "on", "er", "an", "re", "ti", "en", "ou", "é", "que", "mente", "lich", "ció", "ß", "st", "ha", "nd"]
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 5))))

    def card() -> str:
        body = pick("34560123456789") + digits(14)
        body += next(d for d in "0123456789" if luhn(body + d))
        sep = pick(["", "", " ", "-", "."])
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        at = pick(["@", "@", "@", " @ ", "@ "])
        return word() .replace("é", "e").replace("ß", "s").replace("ó", "o") + pick(["", ".", "_", "-"]) + pick(["ab", "x", digits(2), digits(2), digits(1)]) + at + pick(["mail", "post", "example", "corp"]) + pick(["", "", digits(1)]) + pick(["", ".example", ".site"]) + pick([".com", ".org", ".net", ".co.uk", ".de"])

    def phone() -> str:
        return pick([
            f"+{digits(2)} {digits(3)} {digits(7)}", f"+1-{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(2)} ({digits(2)}) {digits(4)} {digits(4)}", f"+{digits(11)}", f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}",
            f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(3)} {digits(7)}", f"0{digits(2)}/{digits(7)}",
        ])

    def ip() -> str:
        return ".".join(str(int(rng.integers(256))) for _ in range(4))

    def none() -> str:
        return pick([
            digits(4), digits(int(rng.integers(1, 9))), digits(int(rng.integers(17, 30))), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"{digits(2)},{digits(3)}.{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(2)}",
            "".join(pick("0123456789abcdef") for _ in range(int(rng.integers(16, 48)))), "AKIA" + "".join(pick("ABCDEFGHIJKLMNOP0123456789") for _ in range(16)), "@" + word(), word() + "@", f"{word()}{digits(3)}", "sk_" + digits(20), f"{digits(3)} {digits(3)}", f"p. {digits(3)}-{digits(3)}", f"{digits(4)}/{digits(2)}",
        ])

    makers = [email, ip, card, phone]
    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < 110:
            r = rng.random()
            if r < 0.3:
                k = int(rng.choice(4, p=(0.2, 0.2, 0.4, 0.2)))
                piece = makers[k]()
                spans.append((len(text), k, len(text) + len(piece)))
            else:
                piece = none() if r < 0.5 else word() + pick(["", "", ",", "."])
            text += piece + pick([" ", " ", " ", "\n", ", ", ". ", ".\n", " | ", "*** ", "### "])
        out.append((text, spans))
    return out


@lru_cache(maxsize=2)
def default_tagger(seed: int = 3) -> Tagger:
    model = train(labelled_examples(seed=seed))
    release()
    return model


def windows(text: str) -> list[tuple[int, int]]:
    """Runs (start, end) of grid windows around triggers; a run's length is a multiple of the stride."""
    runs: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        lo = max(0, (m.start() - MARGIN) // STRIDE * STRIDE)
        hi = (m.start() + MARGIN) // STRIDE * STRIDE + STRIDE
        hi = max(hi, lo + WINDOW)
        if runs and lo <= runs[-1][1]:
            if hi > runs[-1][1]:
                runs[-1] = (runs[-1][0], hi)
        else:
            runs.append((lo, hi))
    return runs


_TAPER = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(float)


def _well_formed(kind: int, piece: str) -> bool:
    d = _digits(piece)
    if kind == 0:
        name, _, host = piece.partition("@")
        return bool(name.strip() and "." in host.strip(" .") and "\n" not in piece and " " not in name.strip() and " " not in host.strip())
    if any(c.isalpha() for c in piece) or "\n" in piece:
        return False
    if kind == 1:
        return piece.count(".") == 3 and all(p.isascii() and p.isdigit() for p in piece.split(".")) and _octets(piece)
    return (12 <= len(d) <= 19 and luhn(d)) if kind == 2 else 9 <= len(d) <= 15


def model_spans(model: Tagger, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """The spans that the model adds to the patterns' in each text."""
    where, pieces = [], []
    for i, text in enumerate(texts):
        for lo, hi in windows(text):
            starts = range(lo, hi - WINDOW + 1, STRIDE)
            where.append((i, lo, hi, len(pieces), len(starts)))
            pieces += [text[s : s + WINDOW] for s in starts]
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not pieces:
        return added
    grid = np.zeros((len(pieces), WINDOW), np.int64)
    for r, piece in enumerate(pieces):
        grid[r, : len(piece)] = codes(piece)
    scores = np.concatenate([model.emissions(grid[k : k + 512]) for k in range(0, len(grid), 512)])
    for i, lo, hi, first, n in where:
        text = texts[i]
        total, weight = np.zeros((hi - lo, TAGS)), np.zeros(hi - lo)
        for k in range(n):
            part = slice(k * STRIDE, k * STRIDE + WINDOW)
            total[part] += scores[first + k] * _TAPER[:, None]
            weight[part] += _TAPER
        length = min(hi, len(text)) - lo
        merged = (total / weight[:, None])[:length]
        tags = model.viterbi(merged)
        if not tags.any():
            continue
        probability = model.marginals(merged[None])[1][0][np.arange(length), tags]
        begins = np.flatnonzero(tags % 2 == 1)
        for a in begins:
            z = a + 1
            while z < length and tags[z] == tags[a] + 1:
                z += 1
            kind, start, end = int(tags[a] - 1) // 2, lo + int(a), lo + int(z)
            while end > start and not text[end - 1].isalnum():
                end -= 1
            if probability[a:z].mean() >= CONFIDENT and _well_formed(kind, text[start:end]) and all(end <= b or start >= e for b, _, e in base[i]):
                added[i].append((start, kind, end))
    return added


def _found(texts: list[str], model: Tagger) -> tuple[list, list]:
    """(pattern spans, all spans) of each text."""
    base = [base_spans(t) if _TRIGGER.search(t) else [] for t in texts]
    more = model_spans(model, texts, base)
    return base, [sorted(b + m) if m else b for b, m in zip(base, more, strict=True)]


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind and digest of the patterns' spans, all spans, and how many these are."""
    model, id_type = default_tagger(), dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                base, every = _found([t or "" for t in part.column(1).to_pylist()], model)
                counts = [pa.array([sum(k == kind for _, k, _ in x) for x in base], pa.int64()) for kind in range(4)]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base]), pa.array([joined(x) for x in every]), pa.array(map(len, every), pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def masked(text: str, found: list[tuple[int, int, int]]) -> str:
    """Every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for a, k, z in found:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, z)
    return "".join([*out, text[at:]])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data masked; n_chars, if there, follows the text."""
    model, names = default_tagger(), docs.columns
    place, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    kind = docs.schema["n_chars"].dataType.simpleString() if chars is not None else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                given = part.column(place).to_pylist()
                _, every = _found([t or "" for t in given], model)
                cols = list(part.columns)
                hit = [k for k, x in enumerate(every) if x]
                if hit:
                    for k in hit:
                        given[k] = masked(given[k], every[k])
                    cols[place] = pa.array(given, pa.string())
                    if chars is not None:
                        sizes = cols[chars].to_pylist()
                        for k in hit:
                            sizes[k] = len(given[k])
                        cols[chars] = pa.array(sizes, pa.int64() if kind == "bigint" else pa.int32())
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, docs.schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return spans(table(spark, sf_dir, "documents"))


QUERIES = {"op3_pii": op3_pii}
