"""Every query of the subpackage against brute force over the awkward corpus, and over empty tables."""

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import decontamination, jaccard_join, mixing, pii, quality_rules, registry
from tessella.tables import stored

FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text, fold=True):
    raw = (text or "").encode()
    return (raw.translate(FOLD) if fold else raw).split()


def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def run(spark, root, name):
    return registry.queries()[name](spark, root).toPandas()


def test_quality_classifier(spark, corpus, documents):
    out = run(spark, corpus, "op1_quality_classifier")
    assert sorted(out["doc_id"]) == sorted(d[0] for d in documents)
    assert out["score"].between(0, 1).all()
    assert ((out["score"] >= 0.3).astype(int) == out["predicted"]).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(out["doc_id"], out["held_out"], strict=True))


def test_held_out_accuracy(spark, sf_dir):
    out = run(spark, sf_dir, "op1_quality_classifier").merge(spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas(), on="doc_id")
    held = out[out["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() >= 0.85


def base_counts(text):
    text = text or ""
    w = words(text, fold=False)
    lines = [x for x in text.encode().split(b"\n") if x.strip()]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality_rules(spark, corpus, documents):
    out = run(spark, corpus, "op2_quality_rules")
    got = Counter(tuple(r) for r in out[["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]].itertuples(index=False))
    want = Counter()
    for d in documents:
        c = base_counts(d[1])
        want[(d[0], *c, c[0] < 10 or 100 * c[4] > 20 * c[0])] += 1
    assert got == want
    assert not (out["base_failed"] & out["kept"]).any()


def test_quality_rules_reject_planted_outliers(spark):
    import random

    from tests.llm.conftest import prose

    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(40, 300)), "en", "s") for i in range(120)]
    rows += [(1000 + i, " ".join(w + "###" for w in prose(rng, 120).split()), "en", "s") for i in range(6)]
    out = quality_rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas()
    kept = dict(zip(out["doc_id"], out["kept"], strict=True))
    assert all(kept[i] for i in range(120)) and not any(kept[1000 + i] for i in range(6))


def test_quality_rules_against_plain_estimates(spark):
    """Concentration steps, reweighting and verdicts of two groups and of all, in numpy."""
    import random

    import numpy as np

    from tessella.llm import docstats
    from tests.llm.conftest import prose

    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(20, 300)) + " ###$" * rng.choice([0, 0, 0, 1, 4, 30]), "en", "ab"[i % 2] if i < 200 else "rare") for i in range(210)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = quality_rules.verdicts(docs).toPandas().set_index("doc_id")
    x = docstats.statistics(docs, ["doc_id", "source"]).select("doc_id", "source", *docstats.features(quality_rules.VECTOR)).toPandas()
    x = x[~x["doc_id"].map(out["base_failed"])]
    floors, d = np.array(docstats.spreads(quality_rules.VECTOR)), len(quality_rules.VECTOR)
    rank = lambda v, p: np.sort(v, axis=0)[math.ceil(p * len(v)) - 1]
    limit = quality_rules.chi2_quantile(0.975, d)
    shrink = lambda p, q: p / quality_rules.chi2_cdf(q, d + 2)

    def distances(v):
        mean = rank(v, 0.5)
        inverse, last = np.diag(1 / ((1.4826 * rank(abs(v - mean), 0.5)) ** 2 + floors**2)), None
        for k in range(9):
            far = np.einsum("ni,ij,nj->n", v - mean, inverse, v - mean)
            bound = rank(far, 0.75)
            final = k == 8 or (last is not None and abs(bound / last - 1) <= 0.01)
            own = v[far <= (limit if final else bound)]
            factor = shrink(0.975, limit) if final else shrink(0.75, quality_rules.chi2_quantile(0.75, d))
            mean, last = own.mean(0), bound
            inverse = np.linalg.inv(np.cov(own.T, bias=True) * factor + np.diag(floors**2))
            if final:
                return lambda w: np.einsum("ni,ij,nj->n", w - mean, inverse, w - mean)

    for of, judged in (("a", "a"), ("b", "b"), ("ab", "rare")):
        own = x[x["source"].isin(list(of) + (["rare"] if len(of) > 1 else []))][quality_rules.VECTOR].to_numpy()
        part = x[x["source"] == judged]
        want = distances(own)(part[quality_rules.VECTOR].to_numpy())
        got = out.loc[part["doc_id"]]
        assert np.allclose(got["distance2"], want, rtol=1e-6)
        assert (got["kept"] == (want <= quality_rules.chi2_quantile(0.99999, d))).all()
    assert 0 < (~out["kept"]).sum() < 100


def test_quality_rules_judge_rare_groups(spark):
    import random

    from tests.llm.conftest import prose

    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(40, 300)), "en", "s") for i in range(120)]
    for i, (lang, source) in enumerate([("en", "rare"), ("xx", "s"), (None, None)]):
        rows += [(1000 + i, prose(rng, 120), lang, source), (2000 + i, " ".join(w + "###" for w in prose(rng, 120).split()), lang, source)]
    out = quality_rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas()
    assert sorted(out["doc_id"]) == sorted(r[0] for r in rows) and out["distance2"].notna().all()
    kept = dict(zip(out["doc_id"], out["kept"], strict=True))
    assert all(kept[i] == (i < 2000) for i in kept)


def test_quality_stage_deals_no_documents_out(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = quality_rules.stage(spark, docs, corpus)
        assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
        kept = Counter(r["doc_id"] for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert out.schema == docs.schema
    verdict = run(spark, corpus, "op2_quality_rules")
    assert kept == Counter(verdict[verdict["kept"]]["doc_id"]) and 0 < sum(kept.values()) < docs.count()


def test_pii(spark, corpus, documents):
    patterns = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]
    checks = [lambda s: True, lambda s: all(int(x) <= 255 for x in s.split(".")), lambda s: 12 <= len(pii._digits(s)) <= 19 and pii.luhn(pii._digits(s)), lambda s: 9 <= len(pii._digits(s)) <= 15]
    out = run(spark, corpus, "op3_pii").drop_duplicates().set_index("doc_id")
    for d in documents:
        found = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(zip(patterns, checks, strict=True)) for m in p.finditer(d[1] or "") if ok(m[0]))
        text = ",".join(f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in found)
        r = out.loc[d[0]]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == i for x in found) for i in range(4)]
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))


def test_tagger_on_held_out_labels():
    model, right, wrong, every = pii.default_tagger(), Counter(), 0, Counter()
    for text, spans in pii.labelled_examples(120, seed=501):
        got = set(pii.model_spans(model, [text], [[]])[0])
        wrong += len(got - set(spans))
        right.update(k for _, k, _ in got & set(spans))
        every.update(k for _, k, _ in spans)
    assert len(every) == 4 and all(right[k] >= 0.9 * every[k] for k in every) and wrong <= 0.05 * sum(every.values())


def test_tagger_finds_what_patterns_find(sf_dir):
    """Documents, which the tagger has not seen, with the patterns taken away."""
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table(f"{sf_dir.replace('sf0.001', 'sf0.1')}/documents.parquet", columns=["text"]).column("text").to_pylist()[:4000]]
    found = pii.model_spans(pii.default_tagger(), texts, [[] for _ in texts])
    right, every, clean = Counter(), Counter(), 0
    for text, got in zip(texts, found, strict=True):
        base = pii.base_spans(text)
        every.update(k for _, k, _ in base)
        right.update(k for _, k, _ in set(base) & set(got))
        clean += bool(got and not base)
    assert len(every) == 4 and all(right[k] >= 0.9 * every[k] for k in every) and clean <= 0.001 * len(texts)


def test_decoding_of_overlapping_windows():
    """The reconciled scores by definition, and the best path among all paths."""
    import itertools

    import numpy as np

    model, rng = pii.Tagger(hidden=3, embed=2), np.random.default_rng(2)
    model.p["trans"] = rng.normal(0, 1, model.p["trans"].shape)
    scores = rng.normal(0, 1, (4, pii.TAGS))
    trans = model.p["trans"] + model.ban
    value = lambda y: sum(scores[k, c] for k, c in enumerate(y)) + sum(trans[a, b] for a, b in itertools.pairwise(y)) + (model.p["start"] + model.ban_start)[y[0]]
    assert tuple(model.viterbi(scores)) == max(itertools.product(range(pii.TAGS), repeat=4), key=value)
    model = pii.default_tagger()
    text = "call +49 171 5553344 now, or write to some.body7@post.example.com, card 4111 1111 1111 1111; " * 3
    (lo, hi), *more = pii.windows(text)
    assert not more and lo == 0 and hi >= len(text)
    starts = range(0, hi - pii.WINDOW + 1, pii.STRIDE)
    total, weight = np.zeros((hi, pii.TAGS)), np.zeros(hi)
    for s in starts:
        chars = np.zeros(pii.WINDOW, np.int64)
        chars[: len(text[s : s + pii.WINDOW])] = pii.codes(text[s : s + pii.WINDOW])
        for k, e in enumerate(model.emissions(chars[None])[0]):
            w = min(k + 1, pii.WINDOW - k)
            total[s + k] += w * e
            weight[s + k] += w
    tags = model.viterbi((total / weight[:, None])[: len(text)])
    spans = pii.model_spans(model, [text], [[]])[0]
    assert len(spans) >= 6 and all(tags[a] == 1 + 2 * k and (tags[a + 1 : z] == 2 + 2 * k).all() for a, k, z in spans)


def test_tagger_gradient():
    import numpy as np

    model, rng = pii.Tagger(hidden=3, embed=2), np.random.default_rng(0)
    x = rng.integers(1, 90, (2, 7))
    y = np.array([[0, 1, 2, 0, 0, 3, 4], [5, 6, 6, 0, 7, 8, 0]])

    def loss():
        scores = model.emissions(x)
        z = model.marginals(scores)[0]
        t = model.p["trans"] + model.ban
        gold = [sum(s[i, g[i]] for i in range(7)) + sum(t[a, b] for a, b in zip(g[:-1], g[1:], strict=True)) + model.p["start"][g[0]] for s, g in zip(scores, y, strict=True)]
        return (z - np.array(gold)).sum() / y.size

    grad = model.gradient(x, y)
    for name, at in (("Wf", (0, 1)), ("Ub", (1, 2)), ("out", (2, 3)), ("trans", (0, 1)), ("cb", (4,)), ("start", (5,))):
        old = model.p[name][at]
        model.p[name][at] = old + 1e-5
        up = loss()
        model.p[name][at] = old - 1e-5
        down = loss()
        model.p[name][at] = old
        assert abs((up - down) / 2e-5 - grad[name][at]) < 1e-6


def test_lm_scoring(spark, corpus, documents):
    out = run(spark, corpus, "op4_lm_scoring").drop_duplicates().set_index("doc_id")
    count = Counter()
    for d in documents:
        if zlib.crc32(str(d[0]).encode()) % 5 != 1:
            count.update([*words(d[1]), None])
    n, v = sum(count.values()), len(count)
    for d in documents:
        tokens, r = [*words(d[1]), None], out.loc[d[0]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(count[t] > 0 for t in tokens), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens), rel_tol=1e-9)
        assert r["score"] <= 0
    held = out[out["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()


def test_lm_scores_by_definition(spark, corpus, documents):
    """Counts, deleted estimates, their histogram and the mixture, in plain Python; the weights by the operator's EM."""
    import numpy as np

    from tessella.llm import lm_scoring

    out = run(spark, corpus, "op4_lm_scoring").drop_duplicates().set_index("doc_id")
    texts = [(d[0], [None, *words(d[1]), None]) for d in documents]
    one, two = Counter(), Counter()
    for i, t in texts:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            one.update(t[1:])
            two.update(zip(t[:-1], t[1:], strict=True))
    n, uniform = sum(one.values()), 1 / (len(one) + 1)
    cells = Counter()
    binned = lambda p: int(lm_scoring._binned(np.array([p]))[0])
    bucket = lambda c: min(c.bit_length(), lm_scoring.BUCKETS - 1)
    for (a, b), k in two.items():
        cells[bucket(one[a] - 1), binned((k - 1) / max(one[a] - 1, 1)), binned((one[b] - 1) / max(n - 1, 1))] += k
    value = lambda k: 0.0 if k < 0 else 2.0 ** (-k / lm_scoring.BINS)
    weights = lm_scoring.em([(b, value(p), value(q), k) for (b, p, q), k in cells.items()], uniform)
    for i, t in texts:
        want = 0.0
        for a, b in zip(t[:-1], t[1:], strict=True):
            w = weights[bucket(one[a])]
            want += math.log10(w[0] * two[a, b] / max(one[a], 1) + w[1] * one[b] / n + w[2] * uniform)
        assert math.isclose(out.loc[i, "score"], want, rel_tol=1e-9, abs_tol=1e-9)


def test_em_finds_the_likeliest_weights():
    import numpy as np

    from tessella.llm import lm_scoring

    rng = np.random.default_rng(1)
    p2, p1 = rng.random(40) * (rng.random(40) < 0.7), rng.random(40) * 0.1
    rows = [(3, a, b, int(k)) for a, b, k in zip(p2, p1, rng.integers(1, 20, 40), strict=True)]
    w = lm_scoring.em(rows, 0.001, rounds=2000)[3]
    likelihood = lambda w: sum(k * np.log(w[0] * a + w[1] * b + w[2] * 0.001) for _, a, b, k in rows)
    best = max((likelihood((x, y, 1 - x - y)) for x in np.linspace(0, 1, 101) for y in np.linspace(0, 1 - x, 101) if x + y < 1), default=0)
    assert likelihood(w) >= best - 1e-6 and w.sum() == pytest.approx(1)


def test_mixing(spark, corpus):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{corpus}/documents.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["op5_mixing"]).df()
    got = run(spark, corpus, "op5_mixing")
    key = lambda df: sorted(map(tuple, df[["doc_id", "n_tokens", "topic", "weight", "probability"]].values.tolist()))
    assert key(got) == key(want)
    factors = mixing.raked(mixing.cells_of(mixing.keyed(spark.read.parquet(f"{corpus}/documents.parquet")))).toPandas()
    assert (factors["factor"] >= 0).all()


def test_mixing_meets_every_target(spark):
    size = {("a", "x"): 600, ("a", "y"): 60, ("b", "x"): 40, ("b", "y"): 20}
    rows = [(f"{s}{l}{i}", "word " * 40, l, s, 1) for (s, l), n in size.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, n int")
    drawn = mixing.sampled(docs, topic=F.lit("t")).groupBy("source", "lang").agg(F.max("p").alias("p")).collect()
    given = {(r["source"], r["lang"]): r["p"] * size[r["source"], r["lang"]] for r in drawn}
    assert given[("b", "y")] == pytest.approx(20)  # its factor is the largest and sets the rate
    for k in (0, 1):
        held, got = Counter(), Counter()
        for cell in size:
            held[cell[k]] += size[cell]
            got[cell[k]] += given[cell]
        for m in held:
            assert got[m] / sum(got.values()) == pytest.approx(held[m] ** 0.7 / sum(n**0.7 for n in held.values()), abs=1e-9)
    assert mixing.stage(spark, docs, "").columns == docs.columns


def test_decontamination(spark, corpus, documents):
    items = [(r["item_id"], shingles(r["text"]), words(r["text"])) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    want = Counter()
    for d in documents:
        own, w = shingles(d[1]), words(d[1])
        for k, s, iw in items:
            shared = len(s & own) if len(iw) >= 5 else int(bool(iw) and any(w[i : i + len(iw)] == iw for i in range(len(w))))
            if s and 100 * shared >= 75 * len(s):
                want[(d[0], k, shared, len(s))] += 1
    got = run(spark, corpus, "op6_decontamination")
    assert Counter(map(tuple, got[["doc_id", "item_id", "n_shared", "n_item"]].values.tolist())) == want
    assert {3, 8} <= {k[1] for k in want} and 6 not in {k[1] for k in want}


def removed(documents):
    first, out = {}, {}
    for d in sorted(documents, key=lambda d: d[0]):
        raw = (d[1] or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - 49):
            if first.setdefault(raw[i : i + 50], d[0]) < d[0]:
                gone[i : i + 50] = [True] * 50
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d[0]] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out


def test_suffix_dedup(spark, corpus, documents, monkeypatch):
    from tessella.llm import suffix_dedup

    want = removed(documents)
    assert sum(x[1] for x in want.values()) > 1000
    for hot in (suffix_dedup.HOT, 0):  # with 0, every anchor takes the way of hot ones
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        answer = suffix_dedup._answer

        def limited(group, hot=hot, answer=answer):
            suffix_dedup.HOT = hot
            return answer(group)

        monkeypatch.setattr(suffix_dedup, "_answer", limited)
        out = run(spark, corpus, "op7_suffix_dedup")
        assert len(out) == len(documents)
        assert {r[0]: tuple(r[1:5]) for r in out[["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False)} == want
        monkeypatch.setattr(suffix_dedup, "_answer", answer)


def test_window_hashes_cost_two_sums_and_shared_anchors_are_not_sought_again(monkeypatch):
    import numpy as np
    import pyarrow as pa
    import zstandard

    from tessella.llm import suffix_dedup
    from tessella.llm.lm_scoring import pack

    rng = np.random.default_rng(11)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)  # runs across the edges of chunks
    passage = rng.integers(97, 103, 120)
    data = np.concatenate([rng.integers(97, 99, 700), passage, rng.integers(97, 99, 400), passage, passage[:70]]).astype(np.uint8)
    at = np.sort(rng.choice(np.arange(40, len(data) - 90), 400, replace=False))
    froms, tos = at[:, None] - rng.integers(0, 3, (400, 2)), at[:, None] + rng.integers(3, 5, (400, 2))
    got = suffix_dedup.run_hashes(data, at, froms, tos)
    cells = [(data[froms[i, k] : tos[i, k]].tobytes(), int(got[i, k])) for i in range(400) for k in (0, 1)]
    assert len(set(cells)) == len({x for x, _ in cells}) == len({x for _, x in cells}) > 20

    offs = np.array([0, 820, 1340, len(data)])
    found = suffix_dedup.anchors(data, offs)
    state = {"batch": ["b"], "ids": [[1, 2, 3]], "sizes": [np.diff(offs).tolist()], "text": [zstandard.ZstdCompressor().compress(data.tobytes())], "anchors": [pack(np.diff(found, prepend=0))]}
    state = pa.table({k: pa.array(v, pa.binary()) if k in ("text", "anchors") else v for k, v in state.items()})
    first = suffix_dedup.Batch(state, 1)
    first.hashes()
    many = first.many[np.searchsorted(first.h1, first.h)]
    first.shared({(1, 0): np.packbits(first.many).tobytes()})
    assert 0 < many.sum() < len(found) and (first.at == found[many]).all()
    monkeypatch.setattr(suffix_dedup.Batch, "hashes", None)  # later rounds read the anchors that the second one noted
    later = suffix_dedup.Batch(state, 1, {(0, 0): pack(np.diff(first.at, prepend=0))})
    later.shared({})
    assert all((getattr(first, k) == getattr(later, k)).all() for k in ("at", "doc", "h", "owner", "window", "rep", "of"))
    # Windows that the text's end cuts differ from those it does not.
    for a, b in zip(range(len(first.at)), range(1, len(first.at)), strict=False):
        text = lambda i: (first.left[i], first.right[i], data[first.at[i] - first.left[i] : first.at[i] + 16 + first.right[i]].tobytes())
        assert (first.window[a] == first.window[b]) == (text(a) == text(b))


def test_item_ids_of_any_type(spark, corpus):
    items, docs = spark.read.parquet(f"{corpus}/benchmark.parquet"), spark.read.parquet(f"{corpus}/documents.parquet")
    want = Counter((r["doc_id"], str(r["item_id"])) for r in decontamination.matches(docs, items).collect())
    for kind in ("int", "string"):
        got = decontamination.matches(docs, items.withColumn("item_id", F.col("item_id").cast(kind))).collect()
        assert Counter((r["doc_id"], str(r["item_id"])) for r in got) == want


def test_suffix_array():
    import numpy as np

    from tessella.llm.suffix_dedup import suffix_array

    rng = np.random.default_rng(3)
    for trial in range(60):
        text = rng.integers(1, 4, 120)
        text[rng.random(120) < 0.05] = 0
        text = np.append(np.tile(text, 1 + trial % 3), 0)
        order = suffix_array(text.astype(np.int64))
        string = bytes(text.tolist())
        keys = [string[i : string.index(0, i) + 1] for i in order]
        assert keys == sorted(keys) and sorted(order) == list(range(len(text)))


def test_html_extraction(spark, corpus):
    from tessella.llm.html_extraction import extract

    out = run(spark, corpus, "op8_html_extraction")
    text = {r["page_id"]: r["text"] for _, r in out.iterrows()}
    assert text[1] == text[2] == "A & B\n\nFirst, one.\n\nSecond bold text."
    assert text[3] == text[4] == "" and text[5] == "plain text only"
    assert (out["n_chars"] == out["text"].str.len()).all() and len(out) == 7
    layout = "<body><div class=menu><ul><li><a href=a>One</a></ul></div><div><h1>Head</h1><div class=body><p>A long first paragraph, with commas, and more words in it.</p><p>And a second one, also long enough to count for something.</p></div></div><div class='side sidebar'><p>Links, links, links, and more links to other things.</p></div><form><input><p>Send, us, a message, please, right now, today.</p></form>"
    assert extract(layout).endswith("And a second one, also long enough to count for something.") and "links" not in extract(layout) and "Send" not in extract(layout)
    assert extract("<p>a<br>b &lt;c&gt; <!-- x --> d<script>var a='</p>'</script>") == "a b <c> d"
    assert extract("<<<>>><p") != None  # noqa: E711


PROSE = "A paragraph of the story, with commas, long enough to count, and then some more words to it."


@pytest.mark.parametrize(
    "wrapper",
    ["class='content has-sidebar'", "id='page' class='no-sidebar'", "class='post-content share-enabled'", "class='page--with-sidebar'", "class='sidebar-left'", "class='header-sticky'", "id='cookie-recipes'"],
)
@pytest.mark.parametrize("inner", ["{}", "<article>{}</article>", "<main>{}</main>"])
def test_html_wrapper_names_cut_no_page(wrapper, inner):
    from tessella.llm.html_extraction import extract

    body = f"<h1>Head</h1><p>{PROSE}</p><div class='share'><p>Share, share, share this with friends!</p></div><p>{PROSE}</p>"
    page = f"<body><nav>Home</nav><div {wrapper}>{inner.format(body)}<div class='comments'><p>Nice, really, what a great post, thanks!</p></div></div></body>"
    assert extract(page) == f"Head\n\n{PROSE}\n\n{PROSE}"


def test_html_builder_widgets_are_kept_and_notices_cut():
    from tessella.llm.html_extraction import extract

    widget = "<div class='elementor-widget elementor-widget-text-editor'>{}</div>"
    assert extract("<body>" + widget.format(f"<p>{PROSE}</p>" * 2) + "</body>") == f"{PROSE}\n\n{PROSE}"
    assert extract("<body><div>" + widget.format(f"<p>{PROSE}</p>") * 3 + "</div></body>") == "\n\n".join([PROSE] * 3)
    more = "<article><p>A teaser, with commas, of another page, to be read next.</p></article>" * 2
    for kind in ("related", "sidebar", "comments"):
        assert extract(f"<body><div>{f'<p>{PROSE}</p>' * 3}</div><div class='{kind}'>{more}</div></body>") == "\n\n".join([PROSE] * 3)
        assert extract(f"<body><article><p>{PROSE}</p><p>{PROSE}</p><div class='{kind}'>{more}</div></article></body>") == f"{PROSE}\n\n{PROSE}"


def test_html_siblings_of_the_best_container():
    from tessella.llm.html_extraction import extract

    nine = "One, two, three, four, five, six, seven, eight, nine"  # 9 points
    twelve = "One, two, three, four, five, six, seven, eight, nine, ten, eleven, twelve"
    sections = f"<section><p>{twelve}</p></section><section><p>{nine}</p></section>"
    assert extract(f"<body><div>{sections}</div></body>") == f"{twelve}\n\n{nine}"
    links = "<ul><li><a href=a>Another page</a></li><li><a href=b>And one more</a></li></ul>"
    parts = ["<section><p>" + f"{twelve}, " * 3 + "</p></section>", "<h3>Steps</h3>", "<ul><li>Cut</li><li>Glue</li></ul>", "<section><p>" + f"{twelve}, " * 3 + "</p></section>", "<h4>Sizes</h4>", "<table><tr><td>Long</td><td>2</td></tr></table>", "<blockquote>As told</blockquote>"]
    page = f"<body><div>{links}{''.join(parts)}<h3>More to read</h3>{links}<div>Imprint</div></div></body>"
    text = extract(page)
    assert [x for x in text.split("\n\n") if not x.startswith("One")] == ["Steps", "Cut", "Glue", "Sizes", "Long", "2", "As told"] and text.count("One, two") == 6


@pytest.mark.parametrize("name", ["social-science", "research-notice-history", "share-prices", "widget-economics"])
def test_html_names_that_content_has_too(name):
    from tessella.llm.html_extraction import extract

    page = "<body><article><p>{0}</p><div class='{1}'><p>{0}</p></div><p>{0}</p></article></body>"
    assert extract(page.format(PROSE, name)) == "\n\n".join([PROSE] * 3)
    for box in ("social-links", "share-box", "search-form"):
        assert extract(page.format(PROSE, box)) == "\n\n".join([PROSE] * 2)
    links = f"<body><article><p>{PROSE}</p><div class='{name}'><a href=a>Another page of this site</a></div></article></body>"
    assert extract(links) == PROSE


def test_html_links_beside_the_best_container_in_an_article():
    from tessella.llm.html_extraction import extract

    links = "<ul><li><a href=a>Another page</a></li><li><a href=b>And one more</a></li></ul>"
    page = f"<body><article><header><h1>Head</h1><p>By Jo</p></header>Own text<div><p>{PROSE}</p><p>{PROSE}</p></div><section>Short</section>{links}</article></body>"
    assert extract(page) == f"Head\n\nBy Jo\n\nOwn text\n\n{PROSE}\n\n{PROSE}\n\nShort"


@pytest.mark.parametrize("part", ["<div>x ", "<foo><a>x ", "<div class=share>x, y ", "<p><b>x </i>", "<section><h2>x</section></div>"])
def test_html_takes_linear_time_in_depth(part):
    from tessella.llm.html_extraction import extract

    start = time.time()
    extract(part * 100_000)
    assert time.time() - start < 20


@pytest.mark.parametrize("seed", range(40))
def test_html_round_trip_of_made_pages(seed):
    from tessella.llm.html_extraction import extract

    rng = random.Random(seed)
    words = lambda n: " ".join(rng.choice(("alpha", "beta,", "gamma", "delta &", "<eps>", "zeta", "eta,", "theta")) for _ in range(n))
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(" ", rng.choice((" ", "\n  ")))
    want, body = [], []
    for _ in range(rng.randrange(3, 12)):
        text = words(rng.randrange(12, 60))
        want.append(text)
        body.append(f"<p>{escape(text)}" + rng.choice(("</p>", "")))
        if rng.random() < 0.3:
            rows = [words(rng.randrange(1, 6)) for _ in range(3)]
            want += rows
            body.append("<ul>" + "".join(f"<li>{escape(t)}" + rng.choice(("</li>", "")) for t in rows) + "</ul>")
        if rng.random() < 0.3:
            body.append(rng.choice(("<div class='ad'>Buy, buy, buy this, now, or never at all!</div>", "<aside><p>Not this, and not that, either way.</p></aside>", "<script>var p = '<p>no</p>';</script>", "<div class='share-buttons'><a href=x>Share</a></div>", "<!-- <p>no</p> -->")))
    inner = "".join(body)
    inner = rng.choice(("<article>{}</article>", "<div class='post'>{}</div>", "<main><div>{}</div></main>", "<div><div>{}</div></div>")).format(inner)
    page = f"<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav>{inner}<div class='comments'><p>{'Great, really, ' * 9}</p></div><footer><p>Imprint, terms, and so on, all rights held.</p></footer></body></html>"
    assert extract(page).split("\n\n") == want


def test_warc(spark, corpus):
    from tessella.llm import warc

    pages = spark.read.parquet(f"{corpus}/pages.parquet")
    rows = pages.collect()
    first = {}
    for r in rows:
        first[r["html"] or ""] = max(first.get(r["html"] or "", r["page_id"]), r["page_id"])
    want = Counter()
    for r in rows:
        raw = (r["html"] or "").encode()
        original = first[r["html"] or ""]
        want[(r["page_id"], len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if original == r["page_id"] else "revisit", None if original == r["page_id"] else original)] += 1
    out = [tuple(r) for r in registry.queries()["op9_warc"](spark, corpus).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert Counter(out) == want
    path = warc.write_archives(pages)
    index = warc.build_index(warc.read_archives(spark, path), per_block=2)
    found = warc.lookup(spark, index, "http://www.a.example/x?b=1")
    found = list(found)
    assert sorted(c["page_id"] for c, _ in found) == [1, 2, 2, 6]
    for capture, record in found:
        (_, length, head, body), = warc.parse(record)
        assert length == capture["length"] and int(head["X-Page-Id"]) == capture["page_id"]
        assert capture["record_type"] == "revisit" or warc.digest_of(body) == capture["payload_digest"]
    assert list(warc.lookup(spark, index, "http://nowhere.example/")) == []
    small = [r["record_type"] for r in warc.read_archives(spark, warc.write_archives(pages, min_bytes=10**6)).collect()]
    assert set(small) == {"response"}


@pytest.mark.parametrize("per_block", [1, 3, 50])
def test_warc_lookup_finds_every_capture_by_binary_search(spark, per_block):
    from tessella.llm import warc

    rng = random.Random(per_block)
    hosts = ["a.example", "b.example", "a.b.example", "é.example", ""]
    urls = ["http://hot.example/" for _ in range(40)] + [f"http://{rng.choice(hosts)}/{rng.choice('xyz') * rng.randrange(9)}?q={rng.randrange(9)}" for _ in range(80)] + ["", "http://long.example/" + "p" * 20_000]
    pages = spark.createDataFrame([(k, u, f"<p>{k}") for k, u in enumerate(urls)], "page_id long, url string, html string").repartition(3)
    index = warc.build_index(warc.read_archives(spark, warc.write_archives(pages)), per_block=per_block)
    want = defaultdict(list)
    for k, u in enumerate(urls):
        want[warc.surt(u)].append(k)
    lines = warc.index_lines(spark, index)
    assert sorted(r["page_id"] for r in lines.select("page_id").collect()) == list(range(len(urls)))
    for u in {*urls[::5], urls[0], urls[-2], urls[-1], "http://hot.example/a", "http://zzz.zz/", "http://0/"}:
        found = list(warc.lookup(spark, index, u))
        assert sorted(c["page_id"] for c, _ in found) == want[warc.surt(u)], u
        for c, record in found:
            (_, _, head, body), = warc.parse(record)
            assert int(head["X-Page-Id"]) == c["page_id"] and body == f"<p>{c['page_id']}".encode()


def test_warc_index_of_nothing(spark):
    from tessella.llm import warc

    index = warc.build_index(spark.createDataFrame([], warc.FIELDS))
    assert list(warc.lookup(spark, index, "http://a.example/")) == [] and warc.index_lines(spark, index).count() == 0


def components(documents):
    sets = [(d[0], shingles(d[1])) for d in documents]
    holders, parent = defaultdict(list), {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for k, (i, s) in enumerate(sets):
        find(i)
        for j, n in Counter(j for x in s for j in holders[x]).items():
            if 100 * n >= 75 * (len(s) + len(sets[j][1]) - n):
                a, b = sorted((find(i), find(sets[j][0])))
                parent[b] = a
        for x in s:
            holders[x].append(k)
    return {i: (len(s), find(i)) for i, s in sets}


def test_jaccard_join(spark, corpus, documents):
    out = run(spark, corpus, "op10_jaccard_join")
    assert len(out) == len(documents)
    assert {r[0]: (r[1], r[2]) for r in out[["doc_id", "n_shingles", "component_id"]].itertuples(index=False)} == components(documents)


def test_jaccard_join_chains(spark):
    """Links that only lead through members that are not a list's centre."""
    import random

    rng = random.Random(4)
    rows = []
    for c in range(12):
        text = [f"w{c}x{k}" for k in range(60)]
        for step in range(8):
            rows.append((100 * c + step, " ".join(text), None, None, 0, 0, "", ""))
            for _ in range(1 + c % 3):
                text[rng.randrange(60)] = f"n{c}y{step}z{rng.randrange(999)}"
    from tests.llm.conftest import COLUMNS

    out = jaccard_join.components(spark.createDataFrame(rows, COLUMNS)).toPandas()
    assert {r[0]: (r[1], r[2]) for r in out.itertuples(index=False)} == components(rows)


def test_jaccard_join_of_a_large_group_of_near_copies(spark):
    """Copies around the threshold: some linked, some not, many through others only; a passage that all share."""
    import random

    from tests.llm.conftest import COLUMNS

    rng = random.Random(11)
    base, rows = [f"w{k}" for k in range(120)], []
    for i in range(150):
        text = list(base)
        for _ in range(rng.randint(1, 8)):
            text[rng.randrange(120)] = f"n{rng.randrange(40)}"
        rows.append((i, " ".join(text), None, None, 0, 0, "", ""))
    rows += [(200 + i, " ".join(base[:40] + [f"own{i}x{k}" for k in range(30)]), None, None, 0, 0, "", "") for i in range(30)]
    rows += [(300 + i, " ".join(base[:40] + [f"own{i // 2}y{k}" for k in range(8 + i % 2)]), None, None, 0, 0, "", "") for i in range(30)]
    want = components(rows)
    assert len({c for _, c in want.values()}) > 40
    out = jaccard_join.components(spark.createDataFrame(rows, COLUMNS).repartition(5)).toPandas()
    assert {r[0]: (r[1], r[2]) for r in out.itertuples(index=False)} == want


def test_jaccard_stage_keeps_unlike_texts_of_one_id(spark):
    texts = [" ".join(f"{c}{k}" for k in range(30)) for c in "abc"]
    rows = [(5, texts[0]), (5, texts[1]), (6, texts[2]), (None, texts[2]), (None, texts[0] + " more"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in jaccard_join.stage(spark, docs, "").collect())
    assert got == Counter([rows[0], rows[1], rows[2], rows[5], rows[6]])


def test_pipeline(spark, corpus, documents):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, corpus), name)
        assert docs.columns == before.columns
        old, new = ({r["doc_id"]: r for r in x.collect()} for x in (before, docs))
        if name == "quality_rules":
            verdict = run(spark, corpus, "op2_quality_rules")
            assert set(new) == set(verdict[verdict["kept"]]["doc_id"])
        elif name == "jaccard_join":
            found = components([(i, r["text"]) for i, r in old.items()])
            assert set(new) == {i for i in old if found[i][1] == i} and docs.count() == len(new)
        elif name == "decontamination":
            items = spark.read.parquet(f"{corpus}/benchmark.parquet")
            assert set(new) == set(old) - {r["doc_id"] for r in decontamination.matches(before, items).collect()}
        elif name == "pii":
            assert set(new) == set(old) and all(not pii.base_spans(r["text"] or "") for r in new.values())
            assert all(r["text"] == old[i]["text"] for i, r in new.items() if not any(c in (old[i]["text"] or "") for c in "0123456789@"))
        else:
            assert set(new) == {r["id"] for r in mixing.sampled(before).collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, corpus).collect()} == set(new)


def test_stages_judge_rows_and_not_ids(spark, corpus, documents):
    good, item = documents[5][1], spark.read.parquet(f"{corpus}/benchmark.parquet").where("item_id = 1").first()["text"]
    texts = [good, documents[6][1], "too short", f"{documents[9][1]} {item}", documents[7][1], "short too", f"{documents[11][1]} {item}"]
    docs = spark.createDataFrame([(None if i < 4 else 1, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    kept = lambda stage: Counter((r["doc_id"], r["text"]) for r in stage(spark, docs, corpus).collect())
    ids = [None] * 4 + [1] * 3
    assert kept(quality_rules.stage) == Counter((ids[k], texts[k]) for k in (0, 1, 3, 4, 6))
    assert kept(decontamination.stage) == Counter((ids[k], texts[k]) for k in (0, 1, 2, 4, 5))


@pytest.mark.parametrize("name", [*registry.queries(), "pipeline"])
def test_empty_tables(spark, empty, name):
    query = corpus_pipeline.run if name == "pipeline" else registry.queries()[name]
    assert query(spark, empty).count() == 0
