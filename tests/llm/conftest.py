"""A small corpus with every awkward case, written as the tables that the queries read."""

import random

import pytest

WORDS = ["the", "of", "and", "to", "in", "is", "that", "for", "was", "on"]


def prose(rng: random.Random, n: int) -> str:
    word = lambda: rng.choice(WORDS) if rng.random() < 0.4 else "".join(rng.choice(["an", "er", "ti", "on", "sh", "ou", "le", "é"]) for _ in range(rng.randint(1, 4)))
    out = []
    for k in range(n):
        w = word()
        out.append(w.capitalize() + rng.choice(["", ".", ","]) if k % 9 == 0 else w)
    return "".join(w + (".\n" if i % 40 == 39 else " ") for i, w in enumerate(out)).strip()


def make_documents() -> list[tuple]:
    rng = random.Random(8)
    texts: list = [prose(rng, rng.randint(12, 160)) for _ in range(60)]
    base = texts[3].split(" ")
    near = [" ".join(w if k != i else "changed" for k, w in enumerate(base)) for i in (5, 20)]
    passage = prose(rng, 40)
    texts += [texts[3], texts[3].upper(), *near, texts[7] + " " + passage, passage + "\n" + texts[8], prose(rng, 4000), "one two three", "one two three", "One TWO three four", "aa " * 300, " \t\n", "", None, "x" * 60_000]
    texts += ["### $$$ " * 30 + texts[9], "mail a.b@mail.example.org or +49 (30) 1234567, 10.0.0.255 or 4111 1111 1111 1111 and 300.1.1.1", "a b c d\u0000e ﬀ 漢字 🙂 " * 6]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 2}", len(t or ""), i * 2, "x", None) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[10]]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, share long, batch string, node string"


@pytest.fixture(scope="session")
def documents():
    return make_documents()


@pytest.fixture(scope="session")
def corpus(spark, documents, tmp_path_factory):
    """Folder of documents (with extra, clashing columns), labels, benchmark and pages."""
    root = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(documents, COLUMNS).repartition(3).write.parquet(f"{root}/documents.parquet")
    labels = [(d[0], 0 if d[1] and d[1].startswith("###") or i % 10 == 0 else 1, 0) for i, d in enumerate(documents) if i % 2 == 0]
    spark.createDataFrame([*labels, (10**6, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    words = documents[66][1].split(" ")
    items = [(1, " ".join(words[100:130])), (2, " ".join([*words[300:324], "not", "there", "at", "all"])), (3, "one two three"), (4, ""), (5, None), (6, "never seen words of this item anywhere"), (7, documents[20][1][:90]), (8, "two"), (1, " ".join(words[100:130]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    page = "<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><div class=ad>Buy, now, this, very, long advert text</div><article><h1>A &amp; B</h1><p>First, one.<p>Second <b>bold</b> text.</article><div id='comments'><p>Nice, really, what a great post, thanks!</p></div></body></html>"
    pages = [(1, "http://www.a.example/x?b=1", page), (2, "http://a.example:80/x?b=1", page), (3, None, ""), (4, "https://b.example/", None), (5, "not a url [", "plain text only"), (6, "http://a.example/x?b=1", page + "é\r\n\r\nWARC/1.1\r\n"), (2, "http://a.example:80/x?b=1", page)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    return root


@pytest.fixture(scope="session")
def empty(spark, corpus, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{corpus}/{name}.parquet").limit(0).write.parquet(f"{root}/{name}.parquet")
    return root
