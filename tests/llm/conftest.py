import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

WORDS = [a + b for a in "ba de fi go lu mi no pa re su ta vo".split() for b in "k l m n r s t".split()]
BAD = "idiot scum trash moron clown".split()


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def prose(r, words):
    out = []
    while words > 0:
        out.append(" ".join(sentence(r, r.randint(4, 14)) for _ in range(r.randint(2, 6))))
        words -= len(out[-1].split())
    return "\n".join(out)


@pytest.fixture(scope="session")
def corpus(tmp_path_factory):
    """Documents of all kinds: clean, near copies, copies, shared passages, junk, toxic, null, empty, very long, short."""
    r = random.Random(5)
    texts = [prose(r, r.randint(30, 220)) for _ in range(150)]
    base = texts[0].split(" ")
    for k in range(25):  # near copies, some just below the threshold
        w = list(base)
        for _ in range(1 + k % 7):
            w[r.randrange(len(w))] = "x" + str(k)
        texts.append(" ".join(w))
    texts += [texts[3]] * 6 + [texts[5].upper()] * 2
    passage = prose(r, 120)[:700]
    texts += [f"{prose(r, 40)}\n{passage}\n{prose(r, 30)}" for _ in range(12)]
    texts += [passage[:399], passage[:400], passage[:401], "é" * 500, "é" * 450 + "x"]
    texts += [" ".join(x + r.choice(["***", "$$$", "%%%"]) for x in prose(r, 90).split()) for _ in range(30)]
    texts += [" ".join(r.sample(prose(r, 60).split(), 50) + r.choices(BAD, k=6)) for _ in range(40)]
    texts += ["Orre " * 400, "a" * 3000, "", " \n\t ", "one", "two words", "a b c d e", "a b c d f", "\n".join(["same line here"] * 9), None, None]
    texts.append(prose(r, 30_000))
    n = len(texts)
    docs = pd.DataFrame({"doc_id": range(n), "text": texts, "lang": ["en"] * (n - 1) + [None], "source": ["s0" if i % 3 else None if i % 5 == 0 else f"s{i % 4}" for i in range(n)], "n_chars": [None if t is None else len(t) for t in texts]})
    junk = [t is not None and any(s in t for s in ("***", "$$$")) for t in texts]
    toxic = [t is not None and any(b in t.split() for b in BAD) for t in texts]
    labels = pd.DataFrame({"doc_id": range(n), "quality": [0 if j else 1 for j in junk], "toxic": [int(t) for t in toxic]})
    labels = labels[[t is not None and len(t) > 20 for t in texts]]
    d = tmp_path_factory.mktemp("corpus")
    g = np.random.default_rng(1)
    vectors = g.normal(size=(300, 16))
    vectors[100:160] = vectors[:60] + g.normal(size=(60, 16)) * 0.1
    vectors[160:260] = vectors[99] + g.normal(size=(100, 16)) * 0.12
    vectors[260:280] = vectors[7]
    rows = [v.astype(np.float32).tolist() for v in vectors]
    rows[280:286] = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15]
    rows[286] = rows[7][:8]
    embeddings = pa.table({"vec_id": pa.array(range(300), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([None if i == 299 else i % 3 if i < 100 else (i - 100) % 3 if i < 160 else 0 for i in range(300)], pa.int32())})
    hosts = ["a.example.com", "EXAMPLE.net", "b.example.org", "x.org", "notexample.com"]
    urls = [f"{r.choice(['http', 'https'])}://{r.choice(hosts)}/{r.choice(['en', 'de', 'es'])}/{r.randint(1, 99)}{r.choice(['', '?q=1', '#top', '/'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "http://", "://h", "http://example.com", "HTTP://A.Example.COM/en/7?x://y"]
    html = [f"<html><body><nav><a href=/>menu words here</a></nav><article><h1>Title {i}</h1><p>{sentence(r, 12)}</p></article><footer>&copy; all rights</footer></body></html>" for i in range(len(urls))]
    html[:4] = [None, "", "bare text &amp; more", "<p>cut <b"]
    pages = pd.DataFrame({"page_id": range(len(urls)), "url": urls, "html": html})
    docs.to_parquet(d / "documents.parquet")
    labels.to_parquet(d / "labels.parquet")
    pq.write_table(embeddings, d / "embeddings.parquet")
    pages.to_parquet(d / "pages.parquet")
    return str(d)


@pytest.fixture(scope="session")
def docs(corpus):
    x = pd.read_parquet(f"{corpus}/documents.parquet")
    x["text"] = [None if t is None or t != t else t for t in x.text]
    return x


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    """Tables with nulls in every column, repeated rows and extra columns whose names clash with the operators' own."""
    d = tmp_path_factory.mktemp("odd")
    text = "Some words that are enough for a window of a few words in this text. " * 8
    extra = ["token", "n", "ranges", "component_id", "rep", "h", "g", "skey", "size", "comp", "_rank", "tile", "host", "verdict", "label_1"]
    docs = pd.DataFrame({"doc_id": pd.array([1, 1, 2, None, None, 3], "Int64"), "text": [text, text, None, text, None, ""], "lang": [None] * 6, "source": [None, "a", "a", None, "b", None], "n_chars": pd.array([len(text), None, None, None, None, 0], "Int64")})
    labels = pd.DataFrame({"doc_id": pd.array([1, None, 2, 3], "Int64"), "quality": pd.array([1, 0, None, 0], "Int64"), "toxic": pd.array([None, 0, 1, 1], "Int64")})
    pages = pd.DataFrame({"page_id": pd.array([1, None, 2, 2], "Int64"), "url": [None, "http://a.com/en/", "x", "x"], "html": ["<p>Some text.</p>", None, "", ""]})
    for df in (docs, labels, pages):
        for name in extra:
            df[name] = ["x"] * len(df)
    docs.to_parquet(d / "documents.parquet")
    labels.to_parquet(d / "labels.parquet")
    pages.to_parquet(d / "pages.parquet")
    e = pa.table({"vec_id": pa.array([1, 1, None, 4], pa.int64()), "embedding": pa.array([[1.0, 2.0], [1.0, 2.0], [1.0, 2.0], None], pa.list_(pa.float32())), "label": pa.array([1, 1, 1, None], pa.int32()), "dim": ["x"] * 4, "id": ["x"] * 4})
    pq.write_table(e, d / "embeddings.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty(tmp_path_factory, corpus):
    d = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "embeddings", "pages"):
        pq.write_table(pq.read_table(f"{corpus}/{name}.parquet").slice(0, 0), d / f"{name}.parquet")
    return str(d)
