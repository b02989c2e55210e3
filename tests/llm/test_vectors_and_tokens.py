"""Token counts against the libraries, whitening and codes against plain numpy, all on odd tables and on whole small ones."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from glycoflow.llm.kernels import text_bytes
from glycoflow.llm.queries import QUERIES
from glycoflow.llm.token_counts import ALNUM, SOLID, count_tokens, counter, stretches
from glycoflow.llm.vector_codes import Codebooks, compress_vectors, nearest, train
from glycoflow.llm.whitening import whiten

P = pytest.importorskip("public_tokenizers")
DIR = "/root/testdata/sf0.001"
DDL = "doc_id long, text string"
NAN, INF = float("nan"), float("inf")


def library(name):
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(P.path(name))
        return lambda text: len(t.encode(text, add_special_tokens=False))
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=P.path(name))
    return lambda text: len(m.encode(text))


#: Every kind of white space, marks that combine, contractions, special strings whole and broken.
BITS = [" ", " ", " ", "a", "B", "é", "中", "\n", "\t", "'s", "1", "٣", " ", "　", "🙂", ".", "…", "<|endoftext|>", "<|endof", "́", "​", "᠎", "\x1f", "\x85", " ", "word"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"])
def test_counts_are_the_librarys(name):
    rng = random.Random(5)
    texts = ["", " ", "a b", "x <|endoftext|> y", "<|endoftext|> <|endoftext|>", "a ́ b", "it's 's a", "中 文 字", *("".join(rng.choice(BITS) for _ in range(rng.randint(1, 40))) for _ in range(4000))]
    texts += texts[:50]  # met before: looked up
    c, want = counter(P.path(name)), library(name)
    assert c.totals(*text_bytes(pa.array(texts))).tolist() == [want(t) for t in texts]
    assert (c.beside is None) == (name == "word_bpe_49k.json")
    with pytest.raises(ValueError):
        counter("vocabulary.txt")


def test_stretches_begin_at_safe_spaces_only():
    texts = ["one two  three", "", " a  b c　 d é ü", "x"]
    buf, off = text_bytes(pa.array(texts))
    for kind, want in ((SOLID, ["one", " two  three", "", " a  b", " c　 d", " é", " ü", "x"]), (ALNUM, ["one", " two  three", "", " a  b", " c　 d é ü", "x"])):
        starts, of = stretches(buf, off, kind)
        raw = buf.tobytes()
        assert [raw[a:b].decode() for a, b in zip(starts, [*starts[1:], len(raw)])] == want
        assert ["".join(w for w, o in zip(want, of) if o == i) for i in range(4)] == texts


def test_token_counts_on_tables(spark):
    want = library("byte_bpe_50k.json")
    long = " ".join(f"w{i % 977}ö" for i in range(200_000))
    rows = [(1, "a b"), (1, "a b"), (None, "x"), (2, None), (3, ""), (4, long), (5, "y" * 300_000), (6, "中" * 50_000), (7, "<|endoftext|>" * 600)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], f"{DDL}, n_tokens int, batch string").repartition(3)
    got = sorted(tuple(r) for r in count_tokens(df).na.fill({"doc_id": -1}).collect())
    full = [(i if i is not None else -1, len((t or "").encode()), want(t or "")) for i, t in rows]
    assert got == sorted((i, b, n, n > 512) for i, b, n in full)
    assert got[-1][2:] == (600, True)
    assert count_tokens(spark.createDataFrame([], DDL)).count() == 0
    assert {r["doc_id"]: r["over_limit"] for r in count_tokens(df.where("doc_id = 1"), limit=1).collect()} == {1: True}
    model = library("piece_bpe_32k.model")
    assert {r["doc_id"]: r["n_tokens"] for r in count_tokens(df.where("doc_id in (2, 4)"), tokenizer=P.path("piece_bpe_32k.model")).collect()} == {2: 0, 4: model(long)}


def test_token_counts_on_a_whole_table(spark):
    t = pq.read_table(f"{DIR}/documents.parquet").to_pydict()
    want = library("byte_bpe_50k.json")
    full = {i: (len((x or "").encode()), want(x or "")) for i, x in zip(t["doc_id"], t["text"])}
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in QUERIES["op11_token_counts"](spark, DIR).collect()}
    assert got == {i: (b, n, n > 512) for i, (b, n) in full.items()}


def plain_whitening(x, components=16):
    """Covariance over distinct rows by numpy, in the order of the given rows."""
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    c = (n * fit - total) / n
    v = c.T @ c / n
    e, axes = np.linalg.eigh(v)
    order = np.argsort(e)[::-1][:components]
    whole = n * x - total
    return n, (whole * whole).sum(axis=1), (whole / n) @ axes[:, order] / np.sqrt(e[order]), e[order] / np.trace(v)


def quantised(vectors, scale, offset=0):
    return (np.floor(np.asarray(vectors, np.float32).astype(float) * scale) + offset).astype(np.int64)


def held_against(rows, ids, x):
    n, deviation, white, explained = plain_whitening(x)
    k = white.shape[1]
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(got) == len(rows) == len(ids) * k
    assert {r["n"] for r in rows} == {n} and len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-8
    y = np.array([[got[i, c + 1]["whitened"] for c in range(k)] for i in ids])
    sign = np.sign((y * white).sum(axis=0))
    assert np.abs(y * sign - white).max() < 1e-8
    assert [got[i, 1]["deviation"] for i in ids] == deviation.tolist()
    assert np.allclose([got[ids[0], c + 1]["explained"] for c in range(k)], explained, rtol=1e-9)


def test_whitening_on_a_whole_table(spark):
    t = pq.read_table(f"{DIR}/embeddings.parquet").to_pydict()
    held_against(QUERIES["op12_whitening"](spark, DIR).collect(), t["vec_id"], quantised(t["embedding"], 64, 1_000_000))


VECTORS = "vec_id long, embedding array<float>, label int"


def test_whitening_on_odd_tables(spark):
    rng = np.random.default_rng(4)
    # A third of the rows are one vector; entries of very different spread; clashing and odd columns.
    made = [(rng.normal(size=6) * [1, 10, 0.5, 100, 3, 1]).astype(np.float32).tolist() for _ in range(80)]
    rows = [(i, v, "x", 1.0) for i, v in enumerate([*made, *[made[0]] * 40])]
    bad = [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, [NAN] * 6), (1003, [INF, 0.0, 0.0, 0.0, 0.0, 0.0]), (1004, []), (1005, [1.0, 2.0])]
    ddl = "vec_id long, embedding array<float>, x string, n double"
    df = spark.createDataFrame([*rows, *((*b, "y", 0.0) for b in bad)], ddl).repartition(5)
    held_against(whiten(df).collect(), [r[0] for r in rows], quantised([r[1] for r in rows], 64, 1_000_000))
    assert whiten(spark.createDataFrame([], ddl)).count() == 0 and whiten(df.where("vec_id >= 1000 and vec_id < 1005")).count() == 0
    # One distinct vector: no variance, so no projection; null and repeated ids pass through.
    same = whiten(spark.createDataFrame([(None, [1.0, 2.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert len(same) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(1, 0, None, None, None)}
    # A dimension that never changes adds a component without variance.
    flat = whiten(spark.createDataFrame([(i, [float(i), 5.0]) for i in range(9)], "vec_id long, embedding array<float>")).collect()
    assert {r["whitened"] is None for r in flat if r["component"] == 2} == {True} and all(r["identity_error"] < 1e-9 for r in flat)
    assert {round(r["explained"], 12) for r in flat} == {0.0, 1.0}


def plain_codes(ids, x, parts=8, entries=16, rounds=6):
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, x[i].tolist()))
    width = x.shape[1] // parts
    cut = [x[:, p * width : (p + 1) * width] for p in range(parts)]
    books = [c[order[:entries]].copy() for c in cut]
    for r in range(rounds + 1):
        far = [((c[:, None] - b[None]) ** 2).sum(axis=2) for c, b in zip(cut, books)]
        code = [f.argmin(axis=1) for f in far]
        if r < rounds:
            for c, b, k in zip(cut, books, code):
                for j in range(len(b)):
                    if (k == j).any():
                        b[j] = c[k == j].sum(axis=0) // (k == j).sum()
    return ["".join(f"{k[i]:02x}" for k in code) for i in range(len(ids))], sum(f.min(axis=1) for f in far).tolist(), ",".join(str(v) for b in books for v in b.reshape(-1).tolist())


def test_codes_on_a_whole_table(spark):
    t = pq.read_table(f"{DIR}/embeddings.parquet").to_pydict()
    code, error, books = plain_codes(t["vec_id"], quantised(t["embedding"], 4096))
    got = {r["vec_id"]: r for r in QUERIES["op13_vector_codes"](spark, DIR).collect()}
    assert [got[i]["code"] for i in t["vec_id"]] == code and [got[i]["error"] for i in t["vec_id"]] == error
    assert {r["codebooks_sha256"] for r in got.values()} == {hashlib.sha256(books.encode()).hexdigest()}
    by_label = {x: sum(e for e, y in zip(error, t["label"]) if y == x) for x in set(t["label"])}
    assert all(got[i]["label_error"] == by_label[x] for i, x in zip(t["vec_id"], t["label"]))


def test_codes_on_odd_tables(spark):
    rng = np.random.default_rng(6)
    made = (rng.integers(-9, 9, size=(60, 4)) / 4096).astype(np.float32).tolist()  # small integers: many ties
    vectors = [*made, *[made[3]] * 40]
    ids = [*range(90), None, None, 5, 5, *range(100, 106)]
    # One label holds a third of the rows, some rows have none, most labels have one row.
    labels = [7 if i % 3 == 0 else None if i % 5 == 0 else i for i in range(100)]
    labels += [None] * (len(ids) - 100)
    rows = list(zip(ids[:100], vectors, labels))
    bad = [(2000, None, 7), (2001, [1.0, None, 0.0, 0.0], 7), (2002, [NAN] * 4, 7), (2003, [-INF, 0.0, 0.0, 0.0], None), (2004, [], 7), (2005, [1.0, 2.0], 7)]
    df = spark.createDataFrame([(*r, 1, "c") for r in [*rows, *bad]], f"{VECTORS}, error int, slot string").repartition(7)
    code, error, books = plain_codes([r[0] for r in rows], quantised([r[1] for r in rows], 4096), parts=2, entries=5)
    total = {x: sum(e for e, r in zip(error, rows) if r[2] == x) for x in set(labels)}
    want = sorted(((r[0] if r[0] is not None else -1), c, e, total[r[2]]) for r, c, e in zip(rows, code, error))
    got = compress_vectors(df, parts=2, entries=5).collect()
    assert sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["code"].hex(), r["error"], r["label_error"]) for r in got) == want
    assert {r["codebooks"] for r in got} == {books} and {r["label"] for r in got} == {None if x is None else str(x) for x in labels}
    assert compress_vectors(spark.createDataFrame([], VECTORS)).count() == 0 and compress_vectors(df.where("vec_id >= 2000 and vec_id < 2005")).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        compress_vectors(df, parts=3)
    few = compress_vectors(df.where("vec_id in (0, 1, 2)"), parts=2).collect()
    assert len(few) == 3 and {r["error"] for r in few} == {0}


def test_label_errors_of_many_labels(spark):
    rows = [(i, [float(i % 11), 1.0], f"l{i}" if i % 2 else "hot") for i in range(400)]
    got = compress_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string"), parts=2, entries=4, rounds=1).collect()
    total = {}
    for r in got:
        total[r["label"]] = total.get(r["label"], 0) + r["error"]
    assert len(got) == 400 and all(r["label_error"] == total[r["label"]] for r in got)


def test_nearest_finds_the_first_of_equals_from_any_start():
    rng = np.random.default_rng(8)
    for spread in (3, 50, 4000):
        entries, x = rng.integers(-spread, spread, (16, 8)), rng.integers(-spread, spread, (500, 8))
        entries[9] = entries[4]  # equal entries: the lower index wins
        far = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        for start in (np.zeros(500, np.int64), far.argmin(axis=1), rng.integers(0, 16, 500)):
            best, error = nearest(x, entries, start)
            assert (best == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()
    assert nearest(x[:3], entries[:1], np.zeros(3, np.int64))[0].tolist() == [0, 0, 0]
    # Rows that lie on their entry stay there.
    best, error = nearest(entries[[0, 1, 2]], entries[:4], np.array([0, 1, 2]))
    assert best.tolist() == [0, 1, 2] and not error.any()


def test_decoded_vectors_are_near(spark):
    t = pq.read_table(f"{DIR}/embeddings.parquet").to_pydict()
    df = spark.read.parquet(f"{DIR}/embeddings.parquet")
    books, rows = train(df)
    code = {r["vec_id"]: np.frombuffer(r["code"], np.uint8) for r in rows.collect()}
    back = books.decode(np.stack([code[i] for i in t["vec_id"]]))
    x = np.array(t["embedding"])
    assert isinstance(books, Codebooks) and ((back - x) ** 2).sum() < 0.7 * ((x - x.mean(axis=0)) ** 2).sum()
