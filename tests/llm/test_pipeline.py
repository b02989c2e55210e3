"""The pipeline, stage by stage, against brute-force stages on a whole small table."""

import zlib

import numpy as np
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers as P
from tests.llm import brute

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    t = pq.read_table(f"{DIR}/documents.parquet").to_pylist()
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, want = docs.columns, {r["doc_id"]: r["text"] for r in t}

    longest = {i: brute.longest_repeat(x or "") for i, x in want.items()}
    failed = {i: r[5] for i, r in brute.op5([(i, x or "") for i, x in want.items()]).items()}
    want = {i: x for i, x in want.items() if not failed[i] and longest[i] <= 100}

    lines = {}
    key = brute.line_key
    for i, x in want.items():
        for line in x.split("\n"):
            lines.setdefault(key(line), set()).add(i)
    drop = {k: max(v) for k, v in lines.items() if len(k) >= 20 and len(v) >= 3}
    after_lines = {i: "\n".join(x for x in t.split("\n") if drop.get(key(x), i) == i) for i, t in want.items()}

    classes = brute.near(sorted(after_lines.items()))
    after_near = {i: x for i, x in after_lines.items() if classes[i] == i}
    b = pq.read_table(f"{DIR}/benchmark.parquet").to_pydict()
    hit = brute.op10(sorted(after_near.items()), list(zip(b["item_id"], b["text"])))
    after_all = {i: x for i, x in after_near.items() if not hit[i][4]}

    for (_, stage), texts in zip(corpus_pipeline.STAGES[:-1], (want, after_lines, after_near, after_all)):
        docs = stage(spark, docs, DIR)
        assert docs.columns == columns
        rows = docs.collect()
        assert {r["doc_id"]: r["text"] for r in rows} == texts and len(rows) == len(texts)
        docs = spark.createDataFrame(rows, docs.schema)
    packed = corpus_pipeline.run(spark, DIR).collect()
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = {}
    for i, text in after_all.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            pieces[i, k] = (at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in packed} == pieces and len(packed) == len(pieces)
    bins = {}
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in map(sorted, bins.values()):
        assert b[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(b, b[1:])) and sum(b[-1]) <= 4096
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "decontamination", "best_fit_packing"]


def test_stages_on_odd_tables(spark):
    """Empty tables, null and repeated ids, null and empty texts, extra columns: every stage keeps columns and clean rows."""
    ddl = "doc_id long, text string, lang string, source string, n_chars long, block string, kept int, row__ int"
    clean = " ".join(f"word{i * 7919 % 1000}" for i in range(60))
    rows = [(None, clean, "en", "a", 1, "b", 0, 1), (5, clean + " end", None, None, None, None, None, None), (5, clean + " end", None, None, None, None, None, None), (6, None, "en", "a", 0, "b", 0, 1), (7, "", "en", "a", 0, "b", 0, 1)]
    left = [[None, 5, 5], [None, 5, 5], [None], [None]]
    docs, empty = spark.createDataFrame(rows, ddl), spark.createDataFrame([], ddl)
    for (_, stage), want in zip(corpus_pipeline.STAGES[:-1], left):
        docs, empty = stage(spark, docs, DIR), stage(spark, empty, DIR)
        assert docs.columns == empty.columns == [c.split()[0] for c in ddl.split(", ")] and empty.count() == 0
        got = docs.collect()
        assert sorted((r["doc_id"] or 0) for r in got) == [i or 0 for i in want]
        docs, empty = spark.createDataFrame(got, ddl), spark.createDataFrame([], ddl)
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, empty, DIR).count() == 0 and [r["doc_id"] for r in last(spark, docs, DIR).collect()] == [None]
