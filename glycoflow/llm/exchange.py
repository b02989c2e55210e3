"""Shared-hash exchange: which (document, position) entries share a 64-bit hash with entries elsewhere?

1. Each map task hashes its texts in numpy.  It settles what its own entries already decide and sends on the
   few entries of each hash that can still matter, so a hash that a third of all rows hold reaches the shuffle
   a few times per task instead of once per row.
2. Entries are shuffled by hash range, packed as delta-coded byte planes (about 9 bytes an entry).  The number
   of ranges grows with the input, so one range fits in a task.
3. Answers go back by block of document ids and meet the texts there in a cogroup.

Every step is a plain Spark shuffle, so a lost executor costs recomputation only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, partitions_for, prepare, size_of, slices
from .kernels import NULL_ID, doc_ids, pack_ints, text_bytes, unpack_ints

#: Entries that a map task gathers before it sends them on.
CHUNK = 2_000_000
_OUT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary()), ("of", pa.binary()), ("pos", pa.binary()), ("hash", pa.binary())])
_OUT_DDL = "bucket int, kind int, ids binary, of binary, pos binary, hash binary"
_SENT, _ANSWER = 0, 1


@dataclass(frozen=True)
class Rule:
    """How entries are made and judged.

    extract(buf, off) gives (text index, position, hash), ascending by text and position.
    local(run, ids, pos) and final(run, ids, pos) get the entries of hashes that occur more than once, sorted by
    hash, id and position, with the start index of each entry's run; local gives (still to be sent, answered),
    final gives answered.  Entries of hashes that occur once are sent and never answered.
    """

    extract: Callable
    local: Callable
    final: Callable


def block_of(n_blocks: int, id_col: str = "doc_id") -> Column:
    return F.pmod(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), F.lit(n_blocks)).cast("int")


def _runs(h: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash; entries in runs of equal hashes (places in that order), and each one's run start among them."""
    order = np.argsort(h)
    hs = h[order]
    same = hs[1:] == hs[:-1]
    inside = np.zeros(len(hs), bool)
    inside[1:] |= same
    inside[:-1] |= same
    at = np.flatnonzero(inside)
    sub = order[at]
    order[at] = sub = sub[np.lexsort((pos[sub], ids[sub], h[sub]))]
    hs = h[sub]
    begin = np.ones(len(sub), bool)
    begin[1:] = hs[1:] != hs[:-1]
    run = np.maximum.accumulate(np.where(begin, np.arange(len(sub)), 0))
    return order, at, run


def _blob(bucket: int, kind: int, ids: np.ndarray, pos: np.ndarray, h: np.ndarray | None) -> tuple:
    table, of = np.unique(ids, return_inverse=True)
    delta = np.diff(h, prepend=np.uint64(0)) if h is not None else None
    return (bucket, kind, pack_ints(np.diff(table, prepend=0)), pack_ints(of.astype(np.uint32)), pack_ints(pos.astype(np.uint32)), pack_ints(delta) if delta is not None else b"")


def read_blob(ids: bytes, of: bytes, pos: bytes) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        table = np.cumsum(unpack_ints(ids, np.int64))
    return table[unpack_ints(of, np.uint32)], unpack_ints(pos, np.uint32).astype(np.int64)


def _batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)


def _answers(ids: np.ndarray, pos: np.ndarray, n_blocks: int, kind: int) -> Iterator[tuple]:
    """One packed row for each block of documents."""
    block = np.mod(ids, n_blocks)
    order = np.lexsort((pos, ids, block))
    ids, pos, block = ids[order], pos[order], block[order]
    cuts = np.flatnonzero(np.diff(block, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(block)]):
        yield _blob(int(block[a]), kind, ids[a:b], pos[a:b], None)


def answers(docs: DataFrame, rule: Rule, n_buckets: int, n_blocks: int, n_parts: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (block, ids, of, pos): packed (document, position) pairs that the rule answers."""

    def flush(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, pos, h = (np.concatenate(x) for x in zip(*parts))
        order, at, run = _runs(h, ids, pos)
        sub = order[at]
        send, answered = rule.local(run, ids[sub], pos[sub])
        gone = np.zeros(len(order), bool)
        gone[at] = ~send
        sent = order[~gone]
        hs = h[sent]
        cuts = np.searchsorted(hs, np.arange(1, n_buckets, dtype=np.float64) * (2.0**64 / n_buckets)) if n_buckets > 1 else []
        edges = np.concatenate([[0], cuts, [len(hs)]]).astype(int)
        yield from _batch([_blob(k, _SENT, ids[sent[a:b]], pos[sent[a:b]], hs[a:b]) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a])
        mine = sub[answered]
        yield from _batch(list(_answers(ids[mine], pos[mine], n_blocks, _ANSWER)))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in slices(batches, "text"):
            of, pos, h = rule.extract(*text_bytes(batch.column(1)))
            parts.append((doc_ids(batch.column(0))[of], pos, h))
            n += len(h)
            if n >= CHUNK:
                yield from flush(parts)
                parts, n = [], 0
        if n:
            yield from flush(parts)

    def judge(table: pa.Table) -> pa.Table:
        rows = [r.values() for r in table.select(["kind", "ids", "of", "pos", "hash"]).to_pylist()]
        ids, pos, h = [], [], []
        for _, i, o, p, x in rows:
            got = read_blob(i, o, p)
            ids.append(got[0])
            pos.append(got[1])
            with np.errstate(over="ignore"):
                h.append(np.cumsum(unpack_ints(x, np.uint64), dtype=np.uint64))
        ids, pos, h = np.concatenate(ids), np.concatenate(pos), np.concatenate(h)
        order, at, run = _runs(h, ids, pos)
        sub = order[at]
        mine = sub[rule.final(run, ids[sub], pos[sub])]
        out = list(_batch(list(_answers(ids[mine], pos[mine], n_blocks, _ANSWER))))
        return pa.Table.from_batches(out, _OUT)

    made = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(entries, _OUT_DDL)
    # Answers that a map task settled pass by the judges: a group is one hash range or, below zero, one block.
    key = F.when(F.col("kind") == _SENT, F.col("bucket")).otherwise(-1 - F.col("bucket")).alias("key")

    def group(table: pa.Table) -> pa.Table:
        return table.select(_OUT.names) if table["kind"][0].as_py() == _ANSWER else judge(table)

    return made.withColumn("key", key).repartition(n_parts, "key").groupBy("key").applyInArrow(group, _OUT_DDL).select(F.col("bucket").alias("block"), "ids", "of", "pos")


def apply_answers(docs: DataFrame, rule: Rule, apply: Callable, ddl: str, id_col: str = "doc_id", text_col: str = "text", entries_per_mb: float = 160_000) -> DataFrame:
    """Runs the exchange and apply(table, positions) on each block: table has docs' columns, positions maps ids to sorted arrays."""
    prepare(docs.sparkSession)
    n_bytes, _ = size_of(docs, text_col)
    n_blocks = blocks_for(n_bytes)
    n_buckets = blocks_for(n_bytes * entries_per_mb / 160_000, mb=12)
    n_parts = partitions_for(n_bytes)
    back = answers(docs, rule, n_buckets, n_blocks, n_parts, id_col, text_col).repartition(n_parts, "block")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.drop_columns(["block__"])
        found: dict[int, np.ndarray] = {}
        if right.num_rows:
            got = [read_blob(r["ids"], r["of"], r["pos"]) for r in right.to_pylist()]
            ids, pos = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            order = np.lexsort((pos, ids))
            ids, pos = ids[order], pos[order]
            cuts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            found = {int(ids[a]): pos[a:b] for a, b in zip(cuts, [*cuts[1:], len(ids)])}
        return apply(left, found)

    texts = docs.withColumn("block__", block_of(n_blocks, id_col)).repartition(n_parts, "block__")
    return texts.groupBy("block__").cogroup(back.groupBy("block")).applyInArrow(meet, ddl)
