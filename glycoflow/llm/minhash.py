"""Near duplicates: consistent weighted sampling of TF-IDF word shingles, banded, verified by weighted Jaccard similarity.

1. A shingle weighs (1 + ln tf) * (1 + ln((1 + N) / (1 + max(df, floor))) / ln 1000): term frequency is logarithmic, so
   that one line repeated over and over doesn't outweigh all else; inverse document frequency goes from 1 (in every
   document) to 2 (in one of a thousand or fewer), so that the few shingles an edit makes, always rare, don't outweigh
   the many that a large group of copies shares, and so that weights are alike at every size.  floor is the largest of
   1, N / 1000 and T / 2**21, T being the documents' distinct shingles added up.  Document frequencies above it are
   exact.  As they add up to T at most, fewer than 2**21 shingles have one: that bounds what is broadcast.  A table of 4
   million slots, in which all shingles are counted first, tells which can; only those are counted one by one.
2. Improved consistent weighted sampling gives each document 48 samples; two documents share a sample with a
   probability equal to their weighted Jaccard similarity.  Twelve bands of four samples make candidates.
3. Texts with equal shingles, each as often, count as one from here on.  Rows are sorted by bucket and, inside it, by
   the samples after the band's own, and dealt by ranges of both: a large bucket is shared among tasks and cut into
   overlapping runs of `bucket` documents, most alike side by side and in another order for each band, so no bucket
   is ever gathered whole.  In a run, samples estimate all similarities; each document keeps its likeliest partners
   and the run's maximum spanning tree, which keeps whatever is connected connected.
4. Candidates are verified on whole weighted sets; links become classes by repeated large and small stars, to the end.
5. Buckets of which a run proposed only some pairs, or that two tasks may share, are then searched whole for pairs of
   documents that are in different classes so far, in cells of two blocks each; likely ones are verified as well.  So
   the classes are those of all pairs that share a bucket and whose samples agree enough, whatever a bucket's size.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, prepare, slices, stored, summed
from .kernels import NULL_ID, doc_ids, mix, owner, pack_ints, rolling, span_hashes, text_bytes, unpack_ints, windows, words

SHINGLE, SAMPLES, ROWS = 5, 48, 4
BANDS = SAMPLES // ROWS
#: Slots of the table that finds frequent shingles, and ranges of slots that are added up on their own.
SLOTS, RANGES = 1 << 22, 64
#: Frequencies of one document in so many and less count alike; at most so many shingles are more frequent.
SPREAD, FREQUENT = 1000, 1 << 21
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of each text's distinct shingles; their 48-bit hashes, ascending; their counts; a hash of each whole bag.

    A text of fewer words than a shingle has, but not none, is one shingle.
    """
    buf, off = text_bytes(column)
    starts, ends, of = words(buf, off)
    h = span_hashes(buf, starts, ends)
    at, rolled = windows(h, of, SHINGLE)
    text = owner(of)[at]
    n = np.diff(of)
    for k in range(1, SHINGLE):
        short = np.flatnonzero(n == k)
        if len(short):
            text = np.append(text, short)
            rolled = np.append(rolled, rolling(h, k)[of[:-1][short]] + np.uint64(k))
    key = np.sort((text.astype(np.uint64) << np.uint64(48)) | (rolled >> np.uint64(16)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    offsets = np.searchsorted(key, np.arange(len(n) + 1, dtype=np.uint64) << np.uint64(48))
    key &= np.uint64((1 << 48) - 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(key + count.astype(np.uint64) * _GOLD), dtype=np.uint64)])
    return offsets, key, count, mix(total[offsets[1:]] - total[offsets[:-1]] + n.astype(np.uint64))


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(SLOTS - 1)).astype(np.int64)


def floor_of(n_docs: int, n_shingles: int) -> float:
    """Document frequencies up to this count as this."""
    return max(1.0, n_docs / SPREAD, n_shingles / FREQUENT)


class Weights:
    """TF-IDF weights from the numbers of documents and of their distinct shingles, and the frequent shingles' exact frequencies."""

    def __init__(self, n_docs: int, n_shingles: int, keys: np.ndarray, df: np.ndarray):
        self.n_docs, self.n_shingles = n_docs, n_shingles
        order = np.argsort(keys)
        floor = floor_of(n_docs, n_shingles)
        idf = 1 + (np.log(1 + n_docs) - np.log(1 + np.append(np.maximum(df[order], floor), min(floor, n_docs)))) / np.log(SPREAD)
        self.keys, self.idf, self.rare = keys[order], idf[:-1], max(idf[-1], 1.0)
        self.some = np.zeros(SLOTS, bool)
        self.some[_slot(keys)] = True

    def of(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), self.rare)
        look = np.flatnonzero(self.some[_slot(keys)])
        if len(look):
            at = np.minimum(np.searchsorted(self.keys, keys[look]), len(self.keys) - 1)
            same = self.keys[at] == keys[look]
            out[look[same]] = self.idf[at[same]]
        more = np.flatnonzero(counts > 1)
        out[more] *= 1 + np.log(counts[more])
        return out


def document_frequencies(texts: DataFrame) -> Weights:
    """Counts all documents' distinct shingles by slot, arrays of a fixed size added up in Spark; then, one by one, those
    in slots that hold more than the floor.  Tasks add up their own counts before they are shuffled."""
    width = SLOTS // RANGES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, part = np.zeros(SLOTS, np.int32), 0, TaskContext.get().partitionId()
        for batch in slices(batches, "text"):
            _, key, _, _ = shingle_bags(batch.column(1))
            np.add.at(df, _slot(key), 1)
            docs += batch.num_rows
        if docs:
            some = [r for r in range(RANGES) if df[r * width : (r + 1) * width].any()]
            sums = [pack_ints(df[r * width : (r + 1) * width].astype(np.int64)) for r in some] + [pack_ints(np.array([docs]))]
            yield pa.RecordBatch.from_arrays([pa.array([*some, RANGES], pa.int32()), pa.array([part] * len(sums), pa.int32()), pa.array(sums, pa.binary())], ["key", "part", "sums"])

    got = summed(texts.mapInArrow(count, "key int, part int, sums binary"), np.int64)
    slots = np.zeros(SLOTS, np.int64)
    for r in range(RANGES):
        if r in got:
            slots[r * width : (r + 1) * width] = got[r]
    n_docs, n_shingles = int(got[RANGES][0]) if RANGES in got else 0, int(slots.sum())
    floor = floor_of(n_docs, n_shingles)
    maybe = texts.sparkSession.sparkContext.broadcast(np.packbits(slots > floor))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, parts, n = np.unpackbits(maybe.value).astype(bool), [], 0
        for batch in itertools.chain(slices(batches, "text"), [None]):
            if batch is not None:
                _, key, _, _ = shingle_bags(batch.column(1))
                parts.append(key[look[_slot(key)]])
                n += len(parts[-1])
            if n >= 2_000_000 or batch is None and n:
                keys, times = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(times)], ["key", "n"])
                parts, n = [], 0

    counted = texts.mapInArrow(each, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > floor).toArrow()
    return Weights(n_docs, n_shingles, counted["key"].to_numpy().view(np.uint64), counted["n"].to_numpy())


def weighted_samples(offsets: np.ndarray, keys: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Improved consistent weighted sampling: 48 samples, as 32-bit codes, of each non-empty set.

    For each element and sample: r and c from Gamma(2, 1), b from U(0, 1), all drawn by hashing the element;
    t = floor(ln w / r + b), ln y = r (t - b), ln a = ln c - ln y - r.  The element with the least a is the sample,
    together with its t.
    """
    out = np.empty((len(offsets) - 1, SAMPLES), np.uint32)
    begin, log_w = offsets[:-1], np.log(weight).astype(np.float32)
    tiny, step = np.float32(2.0**-25), 1 << 16
    packed = np.empty(len(keys), np.uint64)
    for k in range(SAMPLES):
        seed = np.uint64((0xA0761D6478BD642F * (2 * k + 1)) & (2**64 - 1))
        for s in range(0, len(keys), step):
            e = keys[s : s + step]
            x = (e ^ seed) * _GOLD
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xE7037ED1A0B428DB)
            x ^= x >> np.uint64(29)
            z = x * np.uint64(0x8EBC6AF09C88C6E3)
            z ^= z >> np.uint64(32)
            c = -np.log(((x >> np.uint64(40)).astype(np.float32) * np.float32(2**-24) + tiny) * (((x >> np.uint64(16)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2**-24) + tiny))
            r = -np.log(((z & np.uint64(0xFFFF)).astype(np.float32) + np.float32(0.5)) * (((z >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-32))
            b = (x & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2**-16)
            t = np.floor(log_w[s : s + step] / r + b)
            a = c * np.exp(r * (b - t - np.float32(1)))
            code = (e + t.astype(np.int32).astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
            packed[s : s + step] = (np.maximum(a, np.float32(0)).view(np.uint32).astype(np.uint64) << np.uint64(32)) | code
        out[:, k] = (np.minimum.reduceat(packed, begin) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out


def _sketches(texts: DataFrame, weights) -> DataFrame:
    """doc_id, bag (hash of all shingles), sig (one byte a sample), bands (one hash a band); texts without words are left out."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            offsets, keys, counts, bag = shingle_bags(batch.column(1))
            some = np.flatnonzero(np.diff(offsets))
            ids = doc_ids(batch.column(0))[some]
            if not len(some):
                continue
            codes = weighted_samples(np.append(offsets[:-1][some], offsets[-1]), keys, weights.value.of(keys, counts))
            bands = np.zeros((len(some), BANDS), np.uint64)
            for j in range(BANDS):
                h = np.full(len(some), np.uint64((j + 1) * int(_GOLD) & (2**64 - 1)))
                for i in range(ROWS):
                    h = mix(h + codes[:, ROWS * j + i])
                bands[:, j] = h
            sig = (mix(codes.astype(np.uint64)) & np.uint64(0xFF)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(bag[some].view(np.int64)), pa.array([x.tobytes() for x in sig], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.reshape(-1).view(np.int64)))],
                ["doc_id", "bag", "sig", "bands"],
            )

    return texts.mapInArrow(sketch, "doc_id long, bag long, sig binary, bands array<long>")


#: Pairs whose samples agree less than this aren't verified: four standard deviations below 0.8.
ESTIMATE = 0.58
#: Runs of so few documents give all likely pairs; in longer ones each document keeps so many partners.
SMALL, PARTNERS = 16, 6


def _bucket_pairs(sig: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs to verify in one bucket: all likely ones if it is small; else each one's likeliest, and a spanning tree."""
    m = len(sig)
    if m <= 64:
        agree = (sig[:, None] == sig[None]).sum(2, dtype=np.uint8)
    else:
        agree = np.zeros((m, m), np.uint8)
        for column in sig.T:
            agree += column[:, None] == column[None, :]
    least = int(np.ceil(ESTIMATE * SAMPLES))
    if m <= SMALL:
        a, b = np.nonzero(np.triu(agree >= least, 1))
        yield from zip(a.tolist(), b.tolist())
        return
    np.fill_diagonal(agree, 0)
    near = np.argpartition(-agree.astype(np.int16), PARTNERS - 1, axis=1)[:, :PARTNERS]
    a = np.repeat(np.arange(m), PARTNERS)
    b = near.reshape(-1)
    ok = agree[a, b] >= least
    found = set(zip(np.minimum(a, b)[ok].tolist(), np.maximum(a, b)[ok].tolist()))
    best, parent, out = agree[0].astype(np.int16), np.zeros(m, np.int64), np.zeros(m, bool)
    out[0] = True
    for _ in range(m - 1):  # Prim's algorithm
        best[out] = -1
        i = int(best.argmax())
        if best[i] >= least:
            found.add((min(i, int(parent[i])), max(i, int(parent[i]))))
        out[i] = True
        closer = (agree[i] > best) & ~out
        best[closer], parent[closer] = agree[i][closer], i
    yield from found


def _runs(bucket: int):
    """Pairs from rows sorted by key and samples: runs of one key, long ones cut with a quarter of overlap.

    Rows with a key and no pair are the buckets that this doesn't settle: long ones, and the first and last of a task.
    """

    def run_pairs(ids: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = np.array(list(_bucket_pairs(sig)), np.int64).reshape(-1, 2)
        return ids[got[:, 0]], ids[got[:, 1]]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sig = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, SAMPLES), np.uint8)
        ends: list[int] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                at_ends = batch.column("key")[0].as_py(), batch.column("key")[-1].as_py()
                ends = [ends[0] if ends else at_ends[0], at_ends[1]]
            if batch is not None:
                key = np.append(key, batch.column("key").to_numpy())
                ids = np.append(ids, batch.column("doc_id").to_numpy())
                sig = np.concatenate([sig, np.frombuffer(b"".join(batch.column("order").to_pylist()), np.uint8).reshape(-1, SAMPLES)])
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.append(cuts, len(key)))
            unsettled = key[cuts[(size > SMALL) | (size >= bucket)]]
            done = len(cuts) - (batch is not None)  # the last run may go on
            two = cuts[:done][size[:done] == 2]
            likely = two[(sig[two] == sig[two + 1]).sum(1) >= ESTIMATE * SAMPLES]
            a, b, rest = [ids[likely]], [ids[likely + 1]], len(key)
            for i in np.flatnonzero(size > 2).tolist():
                at, end = int(cuts[i]), int(cuts[i] + size[i])
                while i < done and end - at > 1 or end - at >= bucket:
                    to = min(at + bucket, end)
                    x, y = run_pairs(ids[at:to], sig[at:to])
                    a.append(x)
                    b.append(y)
                    at = end if at + bucket >= end and i < done else at + bucket - bucket // 4
                if i >= done:
                    rest = at
            if done < len(cuts) and size[-1] <= 2:
                rest = int(cuts[-1])
            key, ids, sig = key[rest:], ids[rest:], sig[rest:]
            a, b = np.concatenate(a), np.concatenate(b)
            if batch is None:
                unsettled = np.append(unsettled, np.array(ends, np.int64))
            none = pa.nulls(len(unsettled), pa.int64())
            cols = [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(cols, [none, none, pa.array(unsettled)])], ["a", "b", "key"])

    return pairs


def _proposed(sketches: DataFrame, bucket: int) -> DataFrame:
    """Candidate pairs (a, b), a < b, from all runs, and keys of the buckets of which that aren't all likely pairs."""
    rows = sketches.select("doc_id", "sig", F.posexplode("bands").alias("band", "key"))
    # Samples in the order that begins after the band's own: a rotation, so agreement between two rows of one band is unchanged.
    turned = F.concat(F.expr(f"substring(sig, (band + 1) * {ROWS} + 1, {SAMPLES})"), F.expr(f"substring(sig, 1, (band + 1) * {ROWS})"))
    dealt = rows.select("doc_id", "key", turned.alias("order"))
    n = max(12, -(-sketches.count() * BANDS // 100_000))
    ordered = dealt.repartitionByRange(n, "key", "order").sortWithinPartitions("key", "order", "doc_id")
    return ordered.mapInArrow(_runs(bucket), "a long, b long, key long").where("key is not null or a < b").distinct()


def _vectors(texts: DataFrame) -> DataFrame:
    """doc_id, h (distinct shingles, ascending), c (their counts) of texts."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            offsets, keys, counts, _ = shingle_bags(batch.column(1))
            spans = list(zip(offsets[:-1], offsets[1:]))
            sets = [pack_ints(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in spans]
            times = [pack_ints(counts[a:b].astype(np.uint32)) for a, b in spans]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids(batch.column(0))), pa.array(sets, pa.binary()), pa.array(times, pa.binary())], ["doc_id", "h", "c"])

    return texts.mapInArrow(vectors, "doc_id long, h binary, c binary")


def read_vector(h: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(unpack_ints(h, np.uint64), dtype=np.uint64), unpack_ints(c, np.uint32)


def _links(pairs: DataFrame, vectors: DataFrame, weights, similarity: float) -> DataFrame:
    """The candidate pairs whose weighted Jaccard similarity over whole texts is high enough."""

    def weighed(h: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = read_vector(h, c)
        return keys, weights.value.of(keys, counts)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for ah, ac, bh, bc in zip(*(batch.column(x).to_pylist() for x in ("ah", "ac", "bh", "bc"))):
                (ka, wa), (kb, wb) = weighed(ah, ac), weighed(bh, bc)
                _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
                both = np.minimum(wa[i], wb[j]).sum()
                ok.append(both >= similarity * (wa.sum() + wb.sum() - both) * (1 - 1e-12))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], ["a", "b"])

    left = vectors.select(F.col("doc_id").alias("a"), F.col("h").alias("ah"), F.col("c").alias("ac"))
    right = vectors.select(F.col("doc_id").alias("b"), F.col("h").alias("bh"), F.col("c").alias("bc"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ah", "ac", "bh", "bc").mapInArrow(verify, "a long, b long")


#: Rows of one bucket that a block holds, about; a task holds two blocks.
BLOCK = 500


def _across(rows: DataFrame, vectors: DataFrame, weights, similarity: float, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between different classes, from all likely pairs of rows (doc_id, sig, bands, key, class_id) with one key.

    Each bucket's rows are dealt to blocks by a hash of their ids, large classes to blocks of their own.  Every two
    blocks are compared in a cell of their own, unless both hold the same one class.  No pairs leave a cell, only links.
    """
    some = rows.groupBy("key").agg(F.min("class_id").alias("x"), F.max("class_id").alias("y")).where("x < y").select("key")
    per = rows.groupBy("key", "class_id").agg(F.count(F.lit(1)).alias("m")).join(some, "key", "left_semi")
    own = F.when(F.col("m") > block, F.col("class_id"))
    per = stored(per.select("key", "class_id", own.isNotNull().alias("pure"), F.coalesce(own, F.lit(0)).alias("of"), "m"), "classes", weights.value.n_docs)
    shares = stored(per.groupBy("key", "pure", "of").agg(F.ceil(F.sum("m") / block).cast("int").alias("n")), "shares", weights.value.n_docs)
    blocks = shares.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("key", F.struct("pure", "of", "salt").alias("block"))
    left, right = blocks.withColumnRenamed("block", "l"), blocks.withColumnRenamed("block", "r")
    cells = left.join(right, "key").where("l <= r and not (l.pure and r.pure and l.of = r.of)")
    sides = stored(cells.select("key", "l", "r", F.explode(F.expr("if(l = r, array(l), array(l, r))")).alias("block")), "cells", weights.value.n_docs)
    dealt = rows.join(per.select("key", "class_id", "pure", "of"), ["key", "class_id"]).join(shares, ["key", "pure", "of"])
    dealt = dealt.select("doc_id", "sig", "bands", "key", "class_id", F.struct("pure", "of", F.pmod(F.xxhash64("doc_id"), F.col("n")).cast("int").alias("salt")).alias("block"))
    least = int(np.ceil(ESTIMATE * SAMPLES))

    def compare(t: pa.Table) -> pa.Table:
        ids, of, key = t["doc_id"].to_numpy(), t["class_id"].to_numpy(), t["key"][0].as_py()
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(-1, SAMPLES)
        bands = np.array(t["bands"].to_pylist(), np.int64)
        sets, counts = zip(*(read_vector(h, c) for h, c in zip(t["h"].to_pylist(), t["c"].to_pylist())))
        size = np.array([len(x) for x in sets])
        off = np.concatenate([[0], np.cumsum(size)])
        every = np.concatenate(sets)
        w = weights.value.of(every, np.concatenate(counts))
        keys, at = np.unique(every, return_inverse=True)
        mark = np.zeros(len(keys))
        total = np.bincount(np.repeat(np.arange(len(sets)), size), w, minlength=len(sets))
        second = t["second"].to_numpy()
        y = np.flatnonzero(second) if second.any() else np.arange(len(ids))
        out = []
        for i in np.flatnonzero(~second).tolist():
            j = y[(of[y] != of[i]) & (second[y] | (ids[y] > ids[i]))]
            j = j[(sig[j] == sig[i]).sum(1) >= least]
            # Of several buckets that two share, the first tells.
            j = j[bands[j, (bands[j] == bands[i]).argmax(1)] == key]
            mark[at[off[i] : off[i + 1]]] = w[off[i] : off[i + 1]]
            for b in (j[k : k + 64] for k in range(0, len(j), 64)):
                n = size[b]
                take = np.repeat(off[b] - np.cumsum(n) + n, n) + np.arange(n.sum())
                both = np.bincount(np.repeat(np.arange(len(b)), n), np.minimum(mark[at[take]], w[take]), minlength=len(b))
                out += [(ids[i], ids[x], of[i], of[x]) for x in b[both >= similarity * (total[i] + total[b] - both) * (1 - 1e-12)]]
            mark[at[off[i] : off[i + 1]]] = 0
        # One link tells that two classes are one.
        links = {(min(p, q), max(p, q)): (a, b) for a, b, p, q in out}.values()
        got = np.array(list(links), np.int64).reshape(-1, 2)
        return pa.table({"a": got.min(1) if len(got) else got[:, 0], "b": got.max(1) if len(got) else got[:, 1]})

    met = dealt.join(sides, ["key", "block"]).select("doc_id", "sig", "bands", "class_id", "key", "l", "r", (F.col("block") != F.col("l")).alias("second"))
    return met.join(vectors, "doc_id").groupBy("key", "l", "r").applyInArrow(compare, "a long, b long").distinct()


def classes(links: DataFrame, rows: int | None = None) -> DataFrame:
    """Connected components: (doc_id, class_id), the smallest id of each, for all ids with a link.

    Large star and small star in turn, until nothing changes; minima are combined before each shuffle and joined
    back, so no node's links are ever gathered.  Each round lowers some node's parent, so the loop ends by itself.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links", rows)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        old, edges = edges, stored(small, "links", rows)
        discard(old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, rows = now, now[0]
    return edges.unionByName(edges.select(F.col("v").alias("u"), "v").distinct()).groupBy("u").agg(F.min("v").alias("class_id")).select(F.col("u").alias("doc_id"), "class_id")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, bucket: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id; class_id, the smallest id among the documents that links of near copies connect with it; n_links.

    Two documents are linked if the weighted Jaccard similarity of their shingles of five words (runs of anything but
    ASCII white space), weighted by TF-IDF, is `similarity` or more; texts with equal shingles are always in one class.
    n_links counts the other texts that a verified link joins to the document's text.  Inside a class of a large bucket
    only as many pairs are verified as the class needs, so there it is a lower bound; copies of one text share it.

    A null or empty text has no words and is a class of its own, as is any document without a link.  A null id sorts
    before all others; rows that repeat an id count as one document in all their texts' classes.  An empty table gives
    an empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    weights = spark.sparkContext.broadcast(document_frequencies(texts))
    n = weights.value.n_docs
    # Where texts or whole sets are worked on, each counts as several rows, long ones as more.
    work = max(4 * n, weights.value.n_shingles // 50)
    sketches = stored(_sketches(texts, weights), "sketches", work)
    single = stored(sketches.groupBy("bag").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "singles", n)
    members = stored(sketches.select("doc_id", "bag").join(single.select("bag", F.col("doc_id").alias("first")).hint("merge"), "bag").select("doc_id", "first"), "members", n)
    discard(sketches)
    proposed = stored(_proposed(single, bucket), "proposed", n)
    pairs = proposed.where("key is null").select("a", "b")
    unsettled = proposed.where("key is not null").select("key")
    open_rows = stored(single.select("doc_id", "sig", "bands", F.explode("bands").alias("key")).join(unsettled, "key", "left_semi"), "open", n)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(open_rows.select("doc_id")).distinct()
    vectors = stored(_vectors(texts.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text").join(wanted.hint("merge"), "doc_id", "left_semi")), "vectors", work)
    links = stored(_links(pairs, vectors, weights, similarity), "verified", work)
    found = stored(classes(links.unionByName(_repeated(members)), n), "found", n)
    rest = stored(open_rows.join(found, "doc_id", "left").select("doc_id", "sig", "bands", "key", F.coalesce("class_id", "doc_id").alias("class_id")), "rest", n)
    more = stored(_across(rest, vectors, weights, similarity), "more", work)
    discard(open_rows, proposed, vectors, rest, single)
    joined = classes(found.select(F.col("doc_id").alias("a"), F.col("class_id").alias("b")).unionByName(more), n)
    every = links.unionByName(more).where("a != b").distinct()
    degree = every.select(F.explode(F.array("a", "b")).alias("first")).groupBy("first").agg(F.count(F.lit(1)).alias("n_links"))
    linked = stored(joined.select(F.col("doc_id").alias("first"), "class_id").join(degree, "first", "left"), "linked", n)
    # The left side of these joins may hold a third of all rows under one text; merge joins let Spark split it.
    of = members.join(linked.hint("merge"), "first", "left").select("doc_id", F.coalesce("class_id", "first").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    of = of.groupBy(F.col("doc_id").alias("key")).agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links"))
    all_ids = texts.select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).alias("key"))
    got = all_ids.join(of.hint("merge"), "key", "left").select("doc_id", F.coalesce("class_id", "key").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return got.select("doc_id", F.when(F.col("class_id") != NULL_ID, F.col("class_id")).alias("class_id"), "n_links")


def _repeated(members: DataFrame) -> DataFrame:
    """Ids with several texts link those texts' first documents."""
    more = members.groupBy("doc_id").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a < b")
    return members.join(more, "doc_id").select("a", F.col("first").alias("b")).where("a < b").distinct()
