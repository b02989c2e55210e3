"""Kernels against plain Python, on texts that hypothesis makes up."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from glycoflow.llm import pii, spans
from glycoflow.llm.kernels import ALNUM, LOWER, PLAIN, pack_ints, rolling, span_hashes, text_bytes, unpack_ints, windows, words
from glycoflow.llm.line_dedup import lines
from glycoflow.llm.minhash import _bucket_pairs, shingle_bags, weighted_samples
from glycoflow.llm.packing import WordIds, sum_of_squares
from glycoflow.llm.quality_rules import longest_repeats, rule_counts
from tests.llm import brute

TEXTS = st.lists(st.one_of(st.none(), st.text("ab A\n\té.ß1-", max_size=60), st.text(max_size=20)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_hashes(texts):
    for kind, pattern, fold in ((PLAIN, r"[^\x20\x09-\x0D]+", False), (ALNUM, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", True)):
        buf, off = text_bytes(pa.array(texts, pa.string()))
        buf = LOWER[buf] if fold else buf
        starts, ends, of = words(buf, off, kind)
        low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        want = [re.findall(pattern, (t or "").translate(low) if fold else (t or "")) for t in texts]
        raw = buf.tobytes()
        got = [[raw[s:e].decode() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(of[:-1], of[1:])]
        assert got == want
        h = span_hashes(buf, starts, ends)
        flat = [w for ws in want for w in ws]
        assert len({(w, int(x)) for w, x in zip(flat, h)}) == len(set(flat)) == len({int(x) for x in h})
        for k in (1, 2, 3, 5, 10):
            at, x = windows(h, of, k)
            grams = [tuple(ws[i : i + k]) for ws in want for i in range(len(ws) - k + 1)]
            assert len(at) == len(grams) and len({(g, int(v)) for g, v in zip(grams, x)}) == len(set(grams)) == len({int(v) for v in x})


def test_rolling_is_the_polynomial():
    h = np.random.default_rng(0).integers(0, 2**63, 50, dtype=np.uint64)
    for k in range(1, 22):
        assert len(rolling(h, k)) == 51 - k


def test_long_word_and_blocks():
    text = "x" * 3_000_000 + " y " + "x" * 3_000_000
    buf, off = text_bytes(pa.array([text]))
    h = span_hashes(buf, *words(buf, off)[:2])
    assert h[0] == h[2] != h[1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**62), 2**62), max_size=50))
def test_packed_integers(values):
    a = np.array(values, np.int64)
    assert (unpack_ints(pack_ints(a), np.int64) == a).all()


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_lines(texts):
    buf, off = text_bytes(pa.array(texts, pa.string()))
    s, e, of = lines(buf, off)
    raw = buf.tobytes()
    assert [[raw[s[i] : e[i]].decode() for i in range(a, b)] for a, b in zip(of[:-1], of[1:])] == [(t or "").split("\n") for t in texts]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=5))
def test_longest_repeats(docs):
    h = np.array([x for d in docs for x in d], np.uint64)
    got = longest_repeats(h, np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(int))
    want = []
    for d in docs:
        for i in range(len(d)):
            best = 0
            for j in range(len(d)):
                k = 0
                while i != j and i + k < len(d) and j + k < len(d) and d[i + k] == d[j + k]:
                    k += 1
                best = max(best, k)
            want.append(best)
    assert got.tolist() == want


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_rule_counts(texts):
    got = rule_counts(pa.array(texts, pa.string()))
    want = brute.op5(list(enumerate(t or "" for t in texts)))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert [tuple(int(got[k][i]) for k in names) for i in range(len(texts))] == [want[i][:5] for i in range(len(texts))]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abc dE\n.,é'ñ1´́<|endoftext>!×", max_size=50), max_size=5))
def test_word_ids(texts):
    from tokenizers import Tokenizer

    import public_tokenizers as P

    own = WORDS.encode(*text_bytes(pa.array(texts, pa.string())), 1)
    plain = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids, off = own
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [[*e.ids, 1] for e in plain.encode_batch(texts, add_special_tokens=False)]


WORDS = WordIds(None)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_sum_of_squares(lengths):
    bins, offsets = sum_of_squares(np.array(lengths, np.int64), 40)
    by: dict = {}
    for n, b, o in zip(lengths, bins.tolist(), offsets.tolist()):
        by.setdefault(b, []).append((o, n))
    for spans_ in by.values():
        spans_.sort()
        assert spans_[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans_, spans_[1:])) and sum(spans_[-1]) <= 40
    # Plainly: try every residual gap with an open bin, and a new bin, and take the least sum of squares.
    gaps, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        best = None
        for g in sorted({g for g in gaps if g >= lengths[i]}) + [None]:
            after = list(gaps)
            if g is not None:
                after.remove(g)
            after.append((40 if g is None else g) - lengths[i])
            squares = sum(n**2 for gap, n in Counter(after).items() if gap)
            if best is None or squares < best[0]:
                best = (squares, after)
        gaps = best[1]
    assert sorted(40 - sum(n for _, n in x) for x in by.values()) == sorted(gaps)


def test_repetitive_texts_take_bounded_time_and_memory():
    """Millions of equal words, and a long passage twice: a dozen integers a word, not one array for each doubling."""
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    n = 2_000_000
    got = longest_repeats(np.full(n, 12345, np.uint64), np.array([0, n]))
    assert got[0] == n - 1 and got[-1] == 1 and got[n // 2] == n // 2
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 120 * n / 1024 + 200_000
    part = np.random.default_rng(2).integers(0, 2**63, 50_000, dtype=np.uint64)
    got = longest_repeats(np.concatenate([part, part[:1], part]), np.array([0, 100_001]))
    assert got[0] == 50_000 and got[50_001] == 50_000


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**48, 3000, dtype=np.uint64))
    agree, want = [], []
    for share in (0.9, 0.6, 0.2):
        n = int(len(keys) * share)
        a, b = keys[:n], keys[len(keys) - n :]
        w = lambda k: np.where(k % np.uint64(3) == 0, 0.4, 1.0)
        both = np.intersect1d(a, b)
        want.append(w(both).sum() / (w(a).sum() + w(b).sum() - w(both).sum()))
        codes = weighted_samples(np.array([0, len(a), len(a) + len(b)]), np.concatenate([a, b]), w(np.concatenate([a, b])))
        agree.append((codes[0] == codes[1]).mean())
    assert all(abs(x - y) < 0.22 for x, y in zip(agree, want))


def test_bucket_pairs_connect():
    sig = np.random.default_rng(1).integers(0, 255, (60, 48)).astype(np.uint8)
    sig[:] = sig[0]
    sig[:, 0] = np.arange(60)
    pairs = list(_bucket_pairs(sig))
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {root(x) for x in range(60)} == {0} and len(pairs) <= 60 * 17


def test_short_texts_are_one_shingle():
    offsets, keys, counts, bag = shingle_bags(pa.array(["a b", "a  b", "b a", "", None, "a b c d e f", "a a a a a a"]))
    assert np.diff(offsets).tolist() == [1, 1, 1, 0, 0, 2, 1] and keys[0] == keys[1] != keys[2] and bag[0] == bag[1] != bag[2]
    assert counts.tolist() == [1, 1, 1, 1, 1, 2]


ODD = ["a@b.c", "x@@b.c d@e-f.gh.", "1.2.3.4.5.6.7.8", "999.1.1.1", "1.2.3", "+1 (555) 010-2345 ext", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49+1234567890", "a.b@c.d@e.f", "9" * 6000 + ".1.1.1", "0" * 5000 + "1.1.1.1", "@", "a@", "é@b.c", "a@b..c"]


def test_personal_data_patterns():
    for text in [*ODD, " ".join(ODD), "@".join(ODD)]:
        got = spans.joined(pii.base_spans(text), pii.KINDS)
        want = []
        for n, (k, p, ok) in enumerate(brute.PII):
            for m in p.finditer(text):
                if k == "ip":
                    if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                        want.append((m.start(), n, m.end()))
                elif ok(m):
                    want.append((m.start(), n, m.end()))
        assert got == spans.joined(want, pii.KINDS), text[:80]


@settings(max_examples=200, deadline=None)
@given(st.text("ab1.@+- (4)%", max_size=60))
def test_personal_data_patterns_made_up(text):
    want = [(m.start(), n, m.end()) for n, (_, p, ok) in enumerate(brute.PII) for m in p.finditer(text) if ok(m)]
    assert sorted(pii.base_spans(text)) == sorted(want)


def test_long_runs_stay_quick():
    import time

    began = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "1 " * 150_000):
        pii.base_spans(text)
    assert time.time() - began < 20
