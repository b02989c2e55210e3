"""Plain single-process versions of the operators, written from their contracts, to hold results against."""

import collections
import hashlib
import math
import re
from itertools import accumulate

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def op1(docs):
    """Words covered by a 20-word window that also starts earlier."""
    seen, out = set(), {}
    for i, text in docs:
        words = WORD.findall(text)
        gone = [False] * len(words)
        for at in range(len(words) - 19):
            window = tuple(words[at : at + 20])
            if window in seen:
                gone[at : at + 20] = [True] * 20
            seen.add(window)
        out[i] = (len(words), sum(gone), sha(" ".join(w for w, g in zip(words, gone) if not g)))
    return out


def line_key(line):
    return line.strip(" \t\n\r\x0b\x0c").translate(LOWER)


def op8(docs):
    holders = collections.defaultdict(set)
    for i, text in docs:
        for line in text.split("\n"):
            if len(line_key(line)) >= 20:
                holders[line_key(line)].add(i)
    out = {}
    for i, text in docs:
        lines = text.split("\n")
        stays = [line for line in lines if len(holders.get(line_key(line), ())) < 3 or max(holders[line_key(line)]) == i]
        out[i] = (len(lines), len(lines) - len(stays), sha("\n".join(stays)))
    return out


def op10(docs, benchmark):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for item, text in benchmark:
        words = word.findall((text or "").translate(LOWER))
        n = min(10, len(words))
        for at in range(len(words) - n + 1):
            if n:
                windows.setdefault(tuple(words[at : at + n]), set()).add(str(item))
    out = {}
    for i, text in docs:
        words, hit, items = word.findall(text.translate(LOWER)), set(), set()
        for n in {len(w) for w in windows}:
            for at in range(len(words) - n + 1):
                found = windows.get(tuple(words[at : at + n]))
                if found:
                    hit.update(range(at, at + n))
                    items |= found
        out[i] = (len(words), len(hit), len(items), sha(",".join(sorted(items))), bool(hit))
    return out


def op5(docs):
    out = {}
    for i, text in docs:
        words, starts, covered = WORD.findall(text), {}, set()
        for at in range(len(words) - 4):
            starts.setdefault(tuple(words[at : at + 5]), []).append(at)
        for at in starts.values():
            if len(at) > 1:
                for a in at:
                    covered.update(range(a, a + 5))
        seen, repeated = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                repeated += line in seen
                seen.add(line)
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        out[i] = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered), failed)
    return out


def longest_repeat(text):
    """Most words of a string of five words or more that is found twice in a text: longer windows until none repeats."""
    words, n = WORD.findall(text), 0
    while True:
        width = n + 1
        windows = collections.Counter(tuple(words[at : at + width]) for at in range(len(words) - width + 1))
        if not windows or max(windows.values()) < 2:
            return n if n >= 5 else 0
        n = width


def spans(docs, kinds):
    out = {}
    for i, text in docs:
        got = [(m.start(), n, m.end()) for n, (_, pattern, ok) in enumerate(kinds) for m in pattern.finditer(text) if ok(m)]
        counts = [sum(k == n for _, k, _ in got) for n in range(len(kinds))]
        out[i] = (*counts, sha(",".join(f"{kinds[k][0]}:{s}:{e}" for s, k, e in sorted(got))))
    return out


def luhn(digits):
    total = 0
    for j, c in enumerate(reversed(digits)):
        value = int(c) * (1 + j % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def digits_of(text):
    return re.sub("[^0-9]", "", text)


PII = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(digits_of(m[0])) <= 19 and luhn(digits_of(m[0]))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(digits_of(m[0])) <= 15),
]
SECRETS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def bags(docs):
    """Counts of five-word shingles of each document that has words; a shorter text is one shingle."""
    out = {}
    for i, text in docs:
        words = tuple(WORD.findall(text))
        if words:
            out[i] = collections.Counter([words[at : at + 5] for at in range(len(words) - 4)] or [words])
    return out


def tf_idf(docs):
    """Weighted shingles of each document, with exact document frequencies above the floor."""
    all_bags, n = bags(docs), len(docs)
    df = collections.Counter(s for bag in all_bags.values() for s in bag)
    floor = max(1, n / 1000, sum(map(len, all_bags.values())) / 2**21)
    return {i: {s: (1 + math.log(k)) * (1 + math.log((1 + n) / (1 + max(df[s], floor))) / math.log(1000)) for s, k in bag.items()} for i, bag in all_bags.items()}


def jaccard(a, b):
    return sum(min(a.get(s, 0), b.get(s, 0)) for s in {*a, *b}) / sum(max(a.get(s, 0), b.get(s, 0)) for s in {*a, *b})


def near(docs, similarity=0.8):
    """Classes by TF-IDF weighted Jaccard similarity of five-word shingles, over all pairs that share one."""
    weighted, parent, holders = tf_idf(docs), {i: i for i, _ in docs}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, bag in weighted.items():
        for s in bag:
            holders.setdefault(s, []).append(i)
    for a, b in {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}:
        if find(a) != find(b) and jaccard(weighted[a], weighted[b]) >= similarity * (1 - 1e-9):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def crf_spans(text, model, cut=0.8):
    """Spans that a random field adds to a text, one sequence at a time, by plain Viterbi and forward-backward loops."""
    import numpy as np

    from glycoflow.llm import pii

    out = []
    for at, lo, hi in pii._sequences(text):
        if not at:
            continue
        e = model.w[pii._features([text[a:b] for a, b in at])].sum(1)
        t, n = model.t + model.bar, len(at)
        best, back = [e[0] + model.first], []
        alpha, beta = [e[0] + model.first], [np.zeros(len(t))]
        for k in range(1, n):
            back.append((best[-1][:, None] + t).argmax(0))
            best.append((best[-1][:, None] + t).max(0) + e[k])
            alpha.append(np.logaddexp.reduce(alpha[-1][:, None] + t, axis=0) + e[k])
            beta.insert(0, np.logaddexp.reduce(t + e[n - k] + beta[0], axis=1))
        path = [int(best[-1].argmax())]
        for b in reversed(back):
            path.insert(0, int(b[path[0]]))
        total = np.logaddexp.reduce(alpha[-1])
        sure = [float(np.exp(a[x] + b[x] - total)) for a, b, x in zip(alpha, beta, path)]
        out += [span for first, span in pii._marked(text, at, path, sure, cut) if lo <= first < hi]
    return out


def logistic(keys, labels, texts, dim, steps=300, rate=0.5, ridge=1e-3):
    """Scores of texts by logistic regression on hashed character n-grams, with dense rows and AdaGrad."""
    import numpy as np

    from glycoflow.llm.kernels import rolling

    def row(key):
        raw, x = np.frombuffer(re.sub("[0-9]", "0", key).encode(), np.uint8).astype(np.uint64) + np.uint64(1), np.zeros(dim + 1)
        grams = [int(rolling(raw[i : i + k], k)[0]) % dim for k in (3, 4, 5) for i in range(len(raw) - k + 1)]
        for g in grams:
            x[g] += 1 / np.sqrt(len(grams))
        x[dim] = 1
        return x

    x, y = np.array([row(k) for k in keys]), np.array(labels, float)
    w, g = np.zeros(dim + 1), np.full(dim + 1, 1e-6)
    keep = np.append(np.ones(dim), 0)
    for _ in range(steps):
        down = x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + ridge * keep * w / len(y)
        g += down**2
        w -= rate * down / np.sqrt(g)
    return [float(1 / (1 + np.exp(-row(k) @ w))) for k in texts]


def quality(stats, ids, labelled, folds, width=3.0, ridge=1e-3, bins=512):
    """Scores by ridge regression on random Fourier features and isotonic regression on unseen folds, in one go.

    stats: a row of statistics for each of ids; labelled: (id, label); folds: the fold of each id.
    """
    import numpy as np

    from glycoflow.llm.quality_classifier import _fourier

    place = {i: k for k, i in enumerate(ids)}
    rows, y = np.array([place[i] for i, _ in labelled]), np.array([q for _, q in labelled], float)
    scale = (stats[rows].mean(0), np.maximum(stats[rows].std(0), 1e-9))
    f = _fourier(stats, scale, width, 256)
    fold, base = np.array([folds[i] for i, _ in labelled]), y.mean()

    def fit(use):
        z = f[rows[use]]
        return np.linalg.solve(z.T @ z + (ridge * use.sum() / 256 + 1e-12) * np.eye(257), z.T @ (y[use] - base))

    unseen = np.zeros(len(y))
    for k in set(fold.tolist()):
        unseen[fold == k] = base + f[rows[fold == k]] @ fit(fold != k)
    return base + f @ fit(fold >= 0), unseen, y


def isotonic(good, n):
    """Weighted isotonic fit by its definition: the largest over starts of the least over ends of the mean between."""
    total, weight = [0, *accumulate(good)], [0, *accumulate(n)]
    size = len(good)
    return [max(min((total[b] - total[a]) / (weight[b] - weight[a]) for b in range(k + 1, size + 1)) for a in range(k + 1)) for k in range(size)]
