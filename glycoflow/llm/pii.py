"""Personal data: patterns, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, slices
from .kernels import text_bytes
from .spans import Span, byte_kind, joined, texts_with, texts_with_run

KINDS = ["email", "ip", "card", "phone"]
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PLACES = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern's leftmost matches, found from each @: linear in the text, however long its runs are."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _PLACES:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    n = [int(d) for d in reversed(digits)]
    return (sum(n[::2]) + sum(sum(divmod(2 * d, 10)) for d in n[1::2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    out = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return out


# --- the conditional random field -------------------------------------------------------------------------------

LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
_SIZES = [4096, 256, 4096, 16, 16, 256, 4096, 64, 16]
#: Words that say what a number or a name may be, or that it is none of these kinds.
_CUES = {
    "phone": "phone tel telefon telephone teléfono call ring dial appeler appelez rufen ruf llame fax mobile handy cell whatsapp hotline sekretariat",
    "mail": "mail email e-mail write send contact kontakt address adresse escríbanos anfragen gmail cc from reply-to",
    "card": "card visa mastercard carte tarjeta kreditkarte charged account",
    "host": "ip host server client ssh ping connect login router printer",
    "none": "version release section chapter kapitel article firmware build page pages isbn order date no nr serial room room zimmer model iban invoice case id sha1 checksum score row code part",
}
_CUE = {word: i for i, words_ in enumerate(_CUES.values(), 1) for word in words_.split()}
_NUMBER = re.compile(r"[+(]*[0-9][0-9().+/-]*[.,;:!?]?")


def _code(text: str, n: int) -> int:
    h = 2166136261
    for c in text.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return h % n


_CLASSES = [re.compile(x) for x in (
    r"[a-zà-ÿ]+", r"[A-ZÀ-Þ][a-zà-ÿ]+", r"[A-Z]+", r"[0-9]+", r"[0-9]+(?:\.[0-9]+){3}", r"[0-9]+(?:[.,:][0-9]+)+", r"[+(]*[0-9][0-9()+/-]*[.-]?[0-9()/-]*",
    r"[(<]?[\w.%+-]+@[\w-]+(?:\.[\w-]+)+[)>]?", r"\S+[(\[{](?:at|AT)[)\]}]\S+", r"@|[(\[{](?:at|AT)[)\]}]|AT|at", r"[(\[{](?:dot|DOT|punto)[)\]}]|DOT|dot|\.", r"[\w-]+(?:\.[\w-]+)+", r"\w+", r"\W+",
)]


def _class(word: str) -> int:
    """What a word looks like: 1 to 14 by the first pattern that fits all of it but the marks at its end; else 0."""
    bare = word.rstrip(".,;:!?") or word
    return next((i for i, p in enumerate(_CLASSES, 1) if p.fullmatch(bare)), 0) if len(word) < 200 else 0


def _rows_of_numbers(tokens: list[str]) -> list[int]:
    """For each token of a row of numbers, a code of the lengths of all digit groups of that row; 0 elsewhere."""
    out, i = [0] * len(tokens), 0
    while i < len(tokens):
        j = i
        while j < len(tokens) and len(tokens[j]) < 40 and _NUMBER.fullmatch(tokens[j]):
            j += 1
            if tokens[j - 1][-1] in ".,;:!?":
                break
        if j > i:
            groups = ".".join(str(len(g)) for g in re.findall("[0-9]+", " ".join(tokens[i:j]))[:12])
            out[i:j] = [1 + _code(groups, 4095)] * (j - i)
        i = max(j, i + 1)
    return out


def _features(tokens: list[str]) -> np.ndarray:
    """Word-shape features of each token.

    Collapsed shape; classes of the two words before and the one after; marks; length; its own class; classes beside it;
    the row of numbers that it is in; cues among the three words before; words for `at` and `dot` within two words.
    """
    n, row = len(tokens), _rows_of_numbers(tokens)
    kind = [0, 0, *map(_class, tokens), 0, 0]
    cue = [_CUE.get(w.lower().strip(".:,;()"), 0) for w in tokens]
    out = []
    for i, w in enumerate(tokens):
        shape = re.sub(r"(.)\1+", r"\1", "".join("9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c for c in w[:200]))
        marks = ".".join(str(min(w.count(c), 3)) for c in "@.-()+:/")
        near = next((c for c in reversed(cue[max(0, i - 3) : i]) if c), 0)
        around = sum((x in (10, 11)) << b for b, x in enumerate((kind[i], kind[i + 1], kind[i + 3], kind[i + 4])))
        out.append((_code(shape, 4096), 16 * kind[i] + kind[i + 1], _code(marks, 4096), min(len(w), 15), kind[i + 2], 16 * kind[i + 1] + kind[i + 3], row[i], 8 * (cue[i - 1] if i else 0) + near, around))
    return np.array(out, np.int64).reshape(n, len(_SIZES)) + np.cumsum([0, *_SIZES[:-1]])


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(r) for r in rows])
    x = np.zeros((len(rows), n.max(), len(_SIZES)), np.int64)
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    return x, np.arange(n.max())[None, :] < n[:, None]


def _forward_backward(e: np.ndarray, t: np.ndarray, first: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward and backward sums of all rows at once; what is beyond a row's end repeats its last step."""
    b, n, m = e.shape
    alpha, beta, scale = np.zeros((b, n, m)), np.ones((b, n, m)), np.ones((b, n, 1))
    for k in range(n):
        now = e[:, k] * (alpha[:, k - 1] @ t if k else np.exp(first))
        scale[:, k] = np.where(mask[:, k, None], now.sum(1, keepdims=True), 1)
        alpha[:, k] = np.where(mask[:, k, None], now / scale[:, k], alpha[:, k - 1])
    for k in range(n - 2, -1, -1):
        beta[:, k] = np.where(mask[:, k + 1, None], (e[:, k + 1] * beta[:, k + 1]) @ t.T / scale[:, k + 1], 1)
    return alpha, beta, scale


class Crf:
    """Emission weights of each feature and label, transitions between labels; B and I steps that cannot be are barred."""

    def __init__(self) -> None:
        n = len(LABELS)
        self.w, self.t = np.zeros((sum(_SIZES), n)), np.zeros((n, n))
        self.bar = np.array([[-1e4 if b[0] == "I" and a[1:] != b[1:] else 0.0 for b in LABELS] for a in LABELS])
        self.first = np.array([-1e4 if x[0] == "I" else 0.0 for x in LABELS])

    def fit(self, rows: list[np.ndarray], labels: list[list[int]], steps: int = 120, rate: float = 0.5, ridge: float = 1e-3) -> Crf:
        """Maximum likelihood by AdaGrad on the whole table; forward and backward sums over all its rows at once."""
        x, mask = _padded(rows)
        b, n, m = *mask.shape, len(LABELS)
        y = np.zeros((b, n), np.int64)
        for i, r in enumerate(labels):
            y[i, : len(r)] = r
        gold = np.eye(m)[y] * mask[..., None]
        both = mask[:, 1:] & mask[:, :-1]
        steps_gold = np.zeros((m, m))
        np.add.at(steps_gold, (y[:, :-1][both], y[:, 1:][both]), 1)
        at = x[mask]
        gw, gt = np.full_like(self.w, 1e-2), np.full_like(self.t, 1e-2)
        for _ in range(steps):
            e, t = self.w[x].sum(2), np.exp(self.t + self.bar)
            e = np.exp(e - e.max(2, keepdims=True))
            alpha, beta, scale = _forward_backward(e, t, self.first, mask)
            p = alpha * beta * mask[..., None]
            pair = t * np.einsum("bki,bkj->ij", alpha[:, :-1] * both[..., None], (e * beta / scale)[:, 1:])
            down_t = pair - steps_gold + ridge * self.t
            down = ridge * self.w
            miss = (p - gold)[mask]
            for f in range(x.shape[2]):
                for k in range(m):
                    down[:, k] += np.bincount(at[:, f], miss[:, k], minlength=len(down))
            gw += down**2
            gt += down_t**2
            self.w -= rate * down / np.sqrt(gw)
            self.t -= rate * down_t / np.sqrt(gt)
        return self

    def decode(self, rows: list[np.ndarray]) -> tuple[list[list[int]], list[list[float]]]:
        """Viterbi over sequences of like length together; beside each label of the best path its marginal probability."""
        out: list[list[int]] = [[]] * len(rows)
        sure: list[list[float]] = [[]] * len(rows)
        order = sorted((i for i in range(len(rows)) if len(rows[i])), key=lambda i: len(rows[i]))
        for at in range(0, len(order), 256):
            part = order[at : at + 256]
            x, mask = _padded([rows[i] for i in part])
            e, t = self.w[x].sum(2), self.t + self.bar
            best, back = e[:, 0] + self.first, []
            for k in range(1, mask.shape[1]):
                step = best[:, :, None] + t
                back.append(np.where(mask[:, k, None], step.argmax(1), np.arange(len(LABELS))))
                best = np.where(mask[:, k, None], step.max(1) + e[:, k], best)
            path = [best.argmax(1)]
            for b in reversed(back):
                path.append(b[np.arange(len(part)), path[-1]])
            paths = np.array(path[::-1]).T
            alpha, beta, _ = _forward_backward(np.exp(e - e.max(2, keepdims=True)), np.exp(t), self.first, mask)
            p = alpha * beta
            p = np.take_along_axis(p, paths[..., None], 2)[..., 0] / p.sum(2)
            for i, x, q in zip(part, paths, p):
                out[i], sure[i] = x[: len(rows[i])].tolist(), q[: len(rows[i])].tolist()
        return out, sure


def labelled_table() -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The small labelled table beside this file: sentences with {{kind|value}} around personal data, and harmless numbers."""
    rows = []
    for line in Path(__file__).with_name("labelled_pii.txt").read_text(encoding="utf-8").splitlines():
        text, spans = "", []
        for part in re.split(r"(\{\{\w+\|.*?\}\})", line):
            m = re.fullmatch(r"\{\{(\w+)\|(.*)\}\}", part)
            if m:
                spans.append((m[1], len(text), len(text) + len(m[2])))
            text += m[2] if m else part
        rows.append((text, spans))
    return rows


def training_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, [f"{k}:{s}:{e}" for k, s, e in spans]) for t, spans in labelled_table()], "text string, spans array<string>")


def _tokens(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    return [m.span() for m in re.compile(r"\S+").finditer(text, start, len(text) if end is None else end)]


def train(rows: list[tuple[str, list[str]]]) -> Crf:
    x, y = [], []
    for text, spans in rows:
        at = _tokens(text)
        labels = [0] * len(at)
        for span in spans:
            kind, s, e = span.split(":")
            inside = [i for i, (a, b) in enumerate(at) if a < int(e) and int(s) < b]
            for i in inside:
                labels[i] = 1 + 2 * KINDS.index(kind) + (i > inside[0])
        if at:
            x.append(_features([text[a:b] for a, b in at]))
            y.append(labels)
    return Crf().fit(x, y)


#: Longest sequence that is decoded in one, in words; longer lines are cut into such sequences with so much overlap.
SEQUENCE, OVERLAP = 256, 64
_TRIM = " .,;:!?#*$%&|<>\"'"
#: Only lines with a digit or one of these are decoded: nothing else can be data of these kinds.
_MARKS = ["@", "(at)", "[at]", "{at}", "(dot)", "[dot]", "{dot}", " dot ", "punto)"]
_AT = re.compile(r"@|[(\[{](?:at|dot|punto)[)\]}]", re.I)
_DIGIT = re.compile(r"[0-9]")


def _sequences(text: str) -> list[tuple[list[tuple[int, int]], int, int]]:
    """Token spans of what is decoded at once, and the positions in it from and up to which its labels count."""
    out, start = [], 0
    for line in text.split("\n"):
        low = line.lower()
        if _DIGIT.search(line) or any(m in low for m in _MARKS):
            at, step = _tokens(text, start, start + len(line)), SEQUENCE - OVERLAP
            for i in range(0, max(1, len(at) - OVERLAP), step):
                last = i + SEQUENCE >= len(at)
                out.append((at[i : i + SEQUENCE], OVERLAP // 2 if i else 0, len(at) - i if last else SEQUENCE - OVERLAP // 2))
        start += len(line) + 1
    return out


#: Between what stands before and behind it, what makes an address of two words, and what stands between parts of a domain.
_AT_MARK = re.compile(r"[\w%+)-]\s*(?:@|[(\[{]\s*at\s*[)\]}]|(?<=\s)at(?=\s))\s*[\w(]", re.I)
_DOT_MARK = re.compile(r"\w\s*(?:\.|[(\[{]\s*(?:dot|punto)\s*[)\]}]|(?<=\s)(?:dot|punto)(?=\s))\s*\w", re.I)
#: Words of an e-mail address at most, each of its marks written apart.
_ADDRESS = 12


def _bounded(kind: int, value: str) -> bool:
    """What defines a kind, whatever the model says.

    An e-mail address has one mark or word for `at`, behind it one for a dot, and twelve words at most; card numbers
    pass Luhn; parts of an ip are at most 255; phones have 7 to 15 digits.
    """
    if kind == 0:
        at = [m.end() for m in _AT_MARK.finditer(value)]
        return len(at) == 1 and _DOT_MARK.search(value, at[0] - 1) is not None and len(value.split()) <= _ADDRESS
    digits = re.sub("[^0-9]", "", value)
    if kind == 1:
        parts = re.findall("[0-9]+", value)
        return len(parts) >= 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts[:4])
    if kind == 2:
        return 14 <= len(digits) <= 19 and _luhn(digits)
    return 7 <= len(digits) <= 15


def find_pii(docs: DataFrame, labelled: DataFrame | None = None, cut: float = 0.8, max_labelled: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in whole texts; one pass, no shuffle.

    Base kinds are patterns: email, ip (parts at most 255), card (14 to 19 digits that pass Luhn), phone (+ and 10 to
    15 digits).  A linear-chain conditional random field over word shapes adds spans that no base span overlaps: data
    written otherwise, as in `name(at)example(dot)com` or `(555) 010-2345`.  A span is added if each label of the best
    path has a marginal probability of `cut` or more.  The model is fitted on at most `max_labelled` rows (text, spans
    as kind:start:end) of a labelled table, by default the small one in this package, and broadcast (under 1 MB).

    Returns id, n_email, n_ip, n_card, n_phone (long, base only), n_added, base, spans (kind:start:end in code
    points, by start and kind).  A null or empty text has no spans; ids may be null or repeated: rows are judged one
    by one.  An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    prepare(spark)
    labelled = training_table(spark) if labelled is None else labelled
    rows = labelled.select("text", "spans").where("text is not null").limit(max_labelled).collect()
    model = spark.sparkContext.broadcast(train([(r["text"], r["spans"] or []) for r in rows]))
    special = byte_kind("0123456789")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            buf, off = text_bytes(batch.column(1))
            look = np.flatnonzero(texts_with_run(buf, off, special, 1) | _spelled(buf, off)).tolist()
            texts = {i: batch.column(1)[i].as_py() for i in look}
            base = {i: base_spans(t) for i, t in texts.items()}
            parts = [(i, x) for i, t in texts.items() for x in _sequences(t)]
            added: dict[int, list[Span]] = {}
            for (i, (at, lo, hi)), path, sure in zip(parts, *model.value.decode([_features([texts[i][a:b] for a, b in at]) for i, (at, _, _) in parts])):
                for first, span in _marked(texts[i], at, path, sure, cut):
                    if lo <= first < hi and not any(a < span[2] and span[0] < b for a, _, b in base[i]):
                        added.setdefault(i, []).append(span)
            out: list[tuple] = [(0, 0, 0, 0, 0, "", "")] * batch.num_rows
            for i in look:
                if base[i] or i in added:
                    more = added.get(i, [])
                    out[i] = (*(sum(k == x for _, k, _ in base[i]) for x in range(4)), len(more), joined(base[i], KINDS), joined(base[i] + more, KINDS))
            cols = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 7, [pa.int64()] * 5 + [pa.string()] * 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_added", "base", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base string, spans string")


def _spelled(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    return texts_with(buf, off, [m.encode() for m in _MARKS], fold=True)


def _marked(text: str, at: list[tuple[int, int]], path: list[int], sure: list[float], cut: float) -> Iterator[tuple[int, Span]]:
    """Spans of labels B, I, I ... that are sure enough, without marks at their ends, after the number of their first word."""
    i = 0
    while i < len(path):
        if path[i] and path[i] % 2:
            j = i + 1
            while j < len(path) and path[j] == path[i] + 1:
                j += 1
            s, e = at[i][0], at[j - 1][1]
            while e > s and text[e - 1] in _TRIM:
                e -= 1
            while s < e and text[s] in _TRIM:
                s += 1
            kind = path[i] // 2
            if min(sure[i:j]) >= cut and _bounded(kind, text[s:e]):
                yield i, (s, kind, e)
            i = j
        else:
            i += 1
