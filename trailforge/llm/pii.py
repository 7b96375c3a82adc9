"""Personal data: exact base patterns, and a character-level BiLSTM-CRF that adds spans.

The tagger reads windows of ``WINDOW`` characters that overlap by half and lie
at fixed places of the whole text.  Every kind of span it knows holds a digit or
an at sign, so only windows with one are computed: the others can't hold a
span.  Windows are reconciled over the whole text: each place has the label of
the window in which it lies deepest, so that a span runs on from window to
window; then, surest first, a span is taken if it meets no base span and none
taken before.
It is trained in numpy, in one task, from labelled spans that are generated
from a seed (``labelled``); nothing of the corpus goes into it.
"""

from __future__ import annotations

import hashlib
import pickle
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_slices, sql_type, whole_text, with_columns

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

# Base patterns --------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign back over the local part: one pass, however long a run without an at sign is."""
    free = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
            at = free
        else:
            at += 1


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by start, then kind as listed; leftmost and non-overlapping per kind, failing matches dropped."""
    if not _ANCHOR.search(text):
        return []
    out = [(a, b, "email") for a, b in _emails(text)]
    out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# The tagger -----------------------------------------------------------------------------------

WINDOW, HALF = 96, 48
HIDDEN, EMBED = 20, 10
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
_OTHER, _LETTER, _PAD = 96, 95, 97
#: Mean posterior of a span's labels that it takes to be added.
SURE = 0.9


def _allowed() -> np.ndarray:
    n = len(LABELS)
    ok = np.ones((n, n), bool)
    for j, to in enumerate(LABELS):
        if to[0] == "I":
            ok[:, j] = [x[1:] == to[1:] and x[0] in "BI" for x in LABELS]
    return ok


_FORBID = np.where(_allowed(), 0.0, -1e4)
_FIRST = np.array([-1e4 if x[0] == "I" else 0.0 for x in LABELS])


def char_ids(text: str) -> np.ndarray:
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.where((cps >= 32) & (cps < 127), cps - 32, np.where(cps >= 192, _LETTER, _OTHER))
    return out.astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    """A bidirectional LSTM over characters with a CRF on top; batches are arrays ``(time, batch)``."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": f(_PAD + 1, EMBED) * 3, "W": f(2 * HIDDEN, len(LABELS)), "c": np.zeros(len(LABELS), np.float32), "T": np.zeros((len(LABELS),) * 2, np.float32)}
        for d in "fb":
            self.p |= {"X" + d: f(EMBED, 4 * HIDDEN), "H" + d: f(HIDDEN, 4 * HIDDEN), "b" + d: np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)}

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states of one direction (``x`` already turned round for the backward one)."""
        steps, n = x.shape[:2]
        xs = x @ self.p["X" + d] + self.p["b" + d]
        w = self.p["H" + d]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, tape = np.empty((steps, n, HIDDEN), np.float32), []
        for t in range(steps):
            z = xs[t] + h @ w
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            if keep:
                tape.append((i, f, o, g, before, tc, h))
            h = o * tc
            out[t] = h
        return out, tape

    def _back(self, x: np.ndarray, d: str, tape: list, dh_out: np.ndarray, grad: dict) -> np.ndarray:
        w, wx = self.p["H" + d], self.p["X" + d]
        dh, dc = np.zeros_like(tape[0][6]), np.zeros_like(tape[0][6])
        dz_all = np.empty((len(tape), dh.shape[0], 4 * HIDDEN), np.float32)
        for t in range(len(tape) - 1, -1, -1):
            i, f, o, g, before, tc, h = tape[t]
            dh = dh + dh_out[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            dz_all[t] = dz
            grad["H" + d] += h.T @ dz
            dh, dc = dz @ w.T, dc * f
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        grad["X" + d] += x.reshape(-1, EMBED).T @ flat
        grad["b" + d] += flat.sum(0)
        return dz_all @ wx.T

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Emission scores ``(time, batch, label)``."""
        x = self.p["E"][ids]
        h = np.concatenate([self._run(x, "f", False)[0], self._run(x[::-1], "b", False)[0][::-1]], 2)
        return h @ self.p["W"] + self.p["c"]

    def _forward(self, e: np.ndarray) -> np.ndarray:
        t = self.p["T"] + _FORBID
        a = np.empty(e.shape)
        a[0] = e[0] + _FIRST
        for k in range(1, len(e)):
            a[k] = e[k] + _lse(a[k - 1][:, :, None] + t, 1)
        return a

    def _backward(self, e: np.ndarray) -> np.ndarray:
        t = self.p["T"] + _FORBID
        b = np.zeros(e.shape)
        for k in range(len(e) - 2, -1, -1):
            b[k] = _lse(t + (e[k + 1] + b[k + 1])[:, None, :], 2)
        return b

    def marginals(self, e: np.ndarray) -> np.ndarray:
        a, b = self._forward(e), self._backward(e)
        return np.exp(a + b - _lse(a[-1], 1)[None, :, None])

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        t = self.p["T"] + _FORBID
        v, back = e[0] + _FIRST, np.empty(e.shape, np.int64)
        for k in range(1, len(e)):
            s = v[:, :, None] + t
            back[k] = s.argmax(1)
            v = e[k] + s.max(1)
        path = np.empty(e.shape[:2], np.int64)
        path[-1] = v.argmax(1)
        for k in range(len(e) - 1, 0, -1):
            path[k - 1] = np.take_along_axis(back[k], path[k][:, None], 1)[:, 0]
        return path

    def gradient(self, ids: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood and its gradient."""
        steps, n = ids.shape
        x = self.p["E"][ids]
        hf, tf = self._run(x, "f", True)
        hb, tb = self._run(x[::-1], "b", True)
        h = np.concatenate([hf, hb[::-1]], 2)
        e = h @ self.p["W"] + self.p["c"]
        t = self.p["T"] + _FORBID
        a, b = self._forward(e), self._backward(e)
        z = _lse(a[-1], 1)
        m = np.exp(a + b - z[None, :, None])
        gold = np.take_along_axis(e, y[:, :, None], 2).sum((0, 2)) + t[y[:-1], y[1:]].sum(0)
        de = m.copy()
        np.put_along_axis(de, y[:, :, None], np.take_along_axis(de, y[:, :, None], 2) - 1, 2)
        de = (de / n).astype(np.float32)
        dt = np.zeros_like(t)
        for k in range(steps - 1):
            dt += np.exp(a[k][:, :, None] + t + (e[k + 1] + b[k + 1])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(dt, (y[:-1].ravel(), y[1:].ravel()), -1.0)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["T"] = (dt / n).astype(np.float32)
        grad["W"] = h.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, len(LABELS))
        grad["c"] = de.sum((0, 1))
        dh = de @ self.p["W"].T
        dx = self._back(x, "f", tf, dh[:, :, :HIDDEN], grad)
        dx = dx + self._back(x[::-1], "b", tb, dh[::-1, :, HIDDEN:], grad)[::-1]
        np.add.at(grad["E"], ids.ravel(), dx.reshape(-1, EMBED))
        return float((z - gold).mean()), grad


_SYLLABLES = "ba en ti on ra che de lo mi qu es ver un ge is ta no ér ü ción ment the and ou st".split()


def _word(r: random.Random) -> str:
    w = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
    return w.capitalize() if r.random() < 0.2 else w


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _card(r: random.Random) -> str:
    head = r.choice("3456") + _digits(r, r.choice([13, 14, 14, 14]))
    whole = next(head + d for d in "0123456789" if luhn(head + d))
    sep = r.choice(["", "", " ", "-"])
    return sep.join(whole[i : i + 4] for i in range(0, len(whole), 4))


def _personal(r: random.Random) -> tuple[str, str]:
    kind = r.choice(KINDS)
    if kind == "email":
        return f"{_word(r).lower()}{r.choice(['', '.', '_', '-'])}{r.choice([_word(r).lower(), _digits(r, 2)])}@{r.choice(['mail', 'post', 'web'])}{r.choice(['', _digits(r, 1)])}.{r.choice(['example.com', 'example.org', 'test.net', 'co.uk', 'de'])}", kind
    if kind == "ip":
        return ".".join(str(r.randint(0, 255)) for _ in range(4)), kind
    if kind == "card":
        return _card(r), kind
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return r.choice([f"+1 ({a}) {b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"0{a} {b}{c}", f"+{r.randint(1, 99)}{a}{b}{c}"]), kind


def _harmless(r: random.Random) -> str:
    hexa = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([18, 40])))
    return r.choice([
        str(r.randint(1900, 2030)), f"version {r.randint(1, 9)}.{r.randint(0, 9)}.", f"{r.randint(1, 99)}%", f"${r.randint(1, 999)}.{_digits(r, 2)}", f"password={hexa}", f'token = "{hexa}"',
        "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), f"{r.randint(1, 31)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}", f"{r.randint(1990, 2030)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"@{_word(r)}", f"{_digits(r, r.randint(1, 8))}", f"CC BY-NC 4.{r.randint(0, 9)}.", f"{r.randint(0, 23)}:{_digits(r, 2)}",
        f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", f"{_word(r)}@{_digits(r, 2)}", f"#{_digits(r, 4)}", f"{_word(r)}{_digits(r, 2)}", f"ISBN {_digits(r, 13)}", f"{_digits(r, 2)}/{_digits(r, 2)}",
    ])


def labelled(n: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """``n`` windows of generated prose with labelled spans, as character ids and label ids ``(time, n)``."""
    r = random.Random(seed)
    xs, ys = np.full((WINDOW, n), _PAD), np.zeros((WINDOW, n), np.int64)
    for k in range(n):
        text, y = "", []
        offset = r.randint(0, 30)
        while len(text) < WINDOW + offset:
            roll = r.random()
            if roll < 0.16:
                part, kind = _personal(r)
                i = 1 + 2 * KINDS.index(kind)
                lab = [i] + [i + 1] * (len(part) - 1)
            else:
                part = _harmless(r) if roll < 0.3 else _word(r)
                lab = [0] * len(part)
            tail = r.choice([" ", " ", " ", " ", ", ", ". ", "\n", ".\n"])
            text, y = text + part + tail, y + lab + [0] * len(tail)
        ids, y = char_ids(text)[offset : offset + WINDOW], np.array(y[offset : offset + WINDOW])
        if y[0] and y[0] % 2 == 0:  # a span that the window cuts starts at its edge
            y[0] -= 1
        if r.random() < 0.1:  # texts end
            end = r.randint(10, WINDOW)
            ids, y = ids[:end], y[:end]
        xs[: len(ids), k], ys[: len(y), k] = ids, y
    return xs, ys


def train(examples: int = 4800, batch: int = 48, epochs: int = 3, rate: float = 0.012, seed: int = 7) -> Tagger:
    """A tagger from generated labelled spans, by Adam with a falling rate."""
    tagger = Tagger(seed)
    xs, ys = labelled(examples)
    m = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    v = {k: np.zeros_like(x) for k, x in tagger.p.items()}
    step, steps = 0, epochs * (examples // batch)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for at in order.permutation(examples)[: examples // batch * batch].reshape(-1, batch):
            step += 1
            _, grad = tagger.gradient(xs[:, at], ys[:, at])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            now = rate * (1 - step / (steps + 1))
            for k, g in grad.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                tagger.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return tagger


_TRAINED: dict[str, Tagger] = {}


def trained(spark: SparkSession) -> Tagger:
    """The tagger, trained once a session, in a task of its own (where numpy keeps to one core)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            yield pd.DataFrame({"p": [pickle.dumps(train().p)]})

    app = spark.sparkContext.applicationId
    if app not in _TRAINED:
        _TRAINED.clear()
        tagger = Tagger()
        tagger.p = pickle.loads(spark.range(0, 1, 1, 1).mapInPandas(run, "p binary").first().p)
        _TRAINED[app] = tagger
    return _TRAINED[app]


def _windows(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an at sign."""
    last = max(0, -(-(len(text) - WINDOW) // HALF))
    starts: set[int] = set()
    for m in _ANCHOR.finditer(text):
        k = m.start() // HALF
        starts.update(min(j, last) for j in (k - 1, k) if j >= 0)
    return sorted(s * HALF for s in starts)


def added_spans(tagger: Tagger, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """The spans that the tagger adds to each text's base spans."""
    places = [(i, s) for i, t in enumerate(texts) for s in _windows(t)]
    paths: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    for at in range(0, len(places), 512):
        part = places[at : at + 512]
        ids = np.full((WINDOW, len(part)), _PAD)
        for j, (i, s) in enumerate(part):
            got = char_ids(texts[i][s : s + WINDOW])
            ids[: len(got), j] = got
        e = tagger.scores(ids)
        path = tagger.viterbi(e)
        sure = np.take_along_axis(tagger.marginals(e), path[:, :, None], 2)[:, :, 0]
        for j, (i, s) in enumerate(part):
            paths.setdefault(i, []).append((s, path[:, j], sure[:, j]))
    out: list[list[Span]] = [[] for _ in texts]
    for i, windows in paths.items():
        if not any(path.any() for _, path, _ in windows):
            continue
        found = sorted((-p, a, b, kind) for p, a, b, kind in _reconciled(len(texts[i]), windows) if p >= SURE and _ANCHOR.search(texts[i], a, b))
        taken = [(a, b) for a, b, _ in base[i]]
        for _, a, b, kind in found:
            if all(b <= c or d <= a for c, d in taken):
                taken.append((a, b))
                out[i].append((a, b, kind))
    return out


def _reconciled(size: int, windows: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[tuple[float, int, int, str]]:
    """Spans with their mean posterior over a whole text: each place has the label of the window in which it lies farthest from an edge.

    A span that a window cuts goes on in the next one, however many it runs through.
    """
    held: dict[int, tuple[int, int, float]] = {}
    for s, path, sure in windows:
        n = min(WINDOW, size - s)
        left = np.arange(n) if s else np.full(n, WINDOW)
        right = np.arange(n)[::-1] if s + n < size else np.full(n, WINDOW)
        for t, deep, y, p in zip(range(n), np.minimum(left, right).tolist(), path.tolist(), sure.tolist(), strict=False):
            if s + t not in held or held[s + t][0] < deep:
                held[s + t] = (deep, y, p)
    now: list[float] = []
    start = before = last = -1
    for at in [*sorted(held), size + 1]:
        _, y, p = held.get(at, (0, 0, 0.0))
        goes_on = y and y % 2 == 0 and now and at == before + 1 and (last + 1) // 2 == y // 2
        if now and not goes_on:
            yield sum(now) / len(now), start, before + 1, KINDS[(last - 1) // 2]
            now = []
        if y:
            if not now:
                start = at
            now.append(p)
        before, last = at, y


def find_spans(tagger: Tagger, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and all spans in order, of each text."""
    base = [base_spans(t) for t in texts]
    busy = [i for i, t in enumerate(texts) if _ANCHOR.search(t)]
    more = dict(zip(busy, added_spans(tagger, [texts[i] for i in busy], [base[i] for i in busy]), strict=True))
    return [(b, sorted(b + more.get(i, []), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))) for i, b in enumerate(base)]


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact_text(text: str, spans: list[Span]) -> str:
    """Each stretch that spans cover, as one mark with the kind of its first."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` for every whole text.

    Counts and the digest are of base spans, ``spans`` lists all; places are
    code points.  A null or empty text has none; repeated rows are searched
    each; an empty table gives no rows; other columns are not read.
    """
    tagger = trained(docs.sparkSession)
    schema = f"doc_id {sql_type(docs, id_col)}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            found = find_spans(tagger, batch["text"].to_pylist())
            counts = [pa.array([sum(k == kind for _, _, k in base) for base, _ in found], pa.int64()) for kind in KINDS]
            digests = pa.array([hashlib.sha256(_listed(base).encode()).hexdigest() for base, _ in found], pa.string())
            listed = pa.array([_listed(spans) for _, spans in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *counts, digests, listed], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with every span in the text replaced by a mark of its kind; null texts stay null."""
    tagger = trained(docs.sparkSession)

    def clean(texts: pa.Array) -> list[pa.Array]:
        held = texts.to_pylist()
        found = find_spans(tagger, [t or "" for t in held])
        return [pa.array([t and redact_text(t, s) for t, (_, s) in zip(held, found, strict=True)], texts.type)]

    return with_columns(docs.withColumn(text_col, F.col(text_col).cast("string")), text_col, {text_col: "string"}, clean)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: personal data in every document."""
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
