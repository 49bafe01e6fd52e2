"""Personal data: fixed patterns, and a linear-chain CRF over word shapes that adds spans.

The CRF labels runs of tokens (split at ASCII white space) that hold a digit or
an at sign; every other token is outside by constraint, which splits the chain
exactly, so only the runs need decoding. The words beside a run are features of
its ends. Runs of a batch are decoded together by Viterbi in numpy. A span of
the model counts if it passes its kind's check (digits, parts, Luhn) and
overlaps no span of the patterns.
"""

from __future__ import annotations

import hashlib
import random
import re
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import map_rows, map_text

KINDS = ("email", "ip", "card", "phone")
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
#: Labelled rows that training reads at most: a bounded sample by hash order.
MAX_TRAIN_ROWS = 4000
BUCKETS = 1 << 13

_ANY = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?:(?<=[\x20\x09-\x0D])|\A)[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_GAP = re.compile(r"[\x20\x09-\x0D]+")
_SPACE = " \t\n\v\f\r"
_EDGE = ".,;:!?\"'<>[]{}*%$&#|="


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Every match holds one at sign and starts at the first allowed character before it."""
    out, last, p = [], 0, text.find("@")
    while p >= 0:
        s = p
        while s > last and text[s - 1] in _LOCAL:
            s -= 1
        m = _HOST.match(text, p) if s < p else None
        if m:
            last = m.end()
            out.append((s, last))
        else:
            last = p + 1  # no later match reaches back over this at sign
        p = text.find("@", last)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points by start, then kind as listed."""
    if not _ANY.search(text):
        return []
    out = [(s, e, 0) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((*m.span(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and luhn(d):
            out.append((*m.span(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((*m.span(), 3))
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


# ---- the model ----------------------------------------------------------------------


def _class(c: str) -> str:
    return "d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c


def shape(token: str) -> str:
    """Digits d, capitals X, other letters x, each run cut at four; the rest as it is, cut at two; of the whole token."""
    return "".join(k * min(sum(1 for _ in run), 4 if k in "dXx" else 2) for k, run in groupby(map(_class, token)))


#: Features of a token.
N_FEATURES = 9


def _cue(word: str | None) -> str:
    """A neighbouring word as a feature: its letters in lower case."""
    return "" if word is None else word.lower().strip(_EDGE + "()-")


def _features(tokens: list[str], left: str | None = None, right: str | None = None) -> list[list[int]]:
    """Buckets of a run's tokens; left and right are the words beside the run, None at an end of the text."""
    shapes = [shape(t) for t in tokens]
    out = []
    for i, t in enumerate(tokens):
        before = shapes[i - 1] if i else "^" if left is None else "w"
        after = shapes[i + 1] if i + 1 < len(tokens) else "$" if right is None else "w"
        digits = sum("0" <= c <= "9" for c in t)
        found = ("s" + shapes[i], "p" + before, "n" + after, "ps" + before + " " + shapes[i], "sn" + shapes[i] + " " + after, f"d{min(digits, 16)}", f"k{'@' in t}{min(t.count('.'), 5)}{min(t.count('-'), 5)}{t[:1] in '+('}", "l" + (_cue(left) if i == 0 else "-"), "r" + (_cue(right) if i + 1 == len(tokens) else "-"))
        out.append([crc32(f.encode()) % BUCKETS for f in found])
    return out


#: A run of tokens with the words before and after it.
Run = tuple[str | None, list[str], str | None]


def runs_of(tokens: list[str], labels: list[str] | None = None) -> list[tuple[Run, list[str]]]:
    """Runs of tokens with a digit or at sign and their labels; all other tokens are outside."""
    out, i = [], 0
    while i < len(tokens):
        j = i
        while j < len(tokens) and _ANY.search(tokens[j]):
            j += 1
        if j > i:
            out.append(((tokens[i - 1] if i else None, tokens[i:j], tokens[j] if j < len(tokens) else None), (labels or [])[i:j]))
        i = j + 1
    return out


def _viterbi(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best labels of (batch, time, label) emissions; chains start and end outside."""
    n, t, _ = emit.shape
    score = emit[:, 0] + trans[0]
    back = np.zeros(emit.shape, dtype=np.int8)
    for i in range(1, t):
        both = score[:, :, None] + trans[None]
        back[:, i] = both.argmax(axis=1)
        score = both.max(axis=1) + emit[:, i]
    out = np.zeros((n, t), dtype=np.int8)
    out[:, -1] = (score + trans[:, 0]).argmax(axis=1)
    for i in range(t - 1, 0, -1):
        out[:, i - 1] = back[np.arange(n), i, out[:, i]]
    return out


def _legal() -> np.ndarray:
    """I-kind follows B-kind or I-kind only."""
    m = np.zeros((len(LABELS), len(LABELS)))
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            m[:, j] = [0 if a[0] != "O" and a[2:] == b[2:] else -1e4 for a in LABELS]
    return m


class Crf:
    """weights (features x labels) and transitions (labels x labels)."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray) -> None:
        self.weights, self.trans = weights, trans

    def decode(self, runs: list[Run]) -> list[list[str]]:
        """Labels of runs of tokens, decoded in batches of like length."""
        emit = [self.weights[np.array(_features(r, left, right))].sum(axis=1) for left, r, right in runs]
        runs = [r for _, r, _ in runs]
        by: dict[int, list[int]] = {}
        for i, r in enumerate(runs):
            by.setdefault(len(r) if len(r) <= 16 else 1 << (len(r) - 1).bit_length(), []).append(i)
        out: list[list[str]] = [[] for _ in runs]
        for t, rows in by.items():
            for k in range(0, len(rows), max(1, (1 << 16) // t)):
                part = rows[k : k + max(1, (1 << 16) // t)]
                block = np.full((len(part), t, len(LABELS)), -1e6)
                block[:, :, 0] = 0.0  # after its end a chain is outside
                for j, i in enumerate(part):
                    block[j, : len(runs[i])] = emit[i]
                for i, best in zip(part, _viterbi(block, self.trans)):
                    out[i] = [LABELS[x] for x in best[: len(runs[i])]]
        return out


def train_crf(rows: list[tuple[Run, list[str]]], steps: int = 120, rate: float = 0.15, decay: float = 1e-3) -> Crf:
    """Maximum likelihood by full-batch Adam; forward and backward sums in numpy."""
    legal, n_l = _legal(), len(LABELS)
    longest = max((len(y) for _, y in rows), default=1)
    n = len(rows)
    w, tr = np.zeros((BUCKETS, n_l)), np.zeros((n_l, n_l))
    if not n:
        return Crf(w, tr + legal)
    feats = np.zeros((n, longest, N_FEATURES), dtype=np.int64)
    gold = np.zeros((n, longest), dtype=np.int64)
    mask = np.zeros((n, longest), dtype=bool)
    for i, ((left, t, right), y) in enumerate(rows):
        feats[i, : len(t)], gold[i, : len(t)], mask[i, : len(t)] = _features(t, left, right), [LABELS.index(a) for a in y], True
    lse = lambda a, ax: (m := a.max(axis=ax, keepdims=True)).squeeze(ax) + np.log(np.exp(a - m).sum(axis=ax))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(tr), np.zeros_like(tr)]
    want_e = np.zeros((n, longest, n_l))
    np.put_along_axis(want_e, gold[:, :, None], 1.0, axis=2)
    path = np.concatenate([np.zeros((n, 1), dtype=np.int64), gold, np.zeros((n, 1), dtype=np.int64)], axis=1)
    want_t = np.zeros((n_l, n_l))
    np.add.at(want_t, (path[:, :-1].ravel(), path[:, 1:].ravel()), 1.0)
    outside = np.full(n_l, -1e6)
    outside[0] = 0
    for step in range(1, steps + 1):
        full = tr + legal
        emit = np.where(mask[:, :, None], w[feats].sum(axis=2), outside)
        alpha = np.empty_like(emit)
        alpha[:, 0] = emit[:, 0] + full[0]
        for i in range(1, longest):
            alpha[:, i] = lse(alpha[:, i - 1, :, None] + full[None], 1) + emit[:, i]
        beta = np.empty_like(emit)
        beta[:, -1] = full[:, 0]
        for i in range(longest - 2, -1, -1):
            beta[:, i] = lse(full[None] + (emit[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
        z = lse(alpha[:, -1] + full[:, 0], 1)
        p = np.exp(alpha + beta - z[:, None, None])
        g_e = np.where(mask[:, :, None], p - want_e, 0.0)
        got_t = np.zeros_like(tr)
        got_t[0] += p[:, 0].sum(axis=0)
        got_t[:, 0] += p[:, -1].sum(axis=0)
        for i in range(1, longest):
            got_t += np.exp(alpha[:, i - 1, :, None] + full[None] + (emit[:, i] + beta[:, i])[:, None, :] - z[:, None, None]).sum(axis=0)
        g_w = np.zeros_like(w)
        for k in range(N_FEATURES):
            np.add.at(g_w, feats[:, :, k][mask], g_e[mask])
        grads = [g_w / n + decay * w, (got_t - want_t) / n + decay * tr]
        for x, g, m, v in ((w, grads[0], moments[0], moments[1]), (tr, grads[1], moments[2], moments[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(w, tr + legal)


#: Words that stand before data of a kind, and before other numbers.
CUES = {"email": ("mail", "e-mail", "contact", "write"), "ip": ("ip", "host", "address", "server"), "card": ("card", "visa", "credit", "account"), "phone": ("call", "phone", "tel", "fax", "mobile"), "none": ("page", "order", "version", "section", "in", "about", "no")}


def sample_rows(n: int = 800, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """A small labelled table: tokens around made-up personal data and around other numbers."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7)))
    tail = lambda: r.choice(["", "", "", ".", ",", ";", ")", "%%%", "***"])

    def card() -> str:
        body = r.choice("3456") + d(r.choice([14, 14, 13, 11]))
        return next(body + c for c in "0123456789" if luhn(body + c))

    def cut(x: str, sep: str) -> list[str]:
        return [x[i : i + 4] for i in range(0, len(x), 4)] if sep == " " else [sep.join(x[i : i + 4] for i in range(0, len(x), 4))]

    out = []
    for _ in range(n):
        kind = r.choice(["email", "ip", "card", "phone", "phone", "none", "none", "none"])
        if kind == "email":
            t = [r.choice([word(), f"{word()}.{word()}", f"{word()}{d(2)}", d(2)]) + "@" + r.choice([f"{word()}.{word()}", f"{word()}{d(1)}.{word()}.com", word()])]
        elif kind == "ip":
            t = [".".join(str(r.randint(0, 255)) for _ in range(4))]
        elif kind == "card":
            t = cut(card(), r.choice([" ", "-", ""]))
        elif kind == "phone":
            a, b, c, cc = d(3), d(3), d(4), r.choice(["1", "44", "49", "33"])
            t = r.choice([[f"+{cc}", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], [f"+{cc}-{a}-{b}-{c}"], [f"+{cc}", a, b, c], [f"1-{a}-{b}-{c}"]])
        else:
            t = r.choice([[d(r.randint(1, 4))], ["19" + d(2)], [f"{d(1)}.{d(1)}.{d(1)}"], [f"{d(4)}-0{d(1)}-1{d(1)}"], [f"${d(2)}.{d(2)}"], [d(2) + "%"], [word() + d(2)], [d(r.randint(5, 20))], [f"{d(2)}:{d(2)}:{d(2)}"], [d(2), d(3), d(1)], [hashlib.sha1(d(5).encode()).hexdigest()], ["@" + word()], [f"{d(3)},{d(3)}"], [f"v{d(1)}.{d(2)}"], [f"({d(4)})"], [f"{d(2)}/{d(2)}/{d(4)}"], [f"{d(3)}-{d(2)}"]])
        y = ["O"] * len(t) if kind == "none" else [f"B-{kind}"] + [f"I-{kind}"] * (len(t) - 1)
        t[-1] += tail()
        if r.random() < 0.15:
            t, y = [d(r.randint(1, 3)) + ","] + t, ["O"] + y
        # words around it: half of the time one that tells the kind
        cue = r.choice(CUES[kind]) + r.choice(["", ":"]) if r.random() < 0.5 else word()
        before, after = [word() for _ in range(r.randint(0, 2))] + [cue], [word() for _ in range(r.randint(0, 2))]
        if r.random() < 0.1:
            before = []
        out.append((before + t + after, ["O"] * len(before) + y + ["O"] * len(after)))
    return out


def sample_table(spark: SparkSession, n: int = 800, seed: int = 5) -> DataFrame:
    return spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(sample_rows(n, seed))], "row_id long, tokens array<string>, labels array<string>")


def fit(labelled: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Crf:
    """A model from (tokens, labels) rows: at most max_rows, chosen by the hash of their content."""
    rows = labelled.where("tokens is not null and size(tokens) = size(labels)").orderBy(F.xxhash64("tokens", "labels")).limit(max_rows).select("tokens", "labels").collect()
    return train_crf([run for r in rows for run in runs_of(list(r.tokens), list(r.labels))])


def _beside(text: str, at: int, step: int) -> str | None:
    """The word before (step -1) or after (step 1) a place at a token's edge; None if there is none."""
    edge = lambda k: k - 1 if step < 0 else k
    inside = lambda k: 0 <= edge(k) < len(text)
    while inside(at) and text[edge(at)] in _SPACE:
        at += step
    end = at
    while inside(end) and text[edge(end)] not in _SPACE:
        end += step
    return text[min(at, end) : max(at, end)] or None


def _checked(text: str, s: int, e: int, kind: str) -> tuple[int, int, str] | None:
    while s < e and text[s] in _EDGE:
        s += 1
    while s < e and text[e - 1] in _EDGE:
        e -= 1
    if kind == "phone":
        while s < e and not (text[s].isdigit() or text[s] in "+("):
            s += 1
        while s < e and text[e - 1] not in "0123456789":
            e -= 1
        ok = re.fullmatch(r"\+?[0-9() .-]+", text[s:e]) and 9 <= sum(map(str.isdigit, text[s:e])) <= 15 and re.search(r"[-.() ]", text[s:e])
    elif kind == "email":
        ok = re.fullmatch(r"[\w.%+-]*\w@\w[\w.-]*", text[s:e])
    elif kind == "ip":
        ok = re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", text[s:e]) and all(int(p) <= 255 for p in text[s:e].split("."))
    else:
        d = re.sub(r"[^0-9]", "", text[s:e])
        ok = re.fullmatch(r"[0-9 .-]+", text[s:e]) and 12 <= len(d) <= 19 and luhn(d)
    return (s, e, kind) if ok and s < e else None


def find_spans(crf: Crf, texts: list[str]) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """(spans of the patterns, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    runs, where = [], []
    for i, t in enumerate(texts):
        if not _ANY.search(t):
            continue
        run: list[tuple[int, int]] = []
        for m in _TOKEN.finditer(t):
            if run and not _GAP.fullmatch(t, run[-1][1], m.start()):
                where.append((i, run))
                run = []
            run.append(m.span())
        if run:
            where.append((i, run))
    runs = [(_beside(texts[i], run[0][0], -1), [texts[i][s:e] for s, e in run], _beside(texts[i], run[-1][1], 1)) for i, run in where]
    added: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for (i, run), labels in zip(where, crf.decode(runs)):
        k = 0
        while k < len(run):
            if labels[k][0] != "B":
                k += 1
                continue
            j = k + 1
            while j < len(run) and labels[j][0] == "I":
                j += 1
            span = _checked(texts[i], run[k][0], run[j - 1][1], labels[k][2:])
            if span and not any(s < span[1] and span[0] < e for s, e, _ in base[i]):
                added[i].append(span)
            k = j
    return [(b, sorted(b + a, key=lambda x: (x[0], KINDS.index(x[2])))) for b, a in zip(base, added)]


def as_text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def report(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans).

    Counts and hash are those of the patterns; spans has all. A null text is
    empty; repeated rows give repeated rows; an empty table gives none. The
    model's size is fixed, so it is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def setup():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            found = find_spans(shared.value, [t or "" for t in b.column("__text").to_pylist()])
            counts = [pa.array([sum(x[2] == k for x in s) for s, _ in found], pa.int64()) for k in KINDS]
            sha = [hashlib.sha256(as_text(s).encode()).hexdigest() for s, _ in found]
            return pa.RecordBatch.from_arrays([b.column("__id"), *counts, pa.array(sha, pa.string()), pa.array([as_text(a) for _, a in found], pa.string())], names=[id_col, *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

        return work

    return map_text(docs, {"__id": id_col, "__text": text_col}, "__text", setup, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Overlapping spans become one mark, of the first one's kind."""
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, crf: Crf, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs, all columns, with every span replaced by [KIND]; null texts stay null.

    length_col, where given, is set to the new length of changed texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    at = docs.columns.index(text_col)
    n_at = docs.columns.index(length_col) if length_col else -1

    def setup():
        def work(b: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
            old = texts.to_pylist()
            found = find_spans(shared.value, [t or "" for t in old])
            new = [t if t is None or not a else redact_text(t, a) for t, (_, a) in zip(old, found)]
            cols = list(b.columns)
            cols[at] = pa.array(new, texts.type)
            if n_at >= 0:
                kept = cols[n_at].to_pylist()
                cols[n_at] = pa.array([len(n) if a else k for n, k, (_, a) in zip(new, kept, found)], cols[n_at].type)
            return pa.RecordBatch.from_arrays(cols, schema=b.schema)

        return work

    return map_rows(docs, text_col, setup)
