"""Personal data found by a character-level bidirectional LSTM with CRF transitions.

The network labels every character: none, the begin of a value, or inside of one of ``KINDS``
(e-mail, phone, IPv4 address, card number, secret, social security number, IBAN), so values that
touch are two spans; a begin is of the kind that follows it, and without one is nothing. It is trained in numpy from labelled spans: values of many shapes are written
into real passages, and spans that plain patterns find in a bounded sample of the documents
are labelled as well; passages without any stay as negatives, and passages that the model gets
wrong are trained again. Texts are cut into overlapping windows over their whole length; each
window is decoded by Viterbi, every character takes the label of the window in which it is
farthest from an edge, and spans are formed over the whole text, across window borders.

What is found in a text depends on the text and the model alone, whatever it is batched with:
padding keeps the state at zero and can only be without a label. Decoding is exact: a window
is only spared the Viterbi pass where its scores prove that the path without any label is the
best one. Of equal paths the one with lower labels is taken.

Cases: a null text has no spans and stays null; an empty one stays empty. Texts of any
length are scanned whole. Spans of any length count. Null ids and other null columns pass
through, repeated rows are handled alike, an empty table gives an empty result. Extra columns
are kept; one that is called like a result column is replaced by it. Without documents the
model is trained on generated passages alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import appended, by_hash, plus, table, texts, tidy

KINDS = ("NONE", "EMAIL", "PHONE", "IP", "CARD", "SECRET", "SSN", "IBAN")
#: How often training writes in a value of each kind but the first; counting a card's digits takes the most.
SHARES = (0.15, 0.15, 0.12, 0.22, 0.15, 0.09, 0.12)
#: Label k is the inside of kind k; the last is the begin of any.
BEGIN = len(KINDS)
LABELS = BEGIN + 1
RESULT = "spans array<struct<start:int,end:int,label:string>>, redacted string"

#: Weak labels for spans of the sample; only training uses them.
WEAK = (
    (1, re.compile(r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}\b")),
    (5, re.compile(r"\bAKIA[0-9A-Z]{16}\b|\b(?:token|password|secret|api_key)\s?=\s?(?:\"[^\"\s]{8,}\"|[^\s\"]{8,})")),
    (3, re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")),
    (7, re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,4})?(?!\w)")),
    (4, re.compile(r"(?<![\w])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?!\w)")),
    (6, re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    (2, re.compile(r"(?<![\w+])(?:\+\d{1,2}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)")),
)


@dataclass(frozen=True)
class Config:
    hidden: int = 10
    window: int = 384
    overlap: int = 48
    #: Documents that training may take from the table.
    max_docs: int = 700
    steps: int = 800
    batch: int = 48
    length: int = 112
    rate: float = 0.02
    seed: int = 5


def _classes() -> np.ndarray:
    """Character to row: ASCII each its own, others by kind."""
    out = np.full(0x110000, 132, np.uint8)
    out[:128] = np.arange(128)
    for c in range(128, 0x3000):
        kind = unicodedata.category(chr(c))
        out[c] = {"L": 128 if kind == "Ll" else 129, "N": 130, "Z": 131}.get(kind[0], 132)
    out[0x3000:0xE000] = 128
    return out


CLASSES = _classes()
ROWS = 134  # the last is padding
PAD = 133


def codes(text: str) -> np.ndarray:
    return CLASSES[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


# ---------------------------------------------------------------- network; arrays are (units, batch)


def _lstm(x: np.ndarray, u: np.ndarray, ids: np.ndarray, keep: bool = False):
    """x: (4H, rows) gate inputs; u: (4H, H); ids: (T, B). Gates: input, forget, output, candidate (inputs of the sigmoids halved)."""
    t, b = ids.shape
    h = u.shape[1]
    s, c, out, saved = np.zeros((h, b), "f4"), np.zeros((h, b), "f4"), np.empty((t, h, b), "f4"), []
    z, xb, tmp = (np.empty((4 * h, b), "f4") for _ in range(3))
    for k in range(t):
        np.dot(u, s, out=z)
        np.take(x, ids[k], axis=1, out=xb, mode="clip")
        z += xb
        np.tanh(z, out=z)
        g = z[: 3 * h]
        g *= 0.5
        g += 0.5
        if keep:
            saved.append((s, c, z.copy()))
            c = c * z[h : 2 * h] + z[:h] * z[3 * h :]
            tc = np.tanh(c)
            saved[-1] += (tc,)
            s = z[2 * h : 3 * h] * tc
            out[k] = s
        else:
            c *= z[h : 2 * h]
            np.multiply(z[:h], z[3 * h :], out=tmp[:h])
            c += tmp[:h]
            np.tanh(c, out=tmp[:h])
            s = out[k]
            np.multiply(z[2 * h : 3 * h], tmp[:h], out=s)
    return out, saved


def _lstm_back(dout: np.ndarray, saved: list, u: np.ndarray):
    t, h, b = dout.shape
    du, dz_all = np.zeros_like(u), np.empty((t, 4 * h, b), "f4")
    dh, dc = np.zeros((h, b), "f4"), np.zeros((h, b), "f4")
    for k in range(t - 1, -1, -1):
        s, c, z, tc = saved[k]
        i, f, o, g = z[:h], z[h : 2 * h], z[2 * h : 3 * h], z[3 * h :]
        dh = dh + dout[k]
        dc = dc + dh * o * (1 - tc * tc)
        dz = dz_all[k]
        dz[:h] = 2 * dc * g * i * (1 - i)
        dz[h : 2 * h] = 2 * dc * c * f * (1 - f)
        dz[2 * h : 3 * h] = 2 * dh * tc * o * (1 - o)
        dz[3 * h :] = dc * i * (1 - g * g)
        du += dz @ s.T
        dh, dc = u.T @ dz, dc * f
    return dz_all, du


def _still(x: np.ndarray) -> None:
    """Shut the input and forget gates at padding, so that states there are zero."""
    x[: x.shape[0] // 2, PAD] = -1e4


def _emit(p: dict, ids: np.ndarray, keep: bool = False):
    """(T, L, B) label scores; padding can only be without a label."""
    f, sf = _lstm(p["xf"], p["uf"], ids, keep)
    g, sg = _lstm(p["xb"], p["ub"], ids[::-1], keep)
    h = f.shape[1]
    e = np.matmul(p["wo"][:, :h], f)
    e += np.matmul(p["wo"][:, h:], g[::-1])
    e += p["bo"][:, None]
    t, b = np.nonzero(ids == PAD)
    e[t, 1:, b] = -1e6
    return e, (f, sf, g, sg) if keep else None


def _crf_grad(e: np.ndarray, tr: np.ndarray, y: np.ndarray):
    """Loss, and the gradients of scores and transitions; e: (T, L, B), y: (T, B)."""
    t, n, b = e.shape
    e = e.astype("f8")
    al, be = np.empty_like(e), np.zeros_like(e)
    al[0] = e[0]
    lse = lambda x, ax: (m := x.max(ax, keepdims=True)).squeeze(ax) + np.log(np.exp(x - m).sum(ax))
    for k in range(1, t):
        al[k] = e[k] + lse(al[k - 1][:, None, :] + tr[:, :, None], 0)
    for k in range(t - 2, -1, -1):
        be[k] = lse(tr[:, :, None] + (e[k + 1] + be[k + 1])[None], 1)
    z = lse(al[-1], 0)
    de = np.exp(al + be - z)
    dtr = np.exp(al[:-1, :, None] + tr[None, :, :, None] + (e[1:] + be[1:])[:, None] - z).sum((0, 3))
    k, j = np.arange(t)[:, None], np.arange(b)[None]
    loss = z.sum() - e[k, y, j].sum() - tr[y[:-1], y[1:]].sum()
    de[k, y, j] -= 1
    np.add.at(dtr, (y[:-1], y[1:]), -1)
    return loss / b, (de / b).astype("f4"), (dtr / b).astype("f4")


def viterbi(e: np.ndarray, tr: np.ndarray) -> np.ndarray:
    """Best labels (T, B) of scores (T, L, B); of equal paths the one with lower labels."""
    t, n, b = e.shape
    s = np.empty((t, n, b), np.result_type(e, tr))
    s[0] = e[0]
    for k in range(1, t):
        np.max(s[k - 1][:, None] + tr[:, :, None], axis=0, out=s[k])
        s[k] += e[k]
    out = np.empty((t, b), np.int8)
    out[-1] = s[-1].argmax(0)
    for k in range(t - 1, 0, -1):
        out[k - 1] = (s[k - 1] + tr[:, out[k]]).argmax(0)
    return out


def decode(e: np.ndarray, tr: np.ndarray) -> np.ndarray:
    """``viterbi``, spared where no labelled stretch can gain on the path of label 0.

    A stretch of m labelled characters changes the score by at most its advantages plus (m - 1) * stay, what entering
    adds where it doesn't begin the window, and what leaving adds where it doesn't end it. The best sum of any stretch
    is found in one pass; windows whose sum stays under zero by more than rounding can amount to have no label.
    """
    t = e.shape[0]
    stay = float(tr[1:, 1:].max() - tr[0, 0])
    enter, leave = np.float32(tr[0, 1:].max() - tr[0, 0]), np.float32(tr[1:, 0].max() - tr[0, 0])
    lead = np.maximum(e[:, 1], e[:, 2])
    for i in range(3, e.shape[1]):
        np.maximum(lead, e[:, i], out=lead)
    lead -= e[:, 0]
    size = float(np.abs(e[:, 0]).max()) + max(0.0, float(lead.max())) + float(np.abs(tr).max())
    slack = np.float32(4 * np.finfo("f4").eps * t * t * size)  # of sums of t scores and transitions each
    run, best = lead[0].copy(), lead[0].copy()
    for k in range(1, t):
        run += np.float32(stay)
        np.maximum(run, enter, out=run)
        run += lead[k]
        np.maximum(best, run, out=best)
    need = np.maximum(best + leave, run) + slack >= 0
    out = np.zeros((t, e.shape[2]), np.int8)
    if need.any():
        out[:, need] = viterbi(np.ascontiguousarray(e[:, :, need]), tr)
    return out


# ---------------------------------------------------------------- training data


def made_value(rng: np.random.Generator) -> tuple[int, str]:
    """A label and a generated value of it."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    w = lambda a, b: "".join(chr(97 + i) for i in rng.integers(0, 26, int(rng.integers(a, b))))
    pick = lambda *x: x[int(rng.integers(len(x)))]
    kind = 1 + int(rng.choice(len(KINDS) - 1, p=SHARES))
    if kind == 1:
        name = pick(f"{w(3, 10)}.{d(2)}", f"{w(3, 8)}.{w(3, 9)}", w(3, 10), f"{w(2, 7)}_{w(2, 7)}", f"{w(3, 7)}{d(int(rng.integers(1, 4)))}", f"{w(1, 3).upper()}{w(3, 8)}+{w(2, 5)}")
        return 1, f"{name}@{pick(f'mail{d(1)}.example', w(3, 10), f'{w(3, 8)}-{w(2, 6)}', f'{w(2, 6)}.{w(3, 8)}')}.{pick('com', 'org', 'net', 'de', 'fr', 'es', 'io', 'edu')}"
    if kind == 2:
        a, b, c = d(3), pick("555", d(3)), d(4)
        return 2, pick(f"+1 ({a}) {b}-{c}", f"+{d(1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{d(2)} {a} {b} {c}", f"+1-{a}-{b}-{c}", f"+1 ({a}) 555-{c}")
    if kind == 3:
        return 3, ".".join(str(int(x)) for x in rng.integers(0, 256, 4))
    if kind == 4:
        g = [d(4), d(4), d(4), d(4)]
        return 4, pick("", "", " ", "-").join(g)
    if kind == 6:
        return 6, f"{d(3)}-{d(2)}-{d(4)}"
    if kind == 7:
        body = d(18) if rng.random() < 0.6 else w(4, 5).upper() + d(14)
        code = pick("DE", "GB", "FR", "ES", "NL", "IT", "CH", "AT", w(2, 3).upper()) + d(2) + body[: int(rng.integers(11, 19))]
        return 7, pick(code, " ".join(code[i : i + 4] for i in range(0, len(code), 4)))
    hexa = lambda n: "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, n))
    upper = "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"[i] for i in rng.integers(0, 36, 16))
    return 5, pick("AKIA" + upper, "AKIA" + upper, f"password={hexa(18)}", f"password={w(8, 16)}{d(2)}", f'token = "{hexa(40)}"', f'token = "{hexa(32)}"', f"api_key={hexa(32)}")


def made_other(rng: np.random.Generator) -> str:
    """Numbers and signs that are nobody's data."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    forms = (d(int(rng.integers(1, 9))), f"{d(1)}.{d(1)}", f"{d(1)}.{d(1)}.{d(1)}", f"20{d(2)}-0{d(1)}-1{d(1)}", f"{d(2)}:{d(2)}", f"{d(1)},{d(3)}.{d(2)}", f"{d(2)}%", f"${d(3)}", f"#{d(4)}", f"({d(2)})", f"v{d(1)}.{d(2)}", "***", "$$$", "###", "|", "=", "a @ b", "--", "AKA", f"{d(12)}", f"{d(4)}/{d(2)}", "https://www.example.org/a/b?c=1")
    return forms[int(rng.integers(len(forms)))]


def marked(kind: int, n: int) -> np.ndarray:
    """The labels of a value of n characters: a begin, then insides."""
    y = np.full(n, kind, np.int8)
    if kind:
        y[:1] = BEGIN
    return y


def weak_labels(text: str) -> np.ndarray:
    y = np.zeros(len(text), np.int8)
    for label, pattern in WEAK:
        for m in pattern.finditer(text):
            if not y[m.start() : m.end()].any():
                y[m.start() : m.end()] = marked(label, m.end() - m.start())
    return y


def _prose(rng: np.random.Generator, n: int) -> str:
    parts = ("the", "on", "er", "ti", "and", "de", "la", "un", "sch", "ein", "que", "ou", "es", "ing", "re")
    return " ".join("".join(parts[i] for i in rng.integers(0, len(parts), int(rng.integers(1, 4)))) for _ in range(n))


def passages(sample: list[str], cfg: Config) -> list[tuple[str, np.ndarray]]:
    """Labelled passages: windows of the sample, most with values written in."""
    rng = np.random.default_rng(cfg.seed)
    bases: list[str] = [t for t in sample if t] or [_prose(rng, 300) for _ in range(100)]
    out = []
    for _ in range(8 * max(600, len(bases))):
        t = bases[int(rng.integers(len(bases)))]
        at = int(rng.integers(max(1, len(t) - cfg.length)))
        t = t[at : at + cfg.length + 8]
        y = weak_labels(t)
        for _ in range(int(rng.choice(4, p=[0.3, 0.45, 0.2, 0.05]))):
            label, v = made_value(rng) if rng.random() < 0.7 else (0, made_other(rng))
            free = [i for i in range(len(t) + 1) if (i == 0 or t[i - 1] in " \n" or rng.random() < 0.01) and not (0 < i < len(t) and 0 < y[i] < BEGIN)]
            if not free:
                continue
            i = free[int(rng.integers(len(free)))]
            tail = (" ", " ", " ", "\n", ". ", ", ", "; ", ",")[int(rng.integers(8))]
            head = "" if i == 0 or t[i - 1] in " \n" else " "
            t = t[:i] + head + v + tail + t[i:]
            y = np.concatenate([y[:i], np.zeros(len(head), np.int8), marked(label, len(v)), np.zeros(len(tail), np.int8), y[i:]])
        out.append((t, y))
    for t in bases:  # spans of the sample in their own surroundings
        y = weak_labels(t)
        edge = np.flatnonzero(y == BEGIN)
        for i in edge[:3]:
            a = max(0, int(i) - int(rng.integers(8, cfg.length - 40)))
            out.append((t[a : a + cfg.length], y[a : a + cfg.length]))
    return out


class Model:
    def __init__(self, p: dict, cfg: Config):
        self.p, self.cfg = p, cfg

    def labels(self, docs: list[np.ndarray], chunk: int = 1024) -> list[np.ndarray]:
        """The label of each character of coded texts."""
        cfg, w = self.cfg, self.cfg.window
        step, half = w - cfg.overlap, cfg.overlap // 2
        starts, count = [], []
        for d in docs:
            n = 0 if len(d) == 0 else max(0, -(-(len(d) - w) // step)) + 1
            starts.append(np.arange(n) * step)
            count.append(n)
        base = np.cumsum([0] + [len(d) for d in docs])
        total = sum(count)
        out = [np.zeros(len(d), np.int8) for d in docs]
        if not total:
            return out
        flat = np.concatenate([*docs, np.full(w, PAD, np.uint8)])
        owner = np.repeat(np.arange(len(docs)), count)
        at = np.concatenate(starts)
        length = np.minimum(w, np.array([len(d) for d in docs])[owner] - at)
        order = np.argsort(-length, kind="stable")  # windows of like length together
        for i in range(0, total, chunk):
            part = order[i : i + chunk]
            t = int(length[part[0]]) + 1  # every window ends in padding
            idx = (base[owner[part]] + at[part])[None, :] + np.arange(t)[:, None]
            ids = np.where(np.arange(t)[:, None] < length[part][None, :], flat[idx], PAD)
            got = decode(_emit(self.p, ids)[0], self.p["tr"])
            for j in np.flatnonzero(got.any(0)):
                k = part[j]
                d, s, n = owner[k], at[k], length[k]
                lo = 0 if s == 0 else half
                hi = n if s + n >= len(docs[d]) else n - half
                out[d][s + lo : s + hi] = got[lo:hi, j]
        return out

    def spans(self, y: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, kind) of each labelled stretch; a begin, or another kind, starts one."""
        if not y.any():
            return []
        begin = y == BEGIN
        after = np.append(y[1:], 0)
        kind = np.where(begin, np.where(after == BEGIN, 0, after), y).astype(int)
        cut = np.flatnonzero((np.diff(kind) != 0) | begin[1:]) + 1
        edge = [0, *cut.tolist(), len(y)]
        return [(a, b, int(kind[a])) for a, b in zip(edge, edge[1:]) if kind[a]]


def fit(sample: list[str], cfg: Config = Config()) -> Model:
    rng = np.random.default_rng(cfg.seed + 1)
    data = passages(sample, cfg)
    h, n = cfg.hidden, LABELS
    normal = lambda *s, k=0.2: (rng.standard_normal(s) * k).astype("f4")
    p = {"xf": normal(4 * h, ROWS), "uf": normal(4 * h, h), "xb": normal(4 * h, ROWS), "ub": normal(4 * h, h), "wo": normal(n, 2 * h, k=0.4), "bo": np.zeros(n, "f4"), "tr": np.zeros((n, n), "f4")}
    p["bo"][0] = 1.0
    for k in ("xf", "xb"):
        p[k][h : 2 * h] += 0.5  # remember at first
        _still(p[k])
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    coded = [(codes(t), y) for t, y in data]

    def batch(part: list[int]) -> tuple[np.ndarray, np.ndarray]:
        ids, y = np.full((cfg.length, len(part)), PAD, np.uint8), np.zeros((cfg.length, len(part)), np.int8)
        for j, k in enumerate(part):
            c, lab = coded[k]
            off = int(rng.integers(max(1, len(c) - cfg.length + 1)))
            while off and 0 < lab[off] < BEGIN:
                off -= 1  # not from inside of a value: what stands at a window's edge is read in another window
            c, lab = c[off : off + cfg.length], lab[off : off + cfg.length]
            ids[: len(c), j], y[: len(c), j] = c, lab
        return ids, y

    model, hard = Model(p, cfg), list(range(len(coded)))
    for step in range(cfg.steps):
        if step in (cfg.steps // 2, cfg.steps * 5 // 8, cfg.steps * 3 // 4, cfg.steps * 7 // 8):  # passages that it gets wrong, again
            got = model.labels([c for c, _ in coded])
            wrong = [k for k, (a, (_, y)) in enumerate(zip(got, coded)) if (a != y).any()]
            hard = wrong * max(1, len(coded) // (2 * max(1, len(wrong)))) + list(range(len(coded)))
        ids, y = batch([hard[k] for k in rng.integers(0, len(hard), cfg.batch)])
        e, (f, sf, g, sg) = _emit(p, ids, keep=True)
        _, de, dtr = _crf_grad(e, p["tr"].astype("f8"), y)
        grad = {"tr": dtr, "bo": de.sum((0, 2)), "wo": np.concatenate([np.einsum("tlb,thb->lh", de, f), np.einsum("tlb,thb->lh", de, g[::-1])], 1)}
        dzf, grad["uf"] = _lstm_back(np.matmul(p["wo"][:, :h].T, de), sf, p["uf"])
        dzb, grad["ub"] = _lstm_back(np.matmul(p["wo"][:, h:].T, de)[::-1], sg, p["ub"])
        for k, dz, at in (("xf", dzf, ids), ("xb", dzb, ids[::-1])):
            hot = np.zeros((at.size, ROWS), "f4")
            hot[np.arange(at.size), at.ravel()] = 1
            grad[k] = dz.transpose(1, 0, 2).reshape(4 * h, -1) @ hot
        norm = np.sqrt(sum(float((x * x).sum()) for x in grad.values()))
        rate = cfg.rate * (1 - 0.9 * step / cfg.steps)
        for k, x in grad.items():
            x = x * np.float32(min(1.0, 5 / (norm + 1e-9)))
            m[k] += 0.1 * (x - m[k])
            v[k] += 0.01 * (x * x - v[k])
            p[k] -= np.float32(rate) * (m[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(v[k] / (1 - 0.99 ** (step + 1))) + 1e-7)
    del data, coded, m, v
    tidy()
    return model


# ---------------------------------------------------------------- over tables


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, b, label in spans:
        out += [text[at:a], f"[{KINDS[label]}]"]
        at = b
    return "".join([*out, text[at:]])


def _sized(items: list[np.ndarray], chars: int) -> Iterator[tuple[int, int]]:
    i, n = 0, 0
    for k, t in enumerate(items):
        n += len(t)
        if n >= chars:
            yield i, k + 1
            i, n = k + 1, 0
    if i < len(items):
        yield i, len(items)


def find(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``RESULT``; no shuffle, one pass."""
    schema = plus(docs.schema, RESULT)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 50 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                read = texts(batch, text)
                coded = [codes(t) if t else np.zeros(0, np.uint8) for t in read]
                got = [model.spans(y) for i, k in _sized(coded, 400_000) for y in model.labels(coded[i:k])]
                cells = [[{"start": a, "end": b, "label": KINDS[x]} for a, b, x in s] for s in got]
                yield appended(batch, schema, {"spans": pa.array(cells, kind), "redacted": pa.array([redact(t, s) if s else t for t, s in zip(read, got)], pa.string())})
        tidy()

    return docs.mapInArrow(run, schema)


def without(docs: DataFrame, model: Model, text: str = "text", length: str | None = None) -> DataFrame:
    """``docs`` with the spans in ``text`` replaced by their labels, and ``length`` set to the new text's length; other columns as they were."""
    shared, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                read = texts(batch, text)
                coded = [codes(t) if t else np.zeros(0, np.uint8) for t in read]
                got = [model.spans(y) for i, k in _sized(coded, 400_000) for y in model.labels(coded[i:k])]
                new = [redact(t, s) if s else t for t, s in zip(read, got)]
                made = {text: pa.array(new, pa.string())}
                if length:
                    old = batch.column(batch.schema.get_field_index(length))
                    made[length] = pa.array([len(t) if s else n for t, s, n in zip(new, got, old.to_pylist())], old.type)
                yield appended(batch, schema, made)
        tidy()

    return docs.mapInArrow(run, schema)


def sample(docs: DataFrame, max_docs: int) -> list[str]:
    """Up to ``max_docs`` texts, chosen by a hash of their id."""
    rows = by_hash(docs.select("doc_id", "text"), "doc_id", max_docs).select("text").collect()
    return [r[0] for r in rows if r[0] is not None]


def fit_tables(spark: SparkSession, sf_dir: str, cfg: Config = Config()) -> Model:
    return fit(sample(table(spark, sf_dir, "documents"), cfg.max_docs), cfg)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, and the texts without it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, fit_tables(spark, sf_dir)).drop("text")
