"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Each word enters as two vectors: its own embedding (frequent words only) and the
element-wise maximum of the embeddings of its character n-grams, so inflected or unseen
forms still carry their stem. A GRU runs over the words in both directions, attention pools
the states of a window and a logistic unit scores it. Every overlapping window of every
text is scored; a document's score is that of its worst window.

Training is in numpy, on a bounded sample of labelled documents (``max_docs`` of each
class). Labels are of documents, so the worst window of a document is what is fitted
(multiple-instance learning).

Cases: a null or empty text, or one without a letter, has no window, score 0.0 and is not
toxic. Texts of any length are scored whole. Null ids and other null columns pass through.
Repeated rows are scored each on its own and alike; of windows that tie any is the worst, and a
score that ties with the threshold is toxic. An empty table gives an empty result. Extra columns are kept; one that is
called like a result column is replaced by it. With no labels, or only one class of them,
the model scores 0.0 everywhere and rejects nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import appended, plus, table, texts, tidy

WORD = re.compile(r"[^\W\d_]+")
RESULT = "toxicity double, toxic_windows int, windows int, toxic boolean"
GRAMS = (3, 4, 5)


@dataclass
class Config:
    hidden: int = 10
    word_dim: int = 6
    char_dim: int = 12
    attention: int = 8
    window: int = 64
    stride: int = 32
    #: Labelled documents of each class that training may take.
    max_docs: int = 1200
    min_word_docs: int = 3
    #: Batches that training takes, whatever the sample's size.
    steps: int = 360
    batch: int = 48
    rate: float = 0.01
    seed: int = 7


@dataclass
class Model:
    cfg: Config
    grams: dict[str, int]
    words: dict[str, int]
    p: dict[str, np.ndarray]
    threshold: float = 0.5
    trained: bool = True
    report: dict = field(default_factory=dict)


def grams_of(word: str) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1)] or [w]


def tokens(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def windows_of(n: int, cfg: Config) -> list[int]:
    """Starts of the windows over ``n`` words; each word is in at least one."""
    if n == 0:
        return []
    last = max(0, n - cfg.window)
    starts = list(range(0, last + 1, cfg.stride))
    return starts if starts[-1] == last else [*starts, last]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


# ---------------------------------------------------------------- forward, backward


def _gru(x: np.ndarray, u: np.ndarray, keep: bool):
    """x: (T, B, 3H) inputs of update, reset, candidate. Returns states (T, B, H), and what the gradient needs."""
    t, b, h3 = x.shape
    h = h3 // 3
    s = np.zeros((b, h), "f4")
    out = np.empty((t, b, h), "f4")
    saved = []
    uz, un = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
    for k in range(t):
        zr = s @ uz
        zr += x[k, :, : 2 * h]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r = zr[:, :h], zr[:, h:]
        hn = s @ un
        n = np.tanh(x[k, :, 2 * h :] + r * hn)
        if keep:
            saved.append((s, z, r, hn, n))
        s = n + z * (s - n)
        out[k] = s
    return out, saved


def _gru_back(dout: np.ndarray, saved: list, u: np.ndarray):
    t, b, h = dout.shape
    uz, un = u[:, : 2 * h], u[:, 2 * h :]
    du, dx, dh = np.zeros_like(u), np.empty((t, b, 3 * h), "f4"), np.zeros((b, h), "f4")
    for k in range(t - 1, -1, -1):
        s, z, r, hn, n = saved[k]
        dh = dh + dout[k]
        dz = dh * (s - n) * z * (1 - z)
        dn = dh * (1 - z) * (1 - n * n)
        dr = dn * hn * r * (1 - r)
        dhn = dn * r
        dzr = np.concatenate([dz, dr], 1)
        du[:, : 2 * h] += s.T @ dzr
        du[:, 2 * h :] += s.T @ dhn
        dx[k, :, : 2 * h], dx[k, :, 2 * h :] = dzr, dn
        dh = dh * z + dzr @ uz.T + dhn @ un.T
    return dx, du


PAD_GATE = 30.0  # holds the state where a window has no word


def _project(p: dict, feats: np.ndarray) -> np.ndarray:
    """Inputs of both directions for each word; row 0 is padding."""
    proj = feats @ p["wx"] + p["bx"]
    h = proj.shape[1] // 6
    proj[0] = 0
    proj[0, :h] = proj[0, 3 * h : 4 * h] = PAD_GATE
    return proj.astype("f4")


def _forward(p: dict, proj: np.ndarray, ids: np.ndarray, keep: bool = False):
    """ids: (T, B) rows of ``proj``. Returns logits (B,), and what the gradient needs."""
    h3 = proj.shape[1] // 2
    x = proj[ids]
    f, sf = _gru(x[:, :, :h3], p["uf"], keep)
    g, sg = _gru(x[::-1, :, h3:], p["ub"], keep)
    hs = np.concatenate([f, g[::-1]], 2)
    a = np.tanh(hs @ p["wa"] + p["ba"])
    e = a @ p["va"]
    e[ids == 0] = -1e9
    e -= e.max(0)
    w = np.exp(e)
    w /= w.sum(0)
    pooled = (hs * w[:, :, None]).sum(0)
    logit = pooled @ p["wo"] + p["bo"]
    return logit, (hs, a, w, pooled, sf, sg) if keep else None


def _backward(p: dict, dlogit: np.ndarray, state):
    hs, a, w, pooled, sf, sg = state
    h = hs.shape[2] // 2
    grad = {"wo": pooled.T @ dlogit, "bo": dlogit.sum(keepdims=True)}
    dpool = dlogit[:, None] * p["wo"]
    dw = (hs * dpool).sum(2)
    de = w * (dw - (w * dw).sum(0))
    grad["va"] = (a * de[:, :, None]).sum((0, 1))
    da = de[:, :, None] * p["va"] * (1 - a * a)
    grad["wa"] = hs.reshape(-1, 2 * h).T @ da.reshape(-1, da.shape[2])
    grad["ba"] = da.sum((0, 1))
    dhs = w[:, :, None] * dpool + da @ p["wa"].T
    dxf, grad["uf"] = _gru_back(np.ascontiguousarray(dhs[:, :, :h]), sf, p["uf"])
    dxb, grad["ub"] = _gru_back(np.ascontiguousarray(dhs[::-1, :, h:]), sg, p["ub"])
    return grad, np.concatenate([dxf, dxb[::-1]], 2)


def _features(p: dict, rows: np.ndarray, offsets: np.ndarray, word_rows: np.ndarray):
    """(n, word_dim + char_dim) features of n words; char rows of word i: rows[offsets[i]:offsets[i+1]]."""
    return np.concatenate([p["we"][word_rows], np.maximum.reduceat(p["ce"][rows], offsets[:-1], axis=0)], 1)


class _Adam:
    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, grad: dict) -> None:
        self.t += 1
        for k, g in grad.items():
            m, v = self.m[k], self.v[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            self.p[k] -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-7)


# ---------------------------------------------------------------- training


def fit(rows: list[tuple[str, int]], cfg: Config | None = None) -> Model:
    """Train on (text, label) pairs; a fifth of them is held out for the threshold and the report."""
    cfg = cfg or Config()
    one: dict[str, str] = {}  # a word is held once, not for each place
    docs = [(t, int(y)) for text, y in rows if y is not None and (t := [one.setdefault(w, w) for w in tokens(text)])]
    del one
    if len({y for _, y in docs}) < 2:
        return Model(cfg, {}, {}, {}, trained=False)
    rng = np.random.default_rng(cfg.seed)
    docs = [docs[i] for i in rng.permutation(len(docs))]
    held = sum(1 for _ in docs) // 5
    df = Counter(w for t, _ in docs[held:] for w in set(t))
    words = {w: i + 1 for i, w in enumerate(sorted(w for w, n in df.items() if n >= cfg.min_word_docs))}
    vocab = {w: i + 1 for i, w in enumerate(df)}
    grams: dict[str, int] = {}
    rows_, offsets, word_rows = [0], [0, 1], [0]
    for w in vocab:
        rows_ += [grams.setdefault(g, len(grams) + 1) for g in grams_of(w)]
        offsets.append(len(rows_))
        word_rows.append(words.get(w, 0))
    rows_a, off, wr = np.array(rows_, np.int32), np.array(offsets), np.array(word_rows, np.int32)
    del rows_, offsets, word_rows
    d, h = cfg.word_dim + cfg.char_dim, cfg.hidden
    normal = lambda *s, k=0.1: (rng.standard_normal(s) * k).astype("f4")
    p = {
        "we": normal(len(words) + 1, cfg.word_dim, k=0.02), "ce": normal(len(grams) + 1, cfg.char_dim, k=0.02),
        "wx": normal(d, 6 * h, k=0.4), "bx": np.zeros(6 * h, "f4"), "uf": normal(h, 3 * h, k=0.3), "ub": normal(h, 3 * h, k=0.3),
        "wa": normal(2 * h, cfg.attention, k=0.3), "ba": np.zeros(cfg.attention, "f4"), "va": normal(cfg.attention, k=0.3), "wo": normal(2 * h, k=0.3), "bo": np.zeros(1, "f4"),
    }
    p["we"][0] = p["ce"][0] = 0
    adam = _Adam(p, cfg.rate)

    def windows(t: list[str]) -> np.ndarray:
        ids = np.array([vocab.get(w, 0) for w in t])
        out = np.zeros((len(starts := windows_of(len(t), cfg)), cfg.window), np.int32)
        for i, s in enumerate(starts):
            part = ids[s : s + cfg.window]
            out[i, : len(part)] = part
        return out

    train = [(windows(t), y) for t, y in docs[held:]]
    pick = [int(rng.integers(len(w))) for w, _ in train]
    every = np.concatenate([w for w, _ in train])
    ends = np.cumsum([len(w) for w, _ in train])
    loss = 0.0
    epochs = max(1, round(cfg.steps / -(-len(train) // cfg.batch)))
    for epoch in range(epochs):
        if epoch >= 2 and epoch % 2 == 0:  # the worst window of each document
            cut = [*range(0, len(wr), 8192), len(wr)]  # their n-grams are many: a part of the words at a time
            feats = np.concatenate([_features(p, rows_a[off[a] : off[b]], off[a : b + 1] - off[a], wr[a:b]) for a, b in zip(cut, cut[1:])])
            proj = _project(p, feats)
            score = np.concatenate([_forward(p, proj, every[i : i + 512].T)[0] for i in range(0, len(every), 512)])
            pick = [int(np.argmax(score[e - len(w) : e])) for (w, _), e in zip(train, ends)]
            del feats, proj, score
        elif epoch < 2:
            pick = [int(rng.integers(len(w))) for w, _ in train]
        order, loss = rng.permutation(len(train)), 0.0
        adam.rate = cfg.rate * (1 - 0.8 * epoch / epochs)
        for i in range(0, len(order), cfg.batch):
            part = order[i : i + cfg.batch]
            wins = np.stack([train[k][0][pick[k]] for k in part]).T
            y = np.array([train[k][1] for k in part], "f4")
            u, inv = np.unique(np.concatenate([[0], wins.ravel()]), return_inverse=True)
            ids = inv[1:].reshape(wins.shape)
            lens = off[u + 1] - off[u]
            o = np.concatenate([[0], np.cumsum(lens)])
            r = rows_a[np.repeat(off[u] - o[:-1], lens) + np.arange(o[-1])]
            feats = _features(p, r, o, wr[u])
            logit, state = _forward(p, _project(p, feats), ids, keep=True)
            prob = _sigmoid(logit)
            loss += float(-(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7)).sum())
            dl = ((prob - y) / len(part)).astype("f4")
            grad, dx = _backward(p, dl, state)
            flat, at = dx.reshape(-1, dx.shape[2]), np.argsort(ids.ravel(), kind="stable")
            dproj = np.zeros((len(u), flat.shape[1]), "f4")
            have, first = np.unique(ids.ravel()[at], return_index=True)
            dproj[have] = np.add.reduceat(flat[at], first, axis=0)
            dproj[0] = 0
            grad["wx"], grad["bx"] = feats.T @ dproj, dproj.sum(0)
            df_ = dproj @ p["wx"].T
            grad["we"] = np.zeros_like(p["we"])
            np.add.at(grad["we"], wr[u], df_[:, : cfg.word_dim])
            grad["we"] += 1e-4 * p["we"]
            grad["ce"] = 1e-4 * p["ce"]
            ce, best = p["ce"][r], feats[:, cfg.word_dim :]
            owner = np.repeat(np.arange(len(u)), lens)
            hit = ce == best[owner]
            k, c = np.nonzero(hit)
            np.add.at(grad["ce"], (r[k], c), df_[owner[k], cfg.word_dim + c])
            grad["we"][0] = grad["ce"][0] = 0
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            if norm > 5:
                grad = {k: g * np.float32(5 / norm) for k, g in grad.items()}
            adam.step(grad)
    del train, every, adam
    model = Model(cfg, grams, words, p)
    scorer = Scorer(model)
    scored = [x for a, b in _batches([t for t, _ in docs], 200_000) for x in scorer.score([t for t, _ in docs[a:b]])]
    s, y = np.array([x[0] for x in scored]), np.array([y for _, y in docs])
    model.threshold = _cut(s, y)
    hs, hy = s[:held] >= model.threshold, y[:held] == 1
    del scorer
    tidy()
    model.report = {"docs": len(docs), "held_out": held, "accuracy": float((hs == hy).mean()) if held else 1.0, "recall": float((hs & hy).sum() / max(1, hy.sum())), "precision": float((hs & hy).sum() / max(1, hs.sum())), "loss": loss / max(1, len(docs) - held)}
    return model


def _cut(score: np.ndarray, y: np.ndarray) -> float:
    """The threshold of least errors; in a gap between scores, three quarters up it in logits.

    Clean documents outnumber the sample by far, so the cut lies nearer to the toxic ones.
    """
    order = np.argsort(score)
    s, t = score[order], y[order]
    wrong = np.concatenate([[(t == 0).sum()], (t == 0).sum() + np.cumsum(np.where(t == 1, 1, -1))])
    best = np.flatnonzero(wrong == wrong.min())
    k = int(best[len(best) // 2])
    logit = lambda x: np.log(np.clip(x, 1e-6, 1 - 1e-6) / (1 - np.clip(x, 1e-6, 1 - 1e-6)))
    low, high = logit(s[k - 1]) if k else -14.0, logit(s[k]) if k < len(s) else 14.0
    return float(1 / (1 + np.exp(-(low + 0.75 * (high - low)))))


# ---------------------------------------------------------------- scoring


class Scorer:
    """Scores lists of words; keeps the network inputs of words it has seen."""

    def __init__(self, model: Model, keep_words: int = 200_000, chunk: int = 1024):
        self.m, self.keep, self.chunk = model, keep_words, chunk
        self._reset()

    def _reset(self) -> None:
        h6 = 6 * self.m.cfg.hidden
        self.ids: dict[str, int] = {}
        self.proj = np.zeros((1, h6), "f4")
        if self.m.trained:
            self.proj = _project(self.m.p, np.zeros((1, self.m.cfg.word_dim + self.m.cfg.char_dim), "f4"))
        self.used = 1

    def _learn(self, new: list[str]) -> None:
        g, rows, off, wr = self.m.grams, [], [0], []
        for w in new:
            rows += [g.get(x, 0) for x in grams_of(w)]
            off.append(len(rows))
            wr.append(self.m.words.get(w, 0))
        feats = _features(self.m.p, np.array(rows), np.array(off), np.array(wr))
        more = (feats @ self.m.p["wx"] + self.m.p["bx"]).astype("f4")
        need = self.used + len(new)
        if need > len(self.proj):
            self.proj = np.concatenate([self.proj, np.empty((max(need - len(self.proj), len(self.proj) // 4), self.proj.shape[1]), "f4")])
        self.proj[self.used : need] = more
        self.ids.update(zip(new, range(self.used, need)))
        self.used = need

    def score(self, docs: list[list[str]]) -> list[tuple[float, int, int]]:
        """(score, windows over the threshold, windows) of each document."""
        cfg = self.m.cfg
        if not self.m.trained:
            return [(0.0, 0, len(windows_of(len(t), cfg))) for t in docs]
        if self.used > self.keep:
            self._reset()
        new = dict.fromkeys(w for t in docs for w in t if w not in self.ids)
        if new:
            self._learn(list(new))
        get, w = self.ids.__getitem__, cfg.window
        flat = np.array(list(map(get, chain.from_iterable(docs))), np.int32)
        base, starts, ends, count = 0, [], [], []
        for t in docs:
            at = windows_of(len(t), cfg)
            starts += [base + s for s in at]
            ends += [base + len(t)] * len(at)
            count.append(len(at))
            base += len(t)
        st, en = np.array(starts, int), np.array(ends, int)
        logits = np.empty(len(st), "f4")
        flat = np.concatenate([flat, np.zeros(w, np.int32)])
        span = np.arange(w)[:, None]
        for i in range(0, len(st), self.chunk):
            at = st[i : i + self.chunk] + span
            logits[i : i + self.chunk] = _forward(self.m.p, self.proj, np.where(at < en[i : i + self.chunk], flat[at], 0))[0]
        prob = 1 / (1 + np.exp(-logits.astype("f8")))
        out, k = [], 0
        for n in count:
            part = prob[k : k + n]
            out.append((float(part.max()), int((part >= self.m.threshold).sum()), n) if n else (0.0, 0, 0))
            k += n
        return out


def _batches(items: list[list[str]], words: int) -> Iterator[tuple[int, int]]:
    i, n = 0, 0
    for k, t in enumerate(items):
        n += len(t)
        if n >= words:
            yield i, k + 1
            i, n = k + 1, 0
    if i < len(items):
        yield i, len(items)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``RESULT``; no shuffle, one pass."""
    schema = plus(docs.schema, RESULT)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, bounded by the sample it was fitted on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                docs_ = [tokens(t) for t in texts(batch, text)]
                got = [x for i, k in _batches(docs_, 200_000) for x in scorer.score(docs_[i:k])]
                yield appended(batch, schema, {
                    "toxicity": pa.array([g[0] for g in got], pa.float64()), "toxic_windows": pa.array([g[1] for g in got], pa.int32()),
                    "windows": pa.array([g[2] for g in got], pa.int32()), "toxic": pa.array([g[2] > 0 and scorer.m.trained and g[0] >= scorer.m.threshold for g in got], pa.bool_()),
                })
        del scorer
        tidy()

    return docs.mapInArrow(run, schema)


def clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without those that the model rejects; no shuffle, one pass, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                docs_ = [tokens(t) for t in texts(batch, text)]
                got = [x for i, k in _batches(docs_, 200_000) for x in scorer.score(docs_[i:k])]
                yield batch.filter(pa.array([g[2] == 0 or not scorer.m.trained or g[0] < scorer.m.threshold for g in got], pa.bool_()))
        del scorer
        tidy()

    return docs.mapInArrow(run, docs.schema)


def sample(docs: DataFrame, labels: DataFrame, max_docs: int) -> list[tuple[str, int]]:
    """Up to ``max_docs`` labelled texts of each class, chosen by a hash of their id; repeated rows count once."""
    y = labels.where("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("_y"))
    picked = None
    for k in (0, 1):
        one = y.where(F.col("_y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
        picked = one if picked is None else picked.unionAll(one)
    got = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").distinct()  # at most 2 * max_docs ids
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(2 * max_docs)  # where an id has several texts
    return [(r[1], r[2]) for r in sorted(got.collect(), key=lambda r: (r[0], r[2], r[1] or ""))]


def fit_tables(spark: SparkSession, sf_dir: str, cfg: Config | None = None) -> Model:
    cfg = cfg or Config()
    return fit(sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cfg.max_docs), cfg)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model fitted on the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit_tables(spark, sf_dir)).drop("text")
