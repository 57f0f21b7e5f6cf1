"""N-gram Jaccard join by a MinHash LSH forest.

1. Each text becomes its set of word n-grams (64-bit hashes). Texts with the same set are one
   node, by a 128-bit hash of the set; ``members`` has each document's node.
2. The forest has ``trees`` tries. In each, a node's path is a signature of ``max_depth``
   minhashes, a byte of each, so a path is one 64-bit number and the numbers' order is the
   trie's. The shortest prefixes that may ever be matched (``floors``) are those at which a pair
   at the threshold is met with the target recall: one tree after another gives up its last
   level until that is so. Nodes that share such a prefix in any tree form a group.
3. Within a group matched prefixes are shortened adaptively (``Group``). All nodes begin at
   whole paths. At each step the pairs met by now are verified exactly, and every node
   estimates its recall from its own partners: a partner of similarity s counts as
   1 / p(s) partners, p(s) being the probability to have met it by now, and one partner at the
   threshold is supposed to be still missing with probability 1 - p(threshold). Nodes whose
   recall is at the target stop, and a pair is met as long as either of its nodes goes on. So
   nodes in dense neighbourhoods stop at long prefixes and all others go on to the floors.
4. Groups too large for one task are cut into slices, and each pair of slices is a task;
   nothing is capped. A task gives each node's number of partners and only those pairs that
   hold its nodes together, so its rows grow with its nodes, not with its pairs.

The join has one row for each document with an id: ``class_id``, the smallest id of those that
it is linked to directly or through others, ``class_size``, and ``links``, the number of other
documents at the threshold (copies with the same set, and those of all verified partners).

Cases: null or empty texts, and texts without a word, are classes of their own without links.
Texts of less than n words have one n-gram, all their words. Very long texts are taken whole.
Rows with a null id are not in the join and stay in a deduplication. Repeated rows (one id, one
text) are one document; deduplication keeps one of them. One id with several texts is as many
documents. Of ties the smallest id stays. An empty table gives empty results. Other columns,
whatever their names, are kept by deduplication and ignored by the join.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, broadcast_if_small, table, texts, tidy, written
from weftline.llm.graph import components

WORD = re.compile(r"[^\W_]+")


#: Classes of similarity, from the threshold to 1, by which nodes count their partners.
BINS = 20


@dataclass(frozen=True)
class Config:
    n: int = 3
    #: A changed word costs n n-grams: copies with a tenth of their words changed are at 0.5 to 0.6.
    threshold: float = 0.5
    trees: int = 96
    #: Minhashes of a whole path, a byte each.
    max_depth: int = 8
    recall: float = 0.95
    #: n-grams that one verifying task holds for each of its two slices.
    slice_grams: int = 1_500_000
    seed: int = 1


def met(s, depths: np.ndarray):
    """The probability that a pair of similarity ``s`` shares a prefix of ``depths[t]`` in some tree t."""
    return 1 - np.prod(1 - np.asarray(s, float)[..., None] ** depths, -1)


@cache
def floors(cfg: Config) -> np.ndarray:
    """The shortest prefix of each tree: shortened tree by tree until pairs at the threshold have the target recall."""
    depths = np.full(cfg.trees, cfg.max_depth)
    for depth in range(cfg.max_depth - 1, 0, -1):
        for t in range(cfg.trees):
            if met(cfg.threshold, depths) >= cfg.recall:
                return depths
            depths[t] = depth
    return depths


@cache
def steps(cfg: Config) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """From whole paths down to the floors: prefixes, what a partner in each class of similarity counts, what a node still lacks."""
    low, edge = floors(cfg), cfg.threshold + (1 - cfg.threshold) * np.arange(BINS) / BINS
    plan = [np.maximum(low, d) for d in range(cfg.max_depth, low.min() - 1, -1)]
    return [(d, 1 / met(edge, d), float(1 - met(cfg.threshold, d))) for d in plan]


@cache
def _letters() -> np.ndarray:
    """Whether each character is a letter or digit, as in WORD."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


class Shingler:
    """Sorted n-gram hashes of texts, and their paths."""

    def __init__(self, cfg: Config, chars: int = 1_000_000):
        self.cfg, self.chars = cfg, chars
        rng = np.random.default_rng(cfg.seed)
        self.mul = (rng.integers(1, 1 << 63, cfg.n, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.power = np.cumprod(np.full(64, np.uint64(0x9E3779B97F4A7C15)))
        k = cfg.trees * cfg.max_depth
        self.a = (rng.integers(1, 1 << 31, k, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, k, dtype=np.uint32)

    def words(self, docs: list[str | None]) -> list[np.ndarray]:
        """The hashes of each text's words, in order; texts are taken together up to so many characters."""
        out, part, n = [], [], 0
        for t in docs:
            part.append(t.lower() if t else "")
            n += len(part[-1]) + 1
            if n >= self.chars:
                out += self._words(part)
                part, n = [], 0
        return out + self._words(part) if part else out

    def _words(self, low: list[str]) -> list[np.ndarray]:
        c = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        mine = np.flatnonzero(_letters()[c])
        if not len(mine):
            return [np.zeros(0, np.uint64)] * len(low)
        first = np.flatnonzero(np.diff(mine, prepend=-2) != 1)  # of each word, among the letters
        at = np.arange(len(mine)) - np.repeat(first, np.diff(np.append(first, len(mine))))
        if (longest := int(at.max()) + 1) > len(self.power):
            self.power = np.cumprod(np.full(2 * longest, self.power[0]))
        h = _mixed(c[mine].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        h *= self.power[at]
        h = _mixed(np.add.reduceat(h, first))
        ends = np.cumsum([len(t) + 1 for t in low])
        return np.split(h, np.searchsorted(mine[first], ends[:-1]))

    def sets(self, docs: list[str | None]) -> list[np.ndarray]:
        n, out = self.cfg.n, []
        for w in self.words(docs):
            if len(w) == 0:
                out.append(w)
                continue
            m = min(n, len(w))
            h = np.full(len(w) - m + 1, m, np.uint64)
            for i in range(m):
                h += w[i : len(w) - m + 1 + i] * self.mul[i]
                h = _mixed(h)
            out.append(np.unique(h))
        return out

    def paths(self, grams: np.ndarray) -> np.ndarray:
        """One path for each tree: the first minhash in the highest byte."""
        low = (grams >> np.uint64(16)).astype(np.uint32)
        sig = np.full(len(self.a), np.uint32(0xFFFFFFFF))
        for i in range(0, len(low), 512):
            v = np.multiply.outer(low[i : i + 512], self.a)
            v += self.b
            np.minimum(sig, v.min(0), out=sig)
        byte = ((sig * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).reshape(self.cfg.trees, -1)
        if byte.shape[1] < 8:
            byte = np.concatenate([byte, np.zeros((len(byte), 8 - byte.shape[1]), np.uint8)], 1)
        return np.ascontiguousarray(byte).view(">u8").ravel().astype(np.uint64)


def prefixes(paths: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """One 64-bit label of (tree, prefix) for each tree; labels that clash by chance cost a comparison only."""
    h = (paths >> (64 - 8 * depths).astype(np.uint64)) + (np.arange(len(paths), dtype=np.uint64) << np.uint64(57))
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(m)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def _read(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("fp"), "text")


def members(docs: DataFrame, cfg: Config, keep: int = 200_000) -> DataFrame:
    """(key, doc_id, fp, rows, grams, paths) of every document; key is null without a word.

    A task computes the paths of a set where it first meets it; they are null in further rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, known = Shingler(cfg), set()
        try:
            for batch in _parts(batches):
                key, n, paths = [], [], []
                for g in s.sets(texts(batch, "text")):
                    k = hashlib.blake2b(g.tobytes(), digest_size=16).digest() if len(g) else None
                    key.append(k)
                    n.append(len(g))
                    paths.append(s.paths(g).tobytes() if k and k not in known else None)
                    known.add(k)
                if len(known) > keep:
                    known = set()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key, pa.binary()), pa.array(n, pa.int32()), pa.array(paths, pa.binary())], names=["doc_id", "fp", "key", "grams", "paths"])
        finally:
            del s, known
            tidy()

    got = _read(docs).mapInArrow(run, "doc_id bigint, fp bigint, key binary, grams int, paths binary")
    one = got.groupBy("key", "doc_id", "fp").agg(F.count("*").alias("rows"), F.max("grams").alias("grams"), F.first("paths", ignorenulls=True).alias("paths"))
    return written(one, "members")


def nodes(found: DataFrame, scratch: Scratch) -> DataFrame:
    """One row for each distinct set: its key, one (doc_id, fp) that has it, its documents' number and its paths."""
    one = found.where("key is not null").groupBy("key").agg(F.min(F.struct("doc_id", "fp")).alias("first"), F.count("*").alias("docs"), F.max("grams").alias("grams"), F.first("paths", ignorenulls=True).alias("paths"))
    return scratch.written(one.select("key", F.col("first.doc_id").alias("doc_id"), F.col("first.fp").alias("fp"), "docs", "grams", "paths"), "nodes")


def groups(sets: DataFrame, cfg: Config, scratch: Scratch) -> DataFrame:
    """(node, component): hashes of the keys of nodes that share a shortest prefix with another, linked transitively.

    Keys whose hashes are equal are in one group, which costs a comparison and no more.
    """
    low = floors(cfg)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, 2048):
            paths = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, cfg.trees)
            label = np.concatenate([prefixes(p, low) for p in paths]) if len(paths) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(paths)), cfg.trees))), pa.array(label)], names=["node", "label"])

    rows = sets.select(F.xxhash64("key").alias("node"), "paths").mapInArrow(explode, "node bigint, label bigint")
    # combined before the shuffle, so that a prefix of very many nodes is no large group anywhere
    shared = rows.groupBy("label").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").select("label", "hub")
    stars = rows.join(shared, "label").where("node <> hub").select("node", "hub").distinct()
    return components(stars, "node", "hub", scratch)


FOUND = "key_a binary, key_b binary, links bigint"


def verified(docs: DataFrame, sets: DataFrame, cfg: Config, scratch: Scratch) -> DataFrame:
    """Rows of two kinds: (key_a, key_b) that hold linked nodes together, and (key_a, null, its links from one task)."""
    placed = scratch.written(sets.select(F.xxhash64("key").alias("node"), "key", "doc_id", "fp", "docs", "grams").join(groups(sets, cfg, scratch), "node").drop("node"), "groups")
    load = placed.groupBy("component").agg(F.sum("grams").alias("load"))
    slices = F.greatest(F.lit(1), F.ceil(F.col("load") / cfg.slice_grams)).cast("int")
    placed = placed.join(load.select("component", slices.alias("slices")), "component")
    placed = placed.withColumn("slice", F.pmod(F.xxhash64("key"), "slices").cast("int"))
    wanted = broadcast_if_small(placed.drop("grams"), 32 << 20)
    held = wanted.join(_read(docs), ["doc_id", "fp"]).select("component", "slices", "slice", "key", "docs", "text")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(cfg)
        try:
            for batch in _parts(batches):
                found = s.sets(texts(batch, "text"))
                paths = [s.paths(g) for g in found]  # again, as they are larger than what would have to move with them
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array([x.tobytes() for x in paths], pa.binary()), pa.array([g.tobytes() for g in found], pa.binary())], names=["component", "slices", "slice", "key", "docs", "paths", "set"])
        finally:
            del s
            tidy()

    shingled = held.mapInArrow(shingle, "component bigint, slices int, slice int, key binary, docs bigint, paths binary, set binary")
    other = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    cells = shingled.withColumn("other", other).withColumn("low", F.least("slice", "other")).withColumn("high", F.greatest("slice", "other")).drop("slices", "other")

    def verify(t: pa.Table) -> pa.Table:
        low, high = t["low"][0].as_py(), t["high"][0].as_py()
        first: dict = {}  # repeated rows of one document
        for i, k in enumerate(t["key"].to_pylist()):
            first.setdefault(k, i)
        keys = sorted(first)
        at = [first[k] for k in keys]
        paths = np.stack([np.frombuffer(t["paths"][i].as_py(), np.uint64) for i in at])
        group = Group([np.frombuffer(t["set"][i].as_py(), np.uint64) for i in at], paths, t["docs"].to_numpy()[at], t["slice"].to_numpy()[at] if low != high else None, cfg).run()
        some = np.flatnonzero(group.links).tolist()
        first_key = [keys[x] for x, _ in group.bonds] + [keys[x] for x in some]
        second = [keys[y] for _, y in group.bonds] + [None] * len(some)
        return pa.table({"key_a": pa.array(first_key, pa.binary()), "key_b": pa.array(second, pa.binary()), "links": pa.array([0] * len(group.bonds) + group.links[some].tolist(), pa.int64())})

    return scratch.written(cells.groupBy("component", "low", "high").applyInArrow(verify, FOUND), "found")


class Group:
    """The nodes of one task: matched prefixes shortened until every node has the target recall.

    ``side``: pairs count only across its two values. ``links[x]`` is the number of documents
    of x's partners; ``bonds`` are as few pairs as hold all linked nodes together; ``pairs``,
    where asked for, are all that were verified.
    """

    def __init__(self, sets: list[np.ndarray], paths: np.ndarray, docs: np.ndarray, side: np.ndarray | None, cfg: Config, pairs: bool = False, block: int = 512, hold: int = 20_000_000):
        self.cfg, self.side, self.docs, self.block, self.paths = cfg, side, docs, block, paths
        m = self.m = len(sets)
        self.size = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(m), self.size)
        _, col, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times > 1  # n-grams of one document can't meet
        keep = shared[col]
        self.col, self.owner = (np.cumsum(shared) - 1)[col[keep]], owner[keep]
        self.start = np.searchsorted(self.owner, np.arange(m + 1))
        self.width = int(shared.sum())
        self.labels = np.ascontiguousarray((paths >> (64 - 8 * floors(cfg)).astype(np.uint64)).astype(np.uint32).T)  # of the floors, cut to 32 bits: a first sieve
        self.links = np.zeros(m, np.int64)
        self.partners = np.zeros((m, BINS), np.int64)  # by similarity
        self.label = np.arange(m)
        self.bonds: list[tuple[int, int]] = []
        self.pairs: list[tuple[int, int, float]] | None = [] if pairs else None
        self.held: dict = {}  # candidates of blocks, as long as there is room for them; else they are found again
        self.room = hold

    def _candidates(self, i: int, i1: int, k: int, k1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of a block that share a floor, and the step at which each is met first."""
        if (i, k) in self.held:
            return self.held[i, k]
        near = np.zeros((i1 - i, k1 - k), bool)
        for lab in self.labels:
            near |= lab[i:i1, None] == lab[None, k:k1]
        if i == k:
            near &= np.arange(i, i1)[:, None] < np.arange(k, k1)
        if self.side is not None:
            near &= self.side[i:i1, None] != self.side[None, k:k1]
        r, s = (x.astype(np.int32) for x in np.nonzero(near))
        r, s, top = r + i, s + k, self.cfg.max_depth
        at = np.full(len(r), 255, np.uint8)
        low = floors(self.cfg)
        for floor in np.unique(low):
            trees = np.flatnonzero(low == floor)
            for c in range(0, len(r), 1 << 14):
                part = slice(c, c + (1 << 14))
                least = (self.paths[r[part]][:, trees] ^ self.paths[s[part]][:, trees]).min(1)
                for step in range(top - int(floor), -1, -1):
                    np.minimum(at[part], step, out=at[part], where=least >> np.uint64(64 - 8 * (top - step)) == 0)
        some = at < 255
        got = r[some], s[some], at[some]
        if len(got[0]) <= self.room:
            self.room -= len(got[0])
            self.held[i, k] = got
        return got

    def run(self) -> Group:
        m, block, plan = self.m, self.block, steps(self.cfg)
        going = np.ones(m, bool)
        for at, (_, counts, missing) in enumerate(plan):
            for i in range(0, m, block):
                i1 = min(m, i + block)
                for k in range(i, m, block):
                    k1 = min(m, k + block)
                    if not (going[i:i1].any() or going[k:k1].any()):
                        continue
                    r, s, first = self._candidates(i, i1, k, k1)
                    now = (first == at) & (going[r] | going[s])
                    if now.any():
                        self._compare(i, i1, k, k1, r[now], s[now])
            going = self.partners.sum(1) < self.cfg.recall * (self.partners @ counts + missing)
            if not going.any():
                break
        return self

    def _common(self, i: int, i1: int, k: int, k1: int, r: np.ndarray, s: np.ndarray) -> np.ndarray:
        """How many n-grams each pair has in common, exactly."""
        col, start = self.col, self.start
        if 20 * len(r) < (i1 - i) * (k1 - k):  # few pairs: of each left node with all its right ones
            mark, out = np.zeros(self.width, np.int32), np.zeros(len(r), np.int64)
            edge = np.flatnonzero(np.diff(r, prepend=-1)).tolist()
            for e, e1 in zip(edge, [*edge[1:], len(r)]):
                mine = col[start[r[e]] : start[r[e] + 1]]
                mark[mine] = 1
                js = s[e:e1]
                n = start[js + 1] - start[js]
                ends = np.cumsum(n)
                seen = np.concatenate([[0], np.cumsum(mark[col[np.repeat(start[js] - (ends - n), n) + np.arange(ends[-1])]])])
                out[e:e1] = seen[ends] - seen[ends - n]
                mark[mine] = 0
            return out
        both = np.zeros((2, self.width), bool)
        both[0, col[start[i] : start[i1]]] = both[1, col[start[k] : start[k1]]] = True
        place = np.cumsum(both[0] & both[1]) - 1
        both, wide = both[0] & both[1], int(place[-1]) + 1 if self.width else 0
        inter = np.zeros((i1 - i, k1 - k), "f4")  # exact: counts stay far below 2**24

        def matrix(a: int, b: int, c0: int, c1: int) -> np.ndarray:
            x = np.zeros((b - a, c1 - c0), "f4")
            c, o = col[start[a] : start[b]], self.owner[start[a] : start[b]]
            keep = both[c]
            c, o = place[c[keep]], o[keep]
            keep = (c >= c0) & (c < c1)
            x[o[keep] - a, c[keep] - c0] = 1
            return x

        for c in range(0, wide, 1 << 14):
            c1 = min(wide, c + (1 << 14))
            inter += matrix(i, i1, c, c1) @ matrix(k, k1, c, c1).T
        return inter[r - i, s - k].astype(np.int64)

    def _compare(self, i: int, i1: int, k: int, k1: int, r: np.ndarray, s: np.ndarray) -> None:
        common = self._common(i, i1, k, k1, r, s)
        j = common / (self.size[r] + self.size[s] - common)
        hit = j >= self.cfg.threshold
        r, s, j = r[hit], s[hit], j[hit]
        self.links += np.bincount(r, self.docs[s], self.m).astype(np.int64) + np.bincount(s, self.docs[r], self.m).astype(np.int64)
        where = np.minimum(((j - self.cfg.threshold) / (1 - self.cfg.threshold) * BINS).astype(int), BINS - 1)
        self.partners[i:i1] += np.bincount((r - i) * BINS + where, minlength=(i1 - i) * BINS).reshape(-1, BINS)
        self.partners[k:k1] += np.bincount((s - k) * BINS + where, minlength=(k1 - k) * BINS).reshape(-1, BINS)
        if self.pairs is not None:
            self.pairs += zip(r.tolist(), s.tolist(), j.tolist())
        while len(r):
            x, y = self.label[r], self.label[s]
            apart = x != y
            r, s, x, y = r[apart], s[apart], x[apart], y[apart]
            high, one = np.unique(np.maximum(x, y), return_index=True)
            self.bonds += zip(r[one].tolist(), s[one].tolist())
            to = np.arange(self.m)
            to[high] = np.minimum(x, y)[one]
            while (to != (nxt := to[to])).any():
                to = nxt
            self.label = to[self.label]


def classes(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(doc_id, fp, rows, class_doc, class_fp, class_size, links) of every document with an id."""
    have, scratch = members(docs, cfg), Scratch(docs.sparkSession)
    sets = nodes(have, scratch)
    found = verified(docs, sets, cfg, scratch)
    bond = components(found.where("key_b is not null"), "key_a", "key_b", scratch).withColumnRenamed("node", "key")
    links = found.where("key_b is null").groupBy(F.col("key_a").alias("key")).agg(F.sum("links").alias("links"))
    # by node, not by document: a class's smallest document is the smallest of its nodes' first ones
    node = sets.select("key", "doc_id", "fp", "docs").join(bond, "key", "left").join(links, "key", "left")
    node = node.select("key", F.coalesce("component", "key").alias("class"), "doc_id", "fp", "docs", (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("links"))
    node = written(node, "classes")
    scratch.clear()
    head = node.groupBy("class").agg(F.min(F.struct("doc_id", "fp")).alias("head"), F.sum("docs").alias("class_size"))
    node = node.select("key", "class", "links").join(head, "class").select("key", "head", "class_size", "links")
    full = have.select("key", "doc_id", "fp", "rows").join(node, "key", "left")
    return full.select("doc_id", "fp", "rows", F.coalesce("head.doc_id", "doc_id").alias("class_doc"), F.coalesce("head.fp", "fp").alias("class_fp"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("links", F.lit(0)).alias("links"))


def join(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row for each document; see the module's text."""
    return classes(docs, cfg).select("doc_id", F.col("class_doc").alias("class_id"), "class_size", "links")


def dedup(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``docs`` with one document of each class: that of the smallest id."""
    first = (F.col("doc_id") == F.col("class_doc")) & (F.col("fp") == F.col("class_fp"))
    judged = classes(docs, cfg).withColumn("_wl_first", first).where("not _wl_first or rows > 1")
    judged = written(judged.select(F.col("doc_id").alias("_wl_id"), F.col("fp").alias("_wl_fp"), "_wl_first"), "dropped")
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("hash"))  # no name can clash
    marked = keyed.join(broadcast_if_small(judged, 32 << 20), (F.col("id") == F.col("_wl_id")) & (F.col("hash") == F.col("_wl_fp")), "left")
    once = marked.where("_wl_first is null").select("row.*")
    again = marked.where("_wl_first").dropDuplicates(["id", "hash"]).select("row.*")
    return once.unionByName(again)


def op6_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near and exact copies and its number of links."""
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))
