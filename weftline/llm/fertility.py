"""Quality rules from tokeniser fertility.

Each text is encoded with two public vocabularies. Byte-level BPE gives characters per token
and the entropy of the text's tokens; the vocabulary with byte fallback gives the share of
its tokens that are fallback bytes for characters it lacks (a line break is a byte token in
it and is not counted). Entropy is given in bits and as ``evenness``, entropy over its
maximum for that many tokens, which falls with a text's length.

Bands. The language of a row is its ``lang``, else the script of most of its letters. Per
language, and for evenness and characters per token per language and class of length (powers of
two of tokens, so that short texts, whose measures spread more, are judged by short ones), the
quartiles of each measure over all documents give a band of ``fence`` quartile distances
beyond them, at least as wide as ``least`` says. A class of length with fewer than ``support``
rows has a second band, of its rows and those of the nearest classes, as many on either side as
needed, or else a single text would be its own measure; the narrower end holds. A language of
so few rows in all has what it has. Rows outside a band are rejected, with the
measures as ``reasons``. Texts of every length are judged.

Quartiles come from exact counts of values rounded to ``grain``. The tables of bands have a
row for each language and class of length, and join by a broadcast only if they are small.

Cases: a null or empty text has no tokens, null measures and is kept with no reasons. A row
without language and letters belongs to ``none``. Repeated rows are measured alike and count
each. An empty table gives an empty result. Extra columns are kept; one called like a result
column is replaced by it.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.bpe import VOCABULARY, pretokens
from weftline.llm.common import appended, broadcast_if_small, encoding, plus, table, texts, tokenizer_dir, utf8, written

PIECES = "piece_bpe_32k.model"
MEASURES = "n_tokens bigint, chars_per_token double, byte_share double, entropy double, evenness double, band string"
UNIT = re.compile(r" +[^ ]*|[^ ]+")


@dataclass(frozen=True)
class Config:
    fence: float = 3.0
    #: Least distance of the band's ends from the quartiles: (below, above); None: no end there.
    chars_per_token: tuple = (0.35, 1.0)
    byte_share: tuple = (None, 0.02)
    evenness: tuple = (0.06, None)
    #: Rows of a language from which the quartiles of a class of length are taken, if it has so many.
    support: int = 20
    grain: int = 4  # decimals


def _byte_pieces(model) -> list[int]:
    """1 for ids of fallback bytes, without that of the line break."""
    return [int(model.is_byte(i) and model.id_to_piece(i) != "<0x0A>") for i in range(model.get_piece_size())]


class Meter:
    """Measures of texts; keeps what it knows of words it has seen."""

    def __init__(self, folder: str, keep: int = 400_000):
        import sentencepiece

        self.enc = encoding(f"{folder}/{VOCABULARY}")
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECES}")
        self.is_byte = _byte_pieces(self.pieces)
        self.keep, self.words, self.units = keep, {}, {" ": 1}  # the model adds no space to an empty text

    def _learn(self, split: list[list[str]], cut: list[list[str]]) -> None:
        if len(self.words) > self.keep:
            self.words = {}
        if len(self.units) > self.keep:
            self.units = {" ": 1}
        for w in {w for t in split for w in t}.difference(self.words):
            self.words[w] = np.array(self.enc.encode_ordinary(w), np.int32).tobytes()
        new = list({u for t in cut for u in t}.difference(self.units))
        # no piece has a space after another character, so a text's pieces are those of its units; the model adds a space itself
        if new:
            found = self.pieces.encode([u[1:] if u[:1] == " " else u for u in new], num_threads=1)
            far = self.is_byte
            for u, ids in zip(new, found):
                self.units[u] = len(ids) + (sum(map(far.__getitem__, ids)) << 32)

    def measure(self, docs: list[str | None]) -> list[tuple]:
        """(tokens, characters per token, byte share, entropy, evenness) of each; None without a text."""
        docs = [utf8(t) if t else "" for t in docs]
        split = [pretokens(t) for t in docs]
        cut = [units_of(t) for t in docs]
        self._learn(split, cut)
        out = []
        for t, words, units in zip(docs, split, cut):
            if not t:
                out.append((0, None, None, None, None))
                continue
            ids = np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.int32)
            n = len(ids)
            c = np.unique(ids, return_counts=True)[1] if n < 20_000 else np.bincount(ids)
            c = c[c > 0]
            h = float(np.log2(n) - (c * np.log2(c)).sum() / n)
            both = sum(map(self.units.__getitem__, units))
            total, other = both & 0xFFFFFFFF, both >> 32
            even = h / np.log2(n) if n > 1 else 1.0
            out.append((n, len(t) / n, other / total, abs(h), max(0.0, float(even))))
        return out


def units_of(text: str) -> list[str]:
    """Words with the spaces before them; those of a single space without it."""
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return UNIT.findall(" " + text)
    return text.split(" ")


_METERS: dict[str, Meter] = {}


def meter(folder: str) -> Meter:
    """One for each process, as tasks share most words."""
    if folder not in _METERS:
        _METERS[folder] = Meter(folder)
    return _METERS[folder]


def script_of(text: str | None) -> str:
    """The script of most letters, of equals the first in the alphabet; ``none`` without letters."""
    letters = Counter(c for c in text or "" if c.isalpha())
    found: Counter = Counter()
    for c, n in letters.items():
        found[unicodedata.name(c, "none").split()[0].split("-")[0].lower()] += n
    return min(found, key=lambda s: (-found[s], s)) if found else "none"


def measure(docs: DataFrame, folder: str, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """``docs`` with the columns of ``MEASURES``; one pass, no shuffle."""
    schema = plus(docs.schema, MEASURES)
    lang = lang if lang in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = meter(folder)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                read = texts(batch, text)
                named = texts(batch, lang) if lang else [None] * len(read)
                got = list(zip(*known.measure(read)))
                names = ["n_tokens", "chars_per_token", "byte_share", "entropy", "evenness"]
                made = {k: pa.array(v, pa.int64() if k == "n_tokens" else pa.float64()) for k, v in zip(names, got)}
                made["band"] = pa.array([str(x) if x else script_of(t) for x, t in zip(named, read)], pa.string())
                yield appended(batch, schema, made)

    return docs.mapInArrow(run, schema)


def bands(measured: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(measure, band, class, low, high) over all rows; class is -1 for byte_share."""
    cell = lambda name, klass: F.struct(F.lit(name).alias("measure"), klass.alias("class"), F.round(name, cfg.grain).alias("value"))
    one = F.lit(-1)
    cells = F.array(cell("chars_per_token", length_class()), cell("byte_share", one), cell("evenness", length_class()))
    values = measured.where("n_tokens > 0").select("band", "n_tokens", F.explode(cells).alias("c")).select("band", "n_tokens", "c.*")
    counts = values.groupBy("measure", "band", "class", "value").count()
    counts = written(counts, "fertility-counts")
    own, wide = _banded(counts, cfg), _banded(_supported(counts, cfg), cfg)
    wide = wide.select("measure", "band", "class", F.col("low").alias("low2"), F.col("high").alias("high2"))
    both = own.join(wide, ["measure", "band", "class"], "left")
    return both.select("measure", "band", "class", F.greatest("low", "low2").alias("low"), F.least("high", "high2").alias("high"))


def _banded(counts: DataFrame, cfg: Config) -> DataFrame:
    """(measure, band, class, low, high) from counts of values."""
    w = Window.partitionBy("measure", "band", "class")
    upto = counts.withColumn("upto", F.sum("count").over(w.orderBy("value"))).withColumn("all", F.sum("count").over(w))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), F.col("value")))
    q = upto.groupBy("measure", "band", "class").agg(at(0.25).alias("q1"), at(0.75).alias("q3"))
    rows = {"chars_per_token": cfg.chars_per_token, "byte_share": cfg.byte_share, "evenness": cfg.evenness}
    far = (F.col("q3") - F.col("q1")) * cfg.fence
    pick = lambda k: F.coalesce(*(F.when(F.col("measure") == m, F.lit(ends[k]).cast("double")) for m, ends in rows.items()))
    low, high = F.col("q1") - F.greatest(far, pick(0)), F.col("q3") + F.greatest(far, pick(1))
    return q.select("measure", "band", "class", F.when(pick(0).isNotNull(), low).alias("low"), F.when(pick(1).isNotNull(), high).alias("high"))


def _supported(counts: DataFrame, cfg: Config) -> DataFrame:
    """Of the classes of few rows, ``counts`` with those of the nearest classes."""
    sizes = counts.groupBy("measure", "band", "class").agg(F.sum("count").alias("size"))
    near = sizes.where(F.col("size") < cfg.support).select("measure", "band", F.col("class").alias("of")).join(sizes, ["measure", "band"]).withColumn("far", F.abs(F.col("of") - F.col("class")))
    w = Window.partitionBy("measure", "band", "of").orderBy("far").rangeBetween(Window.unboundedPreceding, -1)
    taken = near.withColumn("nearer", F.coalesce(F.sum("size").over(w), F.lit(0))).where(F.col("nearer") < cfg.support).select("measure", "band", "class", "of")
    return counts.join(taken, ["measure", "band", "class"]).groupBy("measure", "band", F.col("of").alias("class"), "value").agg(F.sum("count").alias("count"))


def length_class():
    return F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double"))).cast("int")


def judge(measured: DataFrame, found: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``measured`` with ``reasons``, the measures outside their band, and ``keep``."""
    names = ("chars_per_token", "byte_share", "evenness")
    now = measured.drop("reasons", "keep")
    keys = []
    for m in names:
        b = found.where(F.col("measure") == m).select(F.col("band").alias(f"_wl_b_{m}"), F.col("class").alias(f"_wl_c_{m}"), F.col("low").alias(f"_wl_l_{m}"), F.col("high").alias(f"_wl_h_{m}"))
        klass = F.lit(-1) if m == "byte_share" else length_class()
        now = now.join(broadcast_if_small(b), (F.col("band") == F.col(f"_wl_b_{m}")) & (klass == F.col(f"_wl_c_{m}")), "left")
        value = F.round(m, cfg.grain)
        out = F.coalesce(value < F.col(f"_wl_l_{m}"), F.lit(False)) | F.coalesce(value > F.col(f"_wl_h_{m}"), F.lit(False))
        keys.append(F.when(out, F.lit(m)))
    reasons = F.array_compact(F.array(*keys))
    return now.withColumn("reasons", reasons).withColumn("keep", F.size("reasons") == 0).select(*[c for c in measured.columns if c not in ("reasons", "keep")], "reasons", "keep")


def rules(docs: DataFrame, folder: str, cfg: Config = Config()) -> DataFrame:
    """``docs`` measured and judged by bands over all of them."""
    measured = written(measure(docs, folder).drop("text"), "fertility")
    return judge(measured, written(bands(measured, cfg), "bands"), cfg)


def op2_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fertility of every document, and whether it lies within the bands of its language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return rules(docs, tokenizer_dir(spark))
