import math
from collections import Counter, defaultdict

import sentencepiece
from pyspark.sql import functions as F

from weftline.llm import fertility
from weftline.llm.bpe import VOCABULARY
from weftline.llm.common import TOKENIZER_DIR, encoding

PIECES = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZER_DIR}/{fertility.PIECES}")
ENC = encoding(f"{TOKENIZER_DIR}/{VOCABULARY}")


def brute(t):
    if not t:
        return (0, None, None, None, None)
    ids, pieces = ENC.encode_ordinary(t), PIECES.encode(t)
    n = len(ids)
    h = -sum(c / n * math.log2(c / n) for c in Counter(ids).values())
    share = sum(PIECES.is_byte(i) and PIECES.id_to_piece(i) != "<0x0A>" for i in pieces) / len(pieces)
    return (n, len(t) / n, share, abs(h), h / math.log2(n) if n > 1 else 1.0)


def test_measures_equal_encodings_of_whole_texts(documents, nasty):
    texts = [r.text for r in documents.collect()] + [r.text for r in nasty.collect()] + [" a  b ", "  ", "a\n b", "\n", "a "]
    for t, got in zip(texts, fertility.Meter(TOKENIZER_DIR).measure(texts)):
        want = brute(t)
        assert all(a == b or abs(a - b) < 1e-9 for a, b in zip(got, want)), t


def test_query_against_brute_force(spark, sf_dir, documents):
    cfg = fertility.Config()
    rows = {r.doc_id: (r.lang, brute(r.text)) for r in documents.collect()}
    values = defaultdict(list)
    names = {"chars_per_token": 1, "byte_share": 2, "evenness": 4}
    key = lambda m, lang, n: (m, lang, int(math.log2(max(n, 1))) if m != "byte_share" else -1)
    for lang, v in rows.values():
        for m, i in names.items():
            if v[0] > 0:
                values[key(m, lang, v[0])].append(round(v[i], 4))
    band = {}

    def ends(k, v):
        v = sorted(v)
        q1, q3 = v[math.ceil(len(v) * 0.25) - 1], v[math.ceil(len(v) * 0.75) - 1]
        below, above = getattr(cfg, k[0])
        far = (q3 - q1) * cfg.fence
        return (None if below is None else q1 - max(far, below), None if above is None else q3 + max(far, above))

    for k, v in values.items():
        band[k] = ends(k, v)
        if len(v) < cfg.support:
            alike = sorted((abs(j[2] - k[2]), j) for j in values if j[:2] == k[:2])
            pool = [x for far, j in alike if sum(len(values[i]) for d, i in alike if d < far) < cfg.support for x in values[j]]
            wide = ends(k, pool)
            band[k] = tuple(f(a, b) if a is not None else None for f, a, b in zip((max, min), band[k], wide))
    got = {r.doc_id: r for r in fertility.op2_fertility(spark, sf_dir).collect()}
    assert set(got) == set(rows)
    for i, (lang, v) in rows.items():
        want = []
        for m, j in names.items():
            lo, hi = band.get(key(m, lang, v[0]), (None, None))
            if v[0]:
                if (lo is not None and round(v[j], 4) < lo) or (hi is not None and round(v[j], 4) > hi):
                    want.append(m)
        assert got[i].reasons == want and got[i].keep == (not want), i


def test_good_documents_stay(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    got = fertility.op2_fertility(spark, sf_dir).join(labels, "doc_id")
    assert got.where("keep").count() >= 0.97 * got.count()


def test_nasty_rows_and_empty_table(nasty, empty):
    df = nasty.withColumn("keep", F.lit("mine")).withColumn("band", F.lit(1)).withColumn("class", F.lit(2)).withColumn("value", F.lit(2))
    got = {(r.doc_id, r.n_chars): r for r in fertility.rules(df, TOKENIZER_DIR).collect()}
    assert got[1, 1].keep and got[1, 1].n_tokens == 0 and got[1, 1].chars_per_token is None
    assert got[3, 4].band == "none" and fertility.rules(df, TOKENIZER_DIR).count() == df.count()
    assert fertility.rules(empty, TOKENIZER_DIR).count() == 0


def test_a_single_very_long_text_of_one_line_is_rejected(spark, documents):
    rows = [(r.doc_id, r.text, "en") for r in documents.where("lang = 'en' and length(text) > 200").collect()]
    line = rows[0][1][:120]
    df = spark.createDataFrame([*rows, (-1, line * 4000, "en")], "doc_id bigint, text string, lang string")
    (got,) = fertility.rules(df, TOKENIZER_DIR).where("doc_id = -1").collect()
    assert got.reasons == ["evenness"] and not got.keep


def test_script_of():
    assert fertility.script_of("abcd где") == "latin" and fertility.script_of("где abc") == "cyrillic" and fertility.script_of("1 2") == fertility.script_of(None) == "none"
