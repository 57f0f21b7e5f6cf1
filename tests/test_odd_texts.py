"""Redaction of odd texts, against SQL."""

import pytest

from tests.oracle import same
from weftline.plans import catalogue

CARD, OTHER = "5500005555555559", "4111111111111111"
TEXTS = [
    f"{CARD}. Again {CARD} end", f"{CARD} end. Again {CARD}.", f"{OTHER} x {OTHER}, {CARD} y",  # one match is part of another
    "邮箱foo@bar.com是", "café.foo@bar.com é+x@y.de bar@x.é", "é(555) 123-4567 ü555-123-4567ü", "a 10.0.0.1ß ×10.0.0.2÷ ª10.0.0.3º", "é123-45-6789 123-45-6789́", "555\x0b123\x0b4567 555 123 4567",
    "held [REDACTED_EMAIL] already", f"4111111111111111{CARD} and {CARD}", "ABCDEFGH中 DEUTDEFFé 中GB82WEST12345698765432中 acct: 123456789é", None, "", "é", " é 1 é1é",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    rows = [(7 * i + k, t) for i, t in enumerate(TEXTS) for k in range(4)]
    spark.createDataFrame(rows, "doc_id bigint, text string").toPandas().to_parquet(at / "documents.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["pii_redact", "financial_redact"])
def test_odd_texts_are_redacted_as_in_sql(spark, odd, name):
    same(catalogue.QUERIES[name](spark, odd), catalogue.ORACLE_SQL[name], odd)
