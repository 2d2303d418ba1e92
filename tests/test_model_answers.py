"""The batch call's answers against their SQL on texts that begin with any letter."""

import sys

from tests.compare import compare, connect
from workload import ORACLES, QUERIES


def test_first_letters(spark, tmp_path):
    cased = [c for c in map(chr, range(1, sys.maxunicode + 1)) if not "\ud800" <= c <= "\udfff" and len({c, c.upper(), c.title()}) > 1]
    several = [c for c in cased if len(c.upper()) > 1]
    assert {"ß", "ŉ", "ﬁ", "ᾳ"} <= set(several)
    texts = [*(f"{c}heit ist" for c in cased), "ßachzu", "état", "\U0001f468‍\U0001f469 x", "", None, None, "ßachzu"]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(path)
    con = connect(str(tmp_path / "none"))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert compare(spark, con, QUERIES["model_answers"], ORACLES["model_answers"], str(tmp_path)) == []
