"""The registered language ID of web pages against brute force."""

import pytest

from tests.llm.test_language_pipeline import brute, texts
from wirelens.llm.queries import queries


def test_pages_like_brute_force(spark, tmp_path):
    rows = texts()
    pages = [(i, h and f"https://{h}:80/x/y?z=1", f"<html{f' lang={x!r}' if x else ''}><script>the und les</script><p>{t or ''}</p></html>") for i, t, x, h in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries()["op6_language_id_pages"](spark, str(tmp_path)).select("page_id", "text_language", "language", "probability", "kept").collect()
    for a, b in zip(sorted(got, key=lambda r: str(r[:3])), sorted(brute(rows), key=lambda r: str(r[:3])), strict=True):
        assert tuple(a)[:3] == b[:3] and a["kept"] == b[4]
        assert a["probability"] == pytest.approx(b[3], rel=1e-4) if b[3] is not None else a["probability"] is None
