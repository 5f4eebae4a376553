import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import corpus, frame
from tests.llm.test_operators import brute_components, brute_secrets, encoding
from wirelens.llm import op6_language as op

WORDS = {"en": "the of and with that this have from".split(), "de": "der die und mit nicht über schön straße".split(), "fr": "les des avec pour être où déjà façon".split()}


def texts(n=240, seed=0):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        t = " ".join(r.choice(WORDS[lang], int(r.integers(1, 30))))
        told = lang if r.random() < 0.9 else None
        rows.append((i, t, told, [f"{lang}.example.org", f"www.{lang}-site.{lang}", "mixed.net", None][int(r.integers(4))]))
    return rows + [(1000, None, "en", "x.org"), (1001, "", None, None), (1002, "12345 !!! 678", "de", "mixed.net"), (1003, "the", "xx", "new.host"), (0, rows[0][1], rows[0][2], rows[0][3]), (None, "und nicht", "de", None)]


def grams(text):
    b = b" " + text.encode().lower() + b" "
    out = []
    for k in range(1, len(b) - 1):
        if 97 <= b[k] <= 122 or b[k] >= 128:
            h = (b[k - 1] * 0x9E3779B1 ^ b[k] * 0x85EBCA77 ^ b[k + 1] * 0xC2B2AE3D) & 0xFFFFFFFF
            h = ((b[k - 1] * 0x9E3779B1) & 0xFFFFFFFF) ^ ((b[k] * 0x85EBCA77) & 0xFFFFFFFF) ^ ((b[k + 1] * 0xC2B2AE3D) & 0xFFFFFFFF)
            out.append(((h * 0x27D4EB2F) & 0xFFFFFFFF) >> 16)
    return out


def brute(rows):
    """Every row's posterior, by dictionaries."""
    langs = sorted({x for _, t, x, _ in rows if t is not None and x is not None})
    seen = {k: Counter() for k in langs}
    for _, t, x, _ in rows:
        if t is not None and x is not None:
            seen[x].update(grams(t))
    size = {k: sum(seen[k].values()) + 0.05 * op.GRAMS for k in langs}
    scores, best = [], []
    for _, t, *_ in rows:
        g = grams(t or "")
        s = {k: sum(math.log((seen[k][x] + 0.05) / size[k]) for x in g) for k in langs}
        top = max(s.values())
        s = {k: (v - top) * min(1.0, op.EVIDENCE / max(1, len(g))) for k, v in s.items()} if g else None
        scores.append(s)
        best.append(max(langs, key=lambda k: s[k]) if s else None)

    def told(value):  # counts of the best language by value
        out = {}
        for b, row in zip(best, rows):
            if b is not None and value(row) is not None:
                out.setdefault(value(row), Counter())[b] += 1
        return out

    whole = sum(b is not None for b in best)
    prior = {k: (sum(b == k for b in best) + 1) / (whole + len(langs)) for k in langs}
    smooth = lambda c, above, w: {k: (c[k] + above[k] * w) / (sum(c.values()) + w) for k in langs}
    domain = lambda h: None if h is None else ".".join(h.split(".")[-2:])
    suffix = lambda h: None if h is None or "." not in h else h.split(".")[-1]
    domains = {d: smooth(c, prior, op.DOMAIN_WEIGHT) for d, c in told(lambda r: domain(r[3])).items()}
    hosts = {h: smooth(c, domains[domain(h)], op.HOST_WEIGHT) for h, c in told(lambda r: r[3]).items()}

    def evidence(value):
        c = told(value)
        n = {k: sum(x[k] for x in c.values()) + op.SMOOTH * max(1, len(c)) for k in langs}
        return {v: {k: math.log((x[k] + op.SMOOTH) / n[k]) for k in langs} for v, x in c.items()}

    declared, suffixes = evidence(lambda r: r[2]), evidence(lambda r: suffix(r[3]))
    out = []
    for (i, _, x, h), s, b in zip(rows, scores, best):
        if s is None:
            out.append((i, None, None, None, False))
            continue
        p = {k: s[k] + math.log(hosts.get(h, prior)[k]) + declared.get(x, dict.fromkeys(langs, 0))[k] + suffixes.get(suffix(h), dict.fromkeys(langs, 0))[k] for k in langs}
        top = max(p.values())
        z = sum(math.exp(v - top) for v in p.values())
        out.append((i, b, max(langs, key=lambda k: p[k]), 1 / z, 1 / z >= op.LEAST))
    return out


def test_language_like_brute_force(spark):
    rows = texts()
    got = op.query(frame(spark, rows)).select("doc_id", "text_language", "language", "probability", "kept").collect()
    for a, b in zip(sorted(got, key=lambda r: str(r[:3])), sorted(brute(rows), key=lambda r: str(r[:3])), strict=True):
        assert tuple(a)[:3] == b[:3] and a["kept"] == b[4]
        assert a["probability"] == pytest.approx(b[3], rel=1e-4) if b[3] is not None else a["probability"] is None


def test_language_of_held_out_rows(spark):
    rows = texts(300, 1)
    true = {i: sorted(WORDS)[i % 3] for i in range(300)}
    half = [(i, t, x if i % 2 else None, h) for i, t, x, h in rows if i is not None and i < 300]
    got = op.query(frame(spark, half)).filter("doc_id % 2 = 0 AND length(text_language) > 0").collect()
    assert np.mean([r["language"] == true[r["doc_id"]] for r in got]) > 0.95


def test_pages_and_defined_results(spark):
    pages = spark.createDataFrame([(1, "https://u:p@WWW.Site.de:80/x", "<html LANG='de-AT'><script>the the</script><p>und nicht mit der</p></html>"), (2, None, None), (3, "x", "<p>the of and</p>")],
                                  "page_id long, url string, html string")
    got = {r["page_id"]: r for r in op.identify_pages(pages, frame(spark, texts())).collect()}
    assert (got[1]["declared"], got[1]["language"], got[2]["language"], got[3]["language"]) == ("de", "de", None, "en")
    assert pages.select(op.host_of(F.col("url"))).first()[0] == "www.site.de"
    d = frame(spark, texts())
    assert op.query(d.limit(0)).collect() == []
    assert not any(r["kept"] for r in op.query(d.withColumn("lang", F.lit(None).cast("string"))).collect())
    kept = op.kept_documents(d)
    want = Counter(i for i, *_, k in brute(texts()) if k)
    assert kept.columns == d.columns and Counter(r["doc_id"] for r in kept.collect()) == want


def test_pipeline_stages(spark, tmp_path):
    rows = corpus(11, 80) + [(700, "the password = hunter22 is here", "en", "a")]
    d = frame(spark, rows)
    path = str(tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "redact_secrets", "mix_sources", "tokenise"]
    back = {}
    for name, stage in stages.items():
        if name == "near_dedup":
            before = [tuple(r)[:4] for r in d.collect()]
            want = {i for i, *_, kept in brute_components([r for r in before if r[0] is not None], 5) if kept}
        out = stage(spark, d, path)
        out.write.parquet(f"{path}/{name}")
        out = spark.read.parquet(f"{path}/{name}")
        if name != "tokenise":
            assert out.columns == d.columns
        back[name] = out
        if name == "language_id":
            gone = {r["doc_id"] for r in d.collect()} - {r["doc_id"] for r in out.collect()}
            assert {1, 2, 3} <= gone and len(gone) < 10
        elif name == "near_dedup":
            assert Counter(r["doc_id"] for r in out.collect()) == Counter(want)
        elif name == "redact_secrets":
            assert out.count() == d.count() and not any(brute_secrets(r["text"]) for r in out.collect())
        elif name == "tokenise":
            enc, text = encoding(), Counter()
            for r in d.collect():
                text[r["doc_id"], np.array(enc.encode_ordinary(r["text"]), "<u4").tobytes()] += 1
            assert Counter((r["doc_id"], bytes(r["ids"])) for r in out.collect()) == text
            assert all(r["round_trip"] for r in out.collect())
        d = out


def test_pipeline_of_nothing(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
