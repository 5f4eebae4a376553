"""Which patterns of the rarest-gram index are looked up gram by gram."""

from wirelens.operators.substrings import gram_index, keyed_patterns, substring_matches


def test_patterns_with_an_end_no_text_holds_are_left_out(spark):
    texts = ["www.example.com", "bücher.漢字.org", "v16.cdn", "ab", "😀x😀y.z"]
    patterns = ["example", "exa", "example99", "99example", "a99com", "漢字.org", "xam", "w.e", "", "a", "ab", "zz", "www.org", "e.comb", None, "exa", "😀y.z", "x😀y"]
    t = spark.createDataFrame([(x,) for x in texts], "h string")
    p = spark.createDataFrame([(i, x) for i, x in enumerate(patterns)], "i int, p string")
    got = {(r.h, r.i) for r in substring_matches(t, "h", p, "p").collect()}
    assert got == {(h, i) for h in texts for i, x in enumerate(patterns) if x is not None and x in h}
    keyed = sorted(r.p for r in keyed_patterns(gram_index(t, "h"), p, "p").collect() if len(r.p) >= 3)
    # "a99com" and "www.org" begin and end with grams that texts hold
    assert keyed == sorted(["example", "exa", "exa", "xam", "w.e", "漢字.org", "www.org", "😀y.z", "x😀y"])
