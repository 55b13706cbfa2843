from transitus.operators import text

DOCS = [(1, "red anvil. blue bolt! red gear"), (2, "blue bolt"), (3, "plain words here. a red anvil"), (4, "nothing")]


def test_equal_queries_get_equal_answers(spark):
    docs = spark.createDataFrame(DOCS, "doc int, text string")
    queries = spark.createDataFrame([("a", "red anvil"), ("b", "red anvil"), ("c", "blue"), ("d", "absent")], "q string, text string")
    got = {}
    for r in text.search_docs(docs, queries, 2, "doc", "q", common_share=0.9, min_rows=1).collect():
        got.setdefault(r.q, []).append((r.rank, r.doc))
    assert sorted(got) == ["a", "b", "c"] and sorted(got["a"]) == sorted(got["b"])
    assert sorted(got["a"])[0][1] in (1, 3) and sorted(got["c"]) == [(1, 2), (2, 1)]


def test_summary_prefers_rare_words(spark):
    docs = spark.createDataFrame(DOCS, "doc int, text string")
    plain = {r.doc: r.sentence for r in text.summarize_history(docs, 1, "doc").collect()}
    assert plain[1] == "red gear" and plain[2] == "blue bolt"
    assert {r.doc: r.sentence for r in text.summarize_history(docs, 1, "doc", min_rows=1).collect()} == plain


def test_summary_is_the_same_whatever_weights_are_held(spark):
    """Null and repeated keys, empty texts, sentences without words; tokens of the held words are not sent to other tasks."""
    rows = DOCS + [(1, "red gear. red! zinc"), (5, None), (6, "... !"), (None, "red anvil"), (7, "- . tin tin. red")]
    docs = spark.createDataFrame(rows, "doc int, text string")
    every = [sorted(map(tuple, text.summarize_history(docs, 2, "doc", min_rows=m, held=h).collect())) for h, m in ((200, 1_000), (0, 10), (2, 10))]
    assert every[0] == every[1] == every[2] and {r[0] for r in every[0]} == {1, 2, 3, 4, 7}
    assert [r[4] for r in every[0] if r[0] == 7] == ["tin tin", "red"]
    plan = text.summarize_history(docs, 2, "doc")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_search_is_exact_whatever_is_common(spark):
    """Which words count as common decides the way, never the result."""
    docs = spark.createDataFrame([(k, "the " * (1 + k % 7) + f"w{k % 5} w{k % 11} of") for k in range(60)], "doc int, text string")
    queries = spark.createDataFrame([(1, "the of"), (2, "the w3 w10"), (3, "w4 of the w0"), (4, "nothing")], "q int, text string")
    found = [
        sorted(map(tuple, text.search_docs(docs, queries, 6, "doc", "q", common_share=share).collect())) for share in (0.0, 0.15, 0.5, 1.0)
    ]
    assert len(found[0]) == 18 and all(f == found[0] for f in found)


def plain_bm25(docs, queries, k):
    import math
    import re
    from collections import Counter
    from decimal import ROUND_HALF_UP, Decimal

    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    own = {d: Counter(split(t)) for d, t in docs}
    n, total = len(own), sum(sum(c.values()) for c in own.values())
    out = []
    for q, t in queries:
        asked = list(dict.fromkeys(split(t)))
        scores = {}
        for w in asked:
            df = sum(w in c for c in own.values())
            for d, c in own.items():
                if w in c:
                    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                    s = idf * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) * n / total))
                    scores[d] = scores.get(d, 0) + Decimal(s).quantize(Decimal("0.000001"), ROUND_HALF_UP)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, rank, d, float(s)) for rank, (d, s) in enumerate(best, 1)]
    return sorted(out)


def test_index_is_extended_and_searched(spark, tmp_path):
    import random

    from transitus.operators import search_index

    draw = random.Random(11)
    told = lambda: " ".join(draw.choices(["the", "of", "and"], k=draw.randint(1, 30)) + draw.choices([f"w{k}" for k in range(40)], k=draw.randint(0, 12)))
    docs = [(k, told()) for k in range(120)] + [(200, ""), (201, None)]
    queries = [(k, " ".join(draw.choices(["the", "of", "and", "w1", "w2", "w3", "w9", "w17", "unseen"], k=4))) for k in range(25)] + [(90, ""), (91, "the of and")]
    asked = spark.createDataFrame(queries, "q int, text string")
    index = search_index.SearchIndex(spark, str(tmp_path / "index"), "doc", "int")
    assert index.search(asked, 4, "q").count() == 0
    frame = lambda rows: spark.createDataFrame(rows, "doc int, text string")
    index.add(frame(docs[:50]))
    for share in (0.0, 0.1, 0.5, 1.0):
        got = sorted((r["q"], r["rank"], r["doc"], r["score"]) for r in index.search(asked, 4, "q", common_share=share, min_rows=5).collect())
        assert got == plain_bm25(docs[:50], queries, 4)
    # added again in part; a segment without its row of counts does not exist
    index.add(frame([*docs[30:], (None, "w1 w1")]))
    index.add(frame(docs))
    frame([(999, "w1")]).selectExpr("doc", "'broken' AS segment").write.mode("append").partitionBy("segment").parquet(str(tmp_path / "index" / "documents"))
    assert index.documents().count() == 122
    for share in (0.05, 1.0):
        got = sorted((r["q"], r["rank"], r["doc"], r["score"]) for r in index.search(asked, 4, "q", common_share=share).collect())
        assert got == plain_bm25(docs, queries, 4)


def test_words_are_counted_within_their_row(spark):
    import re
    from collections import Counter

    from pyspark.sql import functions as F

    from transitus.functions.text import with_word_counts

    rows = [(1, "the the of The x1 of the"), (2, "one"), (3, ""), (4, None), (5, " .. "), (6, "b a, b; a b"), (6, "b c")]
    out = with_word_counts(spark.createDataFrame(rows, "doc int, text string"), F.col("text")).drop("text")
    want = []
    for doc, text in rows:
        found = Counter(re.findall(r"[^\W_]+", (text or "").lower()))
        want += [(doc, sum(found.values()), w, n) for w, n in found.items()]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    texts = spark.createDataFrame(rows, "doc int, text string")
    assert "Exchange" not in with_word_counts(texts, F.col("text"))._jdf.queryExecution().executedPlan().toString()


def test_index_counts_repeated_keys_and_left_out_words(spark, tmp_path):
    from transitus.operators import search_index

    docs = spark.createDataFrame([(1, "a b a"), (1, "b c"), (2, "c"), (3, None), (None, "a")], "doc int, text string")
    only = spark.createDataFrame([("a",), ("a",), ("c",)], "word string")
    for name, words_kept, postings in (
        ("all", None, [("a", 1, 2, 5), ("b", 1, 2, 5), ("c", 1, 1, 5), ("c", 2, 1, 1)]),
        ("some", only, [("a", 1, 2, 5), ("c", 1, 1, 5), ("c", 2, 1, 1)]),
    ):
        index = search_index.SearchIndex(spark, str(tmp_path / name), "doc", "int")
        index.add(docs, only=words_kept)
        assert sorted(tuple(r) for r in index.postings().select("word", "doc", "_tf", "_dl").collect()) == postings
        assert [(r.n_docs, r.n_words) for r in index.segments().collect()] == [(3, 6)]
        assert {r.word: r._df for r in index.frequency().collect()} == {w: sum(p[0] == w for p in postings) for w, *_ in postings}
        assert sorted(r.doc for r in index.documents().collect()) == [1, 2, 3]
