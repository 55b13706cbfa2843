"""Decontamination, BPE, language ID and page text against plain versions, with nulls, empty and odd inputs."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from transitus.llm import bpe, decontaminate, html_text, language_id
from transitus.llm.common import prepared

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, _hits string, spans string, kept string, n_words string"


def words(text):
    return WORD.findall((text or "").encode().lower())


def brute_hits(text, items, window):
    told, hit, found = words(text), set(), set()
    for name, item in items:
        own = words(item)
        size = min(window, len(own))
        runs = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
        for at in range(len(told) - size + 1):
            if tuple(told[at : at + size]) in runs:
                hit.update(range(at, at + size))
                found.add(name)
    return len(told), len(hit), sorted(found)


def test_decontaminate(spark):
    prepared(spark)
    items = [("10", "a b c d e f"), ("9", "x y"), ("7", "B c-D e z"), ("5", None), ("4", "  "), ("3", "é1 é2 é3"), ("10", "a b c d e f")]
    texts = [
        None, "", "...", "a b c d e f", "q A B c D q x Y q", "x y x y", "b c d e f é1 é2 é3 é4", "a b c a b c d", "y x",
        "a b c d e f " * 500 + "x", "x",
    ]
    docs = spark.createDataFrame([(k, t, "", "", "", "") for k, t in enumerate(texts)], SCHEMA)
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    for window in (3, 4):
        got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, benchmark, window).collect()}
        for k, text in enumerate(texts):
            n, hits, found = brute_hits(text, items, window)
            row = got[k]
            assert (row["n_words"], row["n_hit"], row["items"]) == (n, hits, found), (window, text)
            assert row["contaminated"] == (hits > 0 and 20 * hits >= n)
    many = docs.select("doc_id", decontaminate.item_hits(F.col("text"), benchmark, 3, most=2).alias("h"))
    for row in many.collect():
        n, hits, found = brute_hits(texts[row["doc_id"]], items, 3)
        assert (sum(s["stop"] - s["start"] for s in row["h"]["spans"]), row["h"]["items"]) == (hits, found)
    assert decontaminate.decontaminate(docs.limit(0), benchmark).count() == 0
    none = decontaminate.decontaminate(docs, benchmark.limit(0))
    assert none.filter("contaminated or n_items > 0").count() == 0


def test_cut_spans(spark):
    prepared(spark)
    docs = spark.createDataFrame([("Q a, b! c. R",), (None,)], "text string")
    benchmark = spark.createDataFrame([("1", "A b c")], "item_id string, text string")
    found = docs.select("text", decontaminate.item_hits(F.col("text"), benchmark, 3).alias("h"))
    got = [r[0] for r in found.select(decontaminate.cut_spans("text", "h.spans")).collect()]
    assert got == ["Q . R", None]


def test_bpe_as_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    prepared(spark)
    plain = tokenizers.Tokenizer.from_file(path)
    texts = [
        None, "", " ", "Hello  world\n\n\tit's 2024, don't!", "<|endoftext|>a<|endoftext|><|endoftext|> b", "naïve — 日本語 🙂‍↔️",
        "a" * 5000, "ab" * 3000 + "  " * 40 + " x", "\x00\x1f\x7f̀é", "x <|endoftext", "१२३ ②½",
    ]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = docs.select("doc_id", bpe.round_trip(spark, F.col("text"), path, with_ids=True).alias("c")).collect()
    for row in rows:
        ids = plain.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids
        back = plain.decode(ids, skip_special_tokens=False)
        assert row["c"]["ids"] == ids
        assert row["c"]["n_tokens"] == len(ids)
        assert row["c"]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["c"]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
    ids = docs.select(bpe.encoder(spark, path)("text").alias("ids"))
    back = [r[0] for r in ids.select(bpe.decoder(spark, path)("ids")).collect()]
    assert back == [t or "" for t in texts]
    # a cut token sequence need not be UTF-8
    assert bpe.Bpe(open(path, encoding="utf-8").read()).decode([plain.encode("é").ids[0], 220]) == plain.decode([plain.encode("é").ids[0], 220])


def test_language_id(spark):
    prepared(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame(
        [(-1, None, None), (-2, "", "en"), (-3, "123 ... !", "fr"), (None, "the of and", None)], "doc_id bigint, text string, lang string"
    )
    both = docs.select("doc_id", "text", "lang").unionByName(odd)
    found = language_id.language_id(both)
    assert found.filter("score < 0 or score > 1").count() == 0
    blank = found.filter("doc_id < 0").collect()
    assert {(r["lang_pred"], r["score"], r["ambiguous"]) for r in blank} == {("und", 0.0, True)}
    tested = found.filter("held_out").join(docs, "doc_id")
    assert tested.filter("lang_pred = lang").count() >= 0.97 * tested.count()
    untaught = language_id.language_id(both.withColumn("lang", F.lit(None).cast("string")))
    assert untaught.filter("lang_pred != 'und'").count() == 0
    assert language_id.language_id(both.limit(0)).count() == 0


def test_language_stage_keeps_ambiguous_texts(spark):
    import corpus_pipeline

    prepared(spark)
    rows = [(i, "some plain words are here" if i % 2 else "quelques mots simples ici", "en" if i % 2 else "fr") for i in range(40)]
    odd = [(100, "ж", None), (101, "123 ...", None), (102, None, None), (103, "some plain words are here", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string")
    found = {r["doc_id"]: r["language_ambiguous"] for r in corpus_pipeline.known_language(spark, docs, "").collect()}
    assert found == {i: False for i in range(40)} | {100: True, 103: False}
    untaught = corpus_pipeline.known_language(spark, docs.withColumn("lang", F.lit(None).cast("string")), "").collect()
    assert {r["doc_id"] for r in untaught} == {*range(40), 100, 103} and all(r["language_ambiguous"] for r in untaught)


@pytest.mark.parametrize("languages", [1, 2, 4, 7, 8, 20])
def test_codewords_differ(languages):
    code = language_id.codewords(languages)
    assert len(code) == languages
    apart = [(code[a] != code[b]).sum() for a in range(languages) for b in range(a)]
    assert not apart or min(apart) >= max(1, code.shape[1] // 2)


ARTICLE = "".join(f"<p>Sentence number {k} is here, long enough to be read. It has a second part.</p>" for k in range(6))


def test_page_text(spark):
    prepared(spark)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    odd = spark.createDataFrame(
        [
            (-1, None, None), (-2, "u", ""), (-3, "u", "<p>"), (-4, "u", "<div>" * 3000 + "x" + "</div>" * 10),
            (-5, "u", f"<body><div class='menu'><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></div><article><h1>A &amp; B</h1>{ARTICLE}"
             "<aside>See also</aside><form>Name <input></form></article><div class=comments><p>I agree with all of this. Well said.</p></div>"
             "<footer>&copy; us</footer>"),
            (-6, "u", f"<div id='sidebar'><p>Buy this now.</p></div><div id='content'>{ARTICLE}one<br>two<!-- gone --><script>var a='<p>';</script></div>"),
            (-7, "u", "<script>never closed <p>text"), (-8, "u", "</p></div>&#0;&bogus;"),
        ],
        "page_id bigint, url string, html string",
    )
    model = html_text.train(pages)
    found = {r["page_id"]: r["text"] for r in odd.select("page_id", html_text.extractor(pages, model)("html")["text"].alias("text")).collect()}
    lines = [f"Sentence number {k} is here, long enough to be read. It has a second part." for k in range(6)]
    assert found[-1] == found[-2] == found[-3] == found[-7] == ""
    assert found[-5] == "\n".join(["A & B", *lines])
    assert found[-6] == "\n".join([*lines, "one two"])
    whole = html_text.main_text(pages.unionByName(odd))
    assert whole.count() == pages.count() + 8
    assert whole.filter("n_chars != length(text)").count() == 0
    assert html_text.main_text(pages.limit(0)).count() == 0


PAGE_CASES = [
    # an end tag of head may be left out
    ("<html><head><title>t</title><body><article><p>Kept text. It stays.</p></article>", "Kept text. It stays."),
    ("<head><title>t</title><article><p>Kept text. It stays.</p></article>", "Kept text. It stays."),
    # a div ends an unclosed svg
    ("<body><article><svg><path d='M0'><div><p>Kept text. It stays.</p></div></article>", "Kept text. It stays."),
    # names that say what is absent, or of which the last word counts
    ("<body class='single post no-sidebar'><article><p>Kept text. It stays.</p></article>", "Kept text. It stays."),
    ("<body><div class='share-article main'><p>Kept text. It stays.</p></div>", "Kept text. It stays."),
    ("<body><article><div class='search-results'><p>Kept text. It stays.</p></div></article>", "Kept text. It stays."),
    # what is not shown does not part the text around it
    ("<article><p>one <script>x()</script>two three.</p></article>", "one two three."),
    ("<article><p>one <button><div>Share</div></button> two <svg><title>i</title></svg>three.</p></article>", "one two three."),
    ("<article><p>one.</p><noscript><p>no script</p></noscript><p>two.</p></article>", "one.\ntwo."),
    # and these still go
    ("<article><p>Kept text. It stays.</p><div class='share-buttons'><p>Send it on.</p></div></article>", "Kept text. It stays."),
    ("<body><div class='post-comments'><p>I disagree. Really.</p></div><main><p>Kept text. It stays.</p></main>", "Kept text. It stays."),
]


def test_odd_markup(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    model = html_text.train(pages)
    for html, text in PAGE_CASES:
        assert model.text(html) == text, html


def test_deep_pages_take_linear_time():
    import time

    started = time.process_time()
    dom = html_text.Dom("<div>" * 100_000 + "<p>deep" + "</div>" * 100_000)
    assert len(dom.blocks) == 100_002 and dom.texts == [(100_001, "deep")] and time.process_time() - started < 20


def test_marginals_are_those_of_all_labellings():
    """Messages against the sum over every labelling of small trees."""
    import itertools
    import math
    import random

    draw = random.Random(4)
    model = html_text.PageModel({}, {})
    for _ in range(10):
        html = "".join(draw.choice(["<div>", "<p>words here.", "</div>", "<ul><li>x", "</ul>", "<nav>", "</nav>", "<a href=x>y</a>"]) for _ in range(8))
        dom = html_text.Dom(html)
        odds = [math.exp(sum(model.odds.get(item, 0.0) for item in features.items())) for features in html_text.described(dom)]
        weights = {}
        for labels in itertools.product((0, 1), repeat=len(dom.blocks)):
            own = math.prod(o for o, label in zip(odds, labels, strict=True) if label)
            ties = math.prod(model.ties[b.kind, labels[b.parent]][labels[k]] for k, b in enumerate(dom.blocks) if k)
            weights[labels] = own * ties
        whole = sum(weights.values())
        for k, chance in enumerate(model.marginals(dom)):
            assert chance == pytest.approx(sum(w for labels, w in weights.items() if labels[k]) / whole)
