"""The phrase automaton against a plain search, with nested phrases, long texts and dictionaries in several parts."""

import random

import pytest
from pyspark.sql import functions as F

from transitus.functions import phrases
from transitus.functions.text import words
from transitus.operators import guardrails

PHRASES = ["a", "a b", "b", "b c a", "a b c", "c c", "a b a b", "x", "unseen words here"]


def plain_hits(told, wanted):
    out = []
    for phrase in wanted:
        own = phrase.split(" ")
        out += [phrase] * sum(told[k : k + len(own)] == own for k in range(len(told)))
    return sorted(out)


def test_automaton_finds_all_places():
    draw = random.Random(3)
    automaton = phrases.PhraseAutomaton(PHRASES)
    for _ in range(300):
        told = [draw.choice("abcd") for _ in range(draw.randint(0, 30))]
        assert sorted(automaton.hits(told, 1 << 30)) == plain_hits(told, PHRASES)


@pytest.mark.parametrize("part_words, at_once, piece", [(200_000, 4, 1024), (4, 1, 5), (4, 3, 2)])
def test_phrase_hits(spark, monkeypatch, part_words, at_once, piece):
    monkeypatch.setattr(phrases, "PART_WORDS", part_words)
    monkeypatch.setattr(phrases, "PARTS_AT_ONCE", at_once)
    monkeypatch.setattr(phrases, "SLICE", piece)
    draw = random.Random(5)
    texts = [[draw.choice("abcdx") for _ in range(draw.randint(0, 40))] for _ in range(30)] + [None, []]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, tokens array<string>")
    table = spark.createDataFrame([(p, k) for k, p in enumerate(PHRASES)] + [("a", 100), (None, 7), ("", 8)], "phrase string, code int")
    got = sorted((r["id"], r["phrase"], r["code"]) for r in phrases.phrase_hits(docs, ["id"], "tokens", table, "phrase").collect())
    code = {p: [k] for k, p in enumerate(PHRASES)}
    code["a"].append(100)
    assert got == sorted((i, p, c) for i, told in enumerate(texts) for p in plain_hits(told or [], PHRASES) for c in code[p])
    short = phrases.phrase_hits(docs, ["id"], "tokens", table, "phrase", 1)
    assert {r["phrase"] for r in short.collect()} == {"a", "b", "x"}
    assert phrases.phrase_hits(docs, ["id"], "tokens", table.limit(0), "phrase").count() == 0
    assert phrases.phrase_hits(docs.limit(0), ["id"], "tokens", table, "phrase").count() == 0


def test_a_dictionary_of_seventy_thousand(spark):
    """One pass: a code system of 70,000 phrases, against a join of word runs."""
    name = lambda k: F.concat(F.lit("w"), (k % 997).cast("string"), F.lit(" v"), (k % 71).cast("string"), F.lit(" u"), F.floor(k / 50).cast("string"))
    table = spark.range(70_000).select(name(F.col("id")).alias("term"), F.col("id").alias("code"))
    docs = spark.range(300).select(
        F.col("id").alias("transition_id"), F.concat(F.lit("Said: "), name(F.col("id") * 233), F.lit(", and "), name(F.col("id") * 7 + 90_000), F.lit(".")).alias("text")
    )
    assert sum(1 for _ in phrases.parts(table, "term")) == 2 <= phrases.PARTS_AT_ONCE
    got = {tuple(r) for r in guardrails.mentioned_terms(docs, table, "text").collect()}
    runs = docs.select("transition_id", words("text").alias("w")).select(
        "transition_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda at: F.array_join(F.slice("w", at, F.lit(3)), " "))).alias("term")
    )
    want = {tuple(r) for r in runs.join(table, "term").select("transition_id", "term").distinct().collect()}
    assert got == want and len(got) == 300


def test_terms_are_compared_by_words(spark):
    docs = spark.createDataFrame([(1, "Takes beta-blocker; and ASPIRIN."), (2, None)], "transition_id int, text string")
    got = guardrails.mentioned_terms(docs, ["Beta-Blocker", "aspirin", "blocker aspirin"], "text").collect()
    assert sorted(tuple(r) for r in got) == [(1, "aspirin"), (1, "beta-blocker")]


@pytest.mark.parametrize("piece", [1024, 3])
def test_a_dictionary_beyond_the_automata_stays_distributed(spark, monkeypatch, piece):
    """Not collected part by part: places of all lengths come by a join, across the borders of pieces too."""
    def collected(*_):
        raise AssertionError("the dictionary was collected")

    monkeypatch.setattr(phrases, "PART_WORDS", 2)
    monkeypatch.setattr(phrases, "SLICE", piece)
    monkeypatch.setattr(phrases, "parts", collected)
    draw = random.Random(11)
    texts = [[draw.choice("abcdx") for _ in range(draw.randint(0, 40))] for _ in range(30)] + [None, []]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, tokens array<string>")
    table = spark.createDataFrame([(p, k) for k, p in enumerate(PHRASES)] + [("a", 100), (None, 7), ("", 8)], "phrase string, code int")
    got = phrases.phrase_hits(docs, ["id"], "tokens", table, "phrase")
    assert got.columns == ["phrase", "id", "code"]
    code = {p: [k] for k, p in enumerate(PHRASES)}
    code["a"].append(100)
    want = sorted((p, i, c) for i, told in enumerate(texts) for p in plain_hits(told or [], PHRASES) for c in code[p])
    assert sorted(tuple(r) for r in got.collect()) == want
