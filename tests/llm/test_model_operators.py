"""Fill-in-the-middle, context-tree scores and spelling variants against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import oracle
from transitus.llm import context_tree, fill_in_middle, spelling
from transitus.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
CLASH = "doc_id bigint, text string, _formed string, n bigint, gram string, word string, chunk string, learn string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "", 0, "", "", "", "") for i, t in rows], CLASH)


# Fill in the middle


@given(st.text(max_size=60), st.data())
@settings(max_examples=300, deadline=None)
def test_exceptions_convert_both_ways(text, data):
    whole = text.encode("utf-8", "ignore").decode()
    index = fill_in_middle.Exceptions(whole.encode())
    cuts = sorted(data.draw(st.lists(st.integers(0, len(whole)), min_size=1)))
    plain = [len(whole[:c].encode()) for c in cuts]
    assert index.length == len(whole) and index.byte_of(cuts).tolist() == plain and index.point_of(plain).tolist() == cuts


def plain_form(doc_id, text, spm=20):
    text, n = text or "", len(text or "")
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    told = [None, "", "a", "é", "plain words", "日本語 mixed ñ 🙂🙂 text", "has <P> mark", "<S", "<M><", "x" * 300_000 + "ü", "a\u0000b\n"]
    rows = [(k, told[k % len(told)]) for k in range(120)] + [(None, "no id"), (3, "é"), (3, "é")]
    docs = clashing(spark, rows)
    for spm in (20, 100):
        made = fill_in_middle.fill_in_middle(docs, spm=spm)
        got = made.withColumn("back", fill_in_middle.restore(made["output"], made["form"])).collect()
        mine = sorted((repr(r["doc_id"]), r["n"], r["form"], repr(r["prefix_chars"]), repr(r["middle_chars"]), r["output"], r["back"]) for r in got)
        want = []
        for i, t in rows:
            n, form, a, b, out = plain_form(i, t, spm)
            want.append((repr(i), n, form, repr(a), repr(b), out, t or ""))
        assert mine == sorted(want)
        assert {r["form"] for r in got} >= {"plain", "spm"}
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_fill_in_middle_against_sql(spark):
    name = "op11_fill_in_middle"
    assert oracle.compare(name, QUERIES[name](spark, SMALL), oracle.connect(SMALL), ORACLES[name]) == ""


# Context trees


def kt(zeros, ones):
    """By one symbol after the other."""
    p, seen = 1.0, [0, 0]
    for bit in [0] * zeros + [1] * ones:
        p *= (seen[bit] + 0.5) / (sum(seen) + 1)
        seen[bit] += 1
    return p


class PlainTrees:
    """The definition: weighted block probabilities, and a prediction as the quotient with the bit added."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children = depth, Counter(), defaultdict(set)
        for told in texts:
            for prefix, bit, context in self.bits(told):
                for size in range(depth + 1):
                    here = (prefix, context[depth - size :])
                    self.counts[here, bit] += 1
                    if size:
                        self.children[prefix, context[depth - size + 1 :]].add(here)

    def bits(self, told):
        data = b"\xfe" * self.depth + told + b"\xff"
        for at in range(self.depth, len(data)):
            for k in range(8):
                yield (k, data[at] >> (8 - k)), (data[at] >> (7 - k)) & 1, data[at - self.depth : at]

    def weighted(self, node, more=None):
        prefix, context = node
        extra = [0, 0]
        if more and (more[0], more[1][self.depth - len(context) :]) == (prefix, context):
            extra[more[2]] = 1
        own = kt(self.counts[node, 0] + extra[0], self.counts[node, 1] + extra[1])
        if len(context) == self.depth:
            return own
        below = set(self.children[node])
        if sum(extra):
            below.add((prefix, more[1][self.depth - len(context) - 1 :]))
        return 0.5 * own + 0.5 * math.prod(self.weighted(c, more) for c in below)

    def score(self, told):
        total = 0.0
        for prefix, bit, context in self.bits(told):
            root = (prefix, b"")
            total += math.log10(self.weighted(root, (prefix, context, bit)) / self.weighted(root))
        return total


def plain_base(rows, learn):
    words = Counter()
    for i, t in rows:
        if learn(i):
            words.update([*(t or "").encode().lower().split(), b" "])
    n, v = sum(words.values()), len(words)
    for _, t in rows:
        told = [*(t or "").encode().lower().split(), b" "]
        yield len(told), sum(w in words for w in told), n, sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in told)


def learnt(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 != 1


def test_log_gamma():
    import numpy as np

    x = np.array([0.5, 1.0, 1.5, 2.0, 7.5, 8.0, 100.5, 1e6])
    assert np.allclose(context_tree.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-10)


@pytest.mark.parametrize("depth", [3, 4])
def test_scores_are_those_of_the_definition(spark, monkeypatch, depth):
    monkeypatch.setattr(context_tree, "CHUNK_BYTES", 40)
    monkeypatch.setattr(context_tree, "BLOCK_BYTES", 7)
    monkeypatch.setattr(context_tree, "BLOCK_ROWS", 5)
    rows = [(k, t) for k, t in enumerate([None, "", "AbAb ab", "ab abc", "abé\tabé", "abcab" * 6, " ", "zz top", "ab ab", "abab", "Q"])]
    rows += [(3, "ab abc"), (3, "ab abc"), (None, "abc")]
    got = context_tree.score_texts(clashing(spark, rows).repartition(3), depth=depth).collect()
    trees = PlainTrees([(t or "").encode().lower() for i, t in rows if learnt(i)], depth)
    want = []
    for (i, t), (tokens, known, n, base) in zip(rows, plain_base(rows, learnt), strict=True):
        data = (t or "").encode().lower()
        want.append((repr(i), not learnt(i), len(data), tokens, known, n, base, trees.score(data)))
    mine = sorted(
        (repr(r["doc_id"]), r["held_out"], r["n_bytes"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got
    )
    assert len(mine) == len(want)
    for a, b in zip(mine, sorted(want), strict=True):
        assert a[:6] == b[:6] and a[6:] == pytest.approx(b[6:], rel=1e-9)
    for r in got:
        assert r["bits_per_byte"] == pytest.approx(-r["score"] * math.log2(10) / (r["n_bytes"] + 1))


def test_scores_without_anything_to_learn(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id int, text string")
    assert context_tree.score_texts(docs.limit(0)).count() == 0
    for r in context_tree.score_texts(docs, F.lit(False)).collect():
        assert (r["n_known"], r["train_tokens"], r["base_score"], r["held_out"]) == (0, 0, 0.0, True)
        assert r["bits_per_byte"] == pytest.approx(8.0)


def test_next_bytes_share_the_whole(spark):
    """The chances of all bytes after one context add up to one."""
    docs = spark.createDataFrame([(2, "the cat sat on the mat, the rat sat on the cat")], "doc_id int, text string")
    held = context_tree.Dictionary(5)
    held.add(docs.first()["text"].encode(), True)
    keys, counts, _, _ = held.close()
    context = int(keys[len(keys) // 2]) >> 8
    known = {int(k): int(n) for k, n in zip(keys, counts, strict=True)}
    grams = spark.createDataFrame([(g, known.get(g, 0)) for g in {*known, *((context << 8) | b for b in range(256))}], "gram bigint, n bigint")
    scored = {r["gram"]: r["score"] for r in context_tree.gram_scores(grams).collect()}
    assert math.fsum(10 ** scored[(context << 8) | b] for b in range(256)) == pytest.approx(1.0)


# Spelling variants


def plain_variants(rows, drop_every, least=6, often=5):
    counts = Counter()
    for i, t in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in word)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if drop_every and h % drop_every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= often}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [v for v in words if v != w and one_edit(v, w)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 5 * words[w]:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return out


@pytest.mark.parametrize("levels", [1, 8])
def test_spelling_variants(spark, monkeypatch, levels):
    monkeypatch.setattr(spelling, "LEVELS", levels)
    monkeypatch.setattr(spelling, "COUNTED", 50)
    draw = random.Random(7)
    stems = ["".join(draw.choice("abé") for _ in range(draw.randint(5, 9))) for _ in range(25)] + ["x" * 40, "letterless" * 6, "Çedillà"]
    stock = []
    for stem in stems:
        for _ in range(6):
            at = draw.randrange(len(stem))
            stock += [stem[:at] + stem[at + 1 :], stem[:at] + draw.choice("abÀ") + stem[at:], stem[:at] + draw.choice("ab") + stem[at + 1 :], stem]
    rows = [(k, " ".join(draw.choices(stock, k=60)) + draw.choice([".", " aab1aab ", "-"])) for k in range(60)]
    # a chain: each form five times as frequent as the one before
    rows += [(900, "chained " * 150 + "chainedl " * 30 + "chainedly " * 6)]
    rows += [(None, "Nobody nobody nobody NOBODY nobody nobodi " * 5), (901, None), (902, ""), (903, "shorty " * 5), (903, "shorty " * 5)]
    for drop in (None, 7):
        got = {tuple(r) for r in spelling.variants(clashing(spark, rows), drop_every=drop).collect()}
        want = plain_variants(rows, drop)
        assert got == want and any(w[1] for w in want) and any(w[1] and w[2] != w[1] for w in want)


def test_spelling_of_nothing(spark):
    docs = clashing(spark, [(1, None), (2, "short words only")])
    assert spelling.variants(docs).count() == 0 and spelling.variants(docs.limit(0)).count() == 0
