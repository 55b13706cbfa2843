"""Spelling variants: words one edit apart, found by a frontier of states that moves through a trie held as a table.

The trie is a table of edges (node, char, child) over all words, a node being a digest of the letters up to it. A
state is (word, position, node, edits). Where two words differ by one edit, they share what stands before it and what
follows. So there are two tries, one over the words and one over the words read backwards, and a state may leave its
own path only in the second half of its word: in one of the two tries the edit lies there. States without an edit
walk their own word's path. At each node a state may exchange its letter for another edge's, or leave its letter out;
an inserted letter is one left out in the other word. States with an edit follow the edges level by level, and those
that end where a word ends are neighbours. A word has at most (alphabet x length) states, whatever shares its nodes,
and no two words meet unless an edit leads from one to the other.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitus.llm.common import no_text, prepared, stage

# Fixed value: what a word is made of.
LETTERS = "[A-Za-zÀ-ÿ]+"
# Distinct words that a task counts before it hands them on, and rows of a Python batch that holds no texts.
COUNTED, ROWS = 400_000, 10_000
# Levels that the frontier walks one by one; what is longer still is looked up as a whole.
LEVELS = 8
MASK = (1 << 64) - 1
# The bit of a node at which a word ends; letters have bits 0 to 62.
END = 63


def vocabulary(docs: DataFrame, min_length: int = 6, min_count: int = 5, drop_every: int | None = None) -> DataFrame:
    """(word, n) of `docs` (doc_id, text): runs of letters, A-Z lower-cased, of so many code points and occurrences.

    With `drop_every` a run loses a letter where that divides h, the CRC-32 of `<doc_id>:<run>`: the one at h modulo
    its length. Runs are counted after that. Null texts have no words; a null doc_id counts as an empty one. Words
    are counted in each task first, `COUNTED` distinct ones at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, crc, found = re.compile(LETTERS), zlib.crc32, Counter()

        def rows() -> pa.RecordBatch:
            kept = [(w, n) for w, n in found.items() if len(w) >= min_length and n]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for batch in batches:
            for name, data in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                told = runs.findall(data.lower().decode())
                found.update(told)
                if drop_every:
                    start = crc(f"{name}:".encode())
                    for word in told:
                        drawn = crc(word.encode(), start)
                        if not drawn % drop_every:
                            at = drawn % len(word)
                            found[word] -= 1
                            found[word[:at] + word[at + 1 :]] += 1
                if len(found) >= COUNTED:
                    yield rows()
                    found.clear()
        yield rows()

    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), no_text("text").cast("binary").alias("text"))
    counted = named.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def _digest(node: int, letter: str) -> int:
    node = ((node ^ ord(letter)) * 0x9E3779B97F4A7C15) & MASK
    return node ^ (node >> 29)


def _bit(letter: str) -> int:
    return ord(letter) % END


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


PATH = "word string, spelled string, side int, at int, char string, node bigint, child bigint, follows bigint, half int"


def paths(words: DataFrame, least: int) -> DataFrame:
    """Each word's own path through the trie (`side` 0) and through that of the words read backwards (1).

    One row for each letter from number `least` on: the nodes before and after it, and as a set bit what comes next.
    `half` is the first position at which an edit belongs to this side.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PATH.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        out = []

        def rows() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for word in batch.column("word").to_pylist():
                size = len(word)
                for side, spelled in enumerate((word, word[::-1])):
                    node, half = side + 1, size - size // 2 if side else size // 2
                    for at, letter in enumerate(spelled):
                        child = _digest(node, letter)
                        if at >= least:
                            follows = _bit(spelled[at + 1]) if at + 1 < size else END
                            out.append((word, spelled, side, at, letter, _signed(node), _signed(child), _signed(1 << follows), half))
                        node = child
                        if len(out) >= ROWS:
                            yield rows()
                            out = []
        yield rows()

    return words.select("word").mapInArrow(walk, PATH)


def _letter(spelled: str, at) -> F.Column:
    return F.substring(F.col(spelled), at + 1, F.lit(1))


def neighbours(words: DataFrame, least: int) -> DataFrame:
    """(word, near): pairs of `words` (word, n) one inserted, deleted or replaced letter apart, each both ways.

    Words have at least 2 * `least` code points. The frontier is written after each level. Digests may only make
    nodes fall together, which adds states; pairs come out by a join with the word itself, so they are exact.
    """
    walked = stage(paths(words, least), "trie-paths")
    edges = stage(
        walked.groupBy("node", "char", "child").agg(F.bit_or("follows").alias("follows")), "trie-edges"
    )
    size, at = F.char_length("spelled"), F.col("at")
    own = walked.filter(at >= F.col("half")).select("spelled", "side", "at", "char", "node")

    def goes_on(follows: str):
        """Whether some word goes on from the node as the state's own word does."""
        code = F.ascii(_letter("spelled", at)) % F.lit(END)
        bit = F.when(at >= size, F.lit(END)).otherwise(code).cast("int")
        return F.bit_get(F.col(follows), bit) == 1

    # one of two letters exchanged: from the word with the smaller one
    other = edges.select(F.col("node").alias("_n"), F.col("char").alias("_char"), F.col("child").alias("_child"), F.col("follows").alias("_follows"))
    kept = F.substring("spelled", F.lit(1), at)
    rest = F.substring(F.col("spelled"), at + 2, size)
    exchanged = own.join(other, (F.col("node") == F.col("_n")) & (F.col("char") < F.col("_char"))).select(
        "spelled", "side", (at + 1).alias("at"), F.col("_child").alias("node"), F.concat(kept, F.col("_char"), rest).alias("target"), "_follows"
    ).filter(goes_on("_follows")).drop("_follows")
    # a letter left out; of equal letters in a row the last
    last = (at + 1 == size) | (F.col("char") != _letter("spelled", at + 1))
    without = own.filter(last).select("spelled", "side", (at + 1).alias("at"), "node", F.concat(kept, rest).alias("target"))
    states = stage(exchanged.unionByName(without), "trie-frontier-0")
    ended = []
    ahead = edges.select(F.col("node").alias("_n"), F.col("char").alias("_char"), F.col("child").alias("_child"), F.col("follows").alias("_follows"))
    for level in range(1, LEVELS + 1):
        ended.append(states.filter(at >= size))
        living = states.filter(at < size)
        if living.isEmpty():
            break
        states = stage(
            living.join(ahead, (F.col("node") == F.col("_n")) & (_letter("spelled", at) == F.col("_char")))
            .select("spelled", "side", (at + 1).alias("at"), F.col("_child").alias("node"), "target", "_follows")
            .filter(goes_on("_follows")).drop("_follows"),
            f"trie-frontier-{level}",
        )
    else:
        # what still has letters to go is in the table of words or not
        ended.append(states)
    found = ended[0]
    for more in ended[1:]:
        found = found.unionByName(more)
    forward = lambda c: F.when(F.col("side") == 0, F.col(c)).otherwise(F.reverse(c))
    pairs = found.select(forward("spelled").alias("word"), forward("target").alias("near")).distinct()
    real = stage(pairs.join(words.select(F.col("word").alias("near")), "near").select("word", "near"), "spelling-pairs")
    return real.unionByName(real.select(F.col("near").alias("word"), F.col("word").alias("near")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for `forms` (word, form): the end of the chain of forms, by doubling its steps.

    A form has several times the occurrences of its word, so chains have no rings and few links.
    """
    chain = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = chain.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        chain = stage(chain.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        if chain.filter("_moved").isEmpty():
            return chain.drop("_moved")
        chain = chain.drop("_moved")


def spelling_variants(words: DataFrame, least: int, times: int = 5) -> DataFrame:
    """One row per row of `words` (word, n; distinct): word, form, root, n, n_near, form_n.

    `n_near` counts the words one edit apart. `form` is the one of them with the largest n, the smallest in
    code-point order if several have it, if that is at least `times` n, else null. `root` is where the chain of forms
    ends, the word itself without a form. Words have at least 2 * `least` code points.
    """
    words = stage(words, "spelling-words")
    near = neighbours(words, least).join(words.select(F.col("word").alias("near"), F.col("n").alias("_n")), "near")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("_n")).alias("n"), "near")).alias("_best"))
    most = -F.col("_best.n")
    told = stage(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(most >= times * F.col("n"), F.col("_best.near")).alias("form"), F.when(most >= times * F.col("n"), most).alias("form_n"),
        ),
        "spelling-forms",
    )
    ends = roots(told.filter(F.col("form").isNotNull()))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, times: int = 5, drop_every: int | None = None) -> DataFrame:
    """`spelling_variants` of the `vocabulary` of `docs`; no row without words."""
    prepared(docs.sparkSession)
    found = stage(vocabulary(docs, min_length, min_count, drop_every), "spelling-vocabulary")
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    return spelling_variants(found, min_length // 2, times)
