"""Phrases of a dictionary table found in texts by an automaton: a trie over words with failure links.

The dictionary is a table of any size. It is dealt into parts of bounded size; each part becomes an automaton, and one
pass over the texts carries up to `PARTS_AT_ONCE` of them. A dictionary of some hundred thousand words, all codes of
a clinical code system say, is found so. A larger one stays distributed: the texts' runs of words, of each length that
the dictionary has, are joined with it, so that neither the driver's work nor the passes over the texts grow with it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitus.functions.text import words
from transitus.session import stage

# A part has about so many words and characters at most: some 50 MB as an automaton.
PART_WORDS, PART_CHARS, PARTS_AT_ONCE = 200_000, 4_000_000, 4
# Words of a text that are sent to Python in one row; a longer text is cut, its pieces overlapping by a phrase.
SLICE = 1_024


class PhraseAutomaton:
    """Phrases of words parted by one space; `hits` finds all of them, nested and overlapping ones too."""

    def __init__(self, phrases: list[str]) -> None:
        self.phrases, self.sizes = phrases, [p.count(" ") + 1 for p in phrases]
        self.longest = max(self.sizes, default=0)
        self.codes: dict[str, int] = {}
        # a step from a node by a word, both in one number
        self.steps: dict[int, int] = {}
        self.ends, parents, labels = [-1], [0], [0]
        for number, phrase in enumerate(phrases):
            node = 0
            for word in phrase.split(" "):
                code = self.codes.setdefault(word, len(self.codes))
                step = node << 32 | code
                if step not in self.steps:
                    self.steps[step] = len(self.ends)
                    self.ends.append(-1)
                    parents.append(node)
                    labels.append(code)
                node = self.steps[step]
            self.ends[node] = number
        self._link(parents, labels)

    def _link(self, parents: list[int], labels: list[int]) -> None:
        """For each node the longest proper ending of its path that is a path, and the longest one that is a phrase."""
        count = len(self.ends)
        depth = [0] * count
        for node in range(1, count):  # a parent has a smaller number
            depth[node] = depth[parents[node]] + 1
        self.fail, self.shorter = [0] * count, [0] * count
        for node in sorted(range(1, count), key=depth.__getitem__):
            if depth[node] > 1:
                back = self.fail[parents[node]]
                while back and (back << 32 | labels[node]) not in self.steps:
                    back = self.fail[back]
                self.fail[node] = self.steps.get(back << 32 | labels[node], 0)
            back = self.fail[node]
            self.shorter[node] = back if self.ends[back] >= 0 else self.shorter[back]

    def hits(self, told: list[str], before: int) -> Iterator[str]:
        """The phrases that start at one of the first `before` words, one for each place."""
        node, steps, fail, ends, codes = 0, self.steps, self.fail, self.ends, self.codes
        if codes.keys().isdisjoint(told):
            return
        for at, word in enumerate(told):
            code = codes.get(word)
            if code is None:
                node = 0
                continue
            while node and (node << 32 | code) not in steps:
                node = fail[node]
            node = steps.get(node << 32 | code, 0)
            found = node if ends[node] >= 0 else self.shorter[node]
            while found:
                number = ends[found]
                if at - self.sizes[number] + 1 < before:
                    yield self.phrases[number]
                found = self.shorter[found]


def lots_of(dictionary: DataFrame, phrase: str) -> int:
    """Into how many parts of bounded size the distinct phrases go."""
    wanted = dictionary.select(F.col(phrase).alias("_p")).filter(F.col("_p") != "").distinct()
    size = F.size(F.split("_p", " "))
    sums = wanted.agg(F.coalesce(F.sum(size), F.lit(0)).alias("words"), F.coalesce(F.sum(F.length("_p")), F.lit(0)).alias("chars")).first()
    return max(-(-sums["words"] // PART_WORDS), -(-sums["chars"] // PART_CHARS))


def parts(dictionary: DataFrame, phrase: str, lots: int | None = None) -> Iterator[list[str]]:
    """Distinct phrases in lots of bounded size; the driver holds one lot at a time."""
    lots = lots_of(dictionary, phrase) if lots is None else lots
    wanted = dictionary.select(F.col(phrase).alias("_p")).filter(F.col("_p") != "").distinct()
    # lots by a hash are not quite even: half a lot more is still no error
    for lot in range(lots):
        rows = wanted.filter(F.pmod(F.xxhash64("_p"), F.lit(lots)) == lot).collect()
        if sum(len(r["_p"]) for r in rows) > 2 * PART_CHARS:
            raise ValueError("a phrase of the dictionary is longer than a part")
        yield sorted(r["_p"] for r in rows)


def _finder(spark, automata: list[PhraseAutomaton]):
    held = spark.sparkContext.broadcast(cloudpickle.dumps(automata))
    opened: list[PhraseAutomaton] = []

    @F.arrow_udf("array<string>")
    def find(told: pa.Array) -> pa.Array:
        if not opened:
            opened.extend(pickle.loads(held.value))
        texts = [t.split(" ") if t else [] for t in told.to_pylist()]
        return pa.array([[hit for a in opened for hit in a.hits(t, SLICE)] for t in texts], pa.list_(pa.string()))

    return find


def phrase_hits(
    texts: DataFrame, keys: list[str], tokens: str, table: DataFrame, phrase: str, longest: int | None = None, also: str | None = None
) -> DataFrame:
    """Rows of `table` whose phrase occurs in the token array of a text, one per place: phrase, `keys`, other columns.

    Phrases are words parted by one space; tokens have no spaces. `longest` leaves out phrases of more words. A null
    or empty array has no phrases, a null or empty phrase no places; a phrase that the table holds several times gives
    each of its rows. `also` names an array of further phrases that hold for a text, each a place more; it is not null.
    Texts are read once for a dictionary of up to `PARTS_AT_ONCE` parts, and once for a larger one, whose places are
    then found by a join (and once more for `also`).
    """
    spark = texts.sparkSession
    if longest is not None:
        table = table.filter(F.size(F.split(phrase, " ")) <= longest)
    # read for its size, its lots and the join
    table = stage(table, "phrases")
    lots = lots_of(table, phrase)
    if lots > PARTS_AT_ONCE:
        found = _runs_of_words(texts, keys, tokens, table, phrase)
        if also is not None:
            found = found.unionByName(texts.select(F.explode(also).alias(phrase), *keys))
        return found.join(table, phrase)
    automata = [PhraseAutomaton(phrases) for phrases in parts(table, phrase, lots)]
    reach = max((a.longest for a in automata), default=1)
    if also is None:
        pieces = texts.select(*keys, F.explode_outer(_pieces(tokens, reach)).alias("_piece"))
    else:
        pieces = texts.select(*keys, also, F.posexplode_outer(_pieces(tokens, reach)).alias("_at", "_piece"))
    places = _finder(spark, automata)(F.array_join("_piece", " "))
    if also is not None:
        places = F.concat(places, F.when(F.coalesce("_at", F.lit(0)) == 0, F.col(also)).otherwise(F.array().cast("array<string>")))
    return pieces.select(*keys, F.explode(places).alias(phrase)).join(table, phrase)


def _pieces(tokens: str, longest: int) -> Column:
    """The words of a text in pieces that overlap by a phrase of `longest` words; most texts are one piece."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1)), F.lit(SLICE))
    reach = F.lit(SLICE + longest - 1)
    cut = F.transform(starts, lambda at: F.slice(F.col(tokens), at, reach))
    return F.when(F.size(tokens) <= SLICE, F.array(F.col(tokens))).otherwise(cut)


def _runs_of_words(texts: DataFrame, keys: list[str], tokens: str, table: DataFrame, phrase: str) -> DataFrame:
    """(phrase, keys): one row for each place of a text and each number of words that a phrase of `table` has."""
    sizes = sorted(
        r[0] for r in table.filter(F.col(phrase) != "").select(F.size(F.split(phrase, " "))).distinct().collect()
    )
    size = F.explode(F.array(*[F.lit(n) for n in sizes])).alias("_size")
    # places that start in a piece's first words; those beyond belong to the next piece
    last = F.least(F.size("_piece") - F.col("_size") + 1, F.lit(SLICE))
    run = F.transform(F.sequence(F.lit(1), last), lambda at: F.array_join(F.slice("_piece", at, F.col("_size")), " "))
    pieces = texts.select(*keys, F.explode_outer(_pieces(tokens, sizes[-1])).alias("_piece")).select(*keys, "_piece", size)
    pieces = pieces.filter(F.size("_piece") >= F.col("_size"))
    return pieces.select(F.explode(run).alias(phrase), *keys)


def in_words(phrase: Column) -> Column:
    """A phrase as words parted by one space, in the form in which texts are cut."""
    return F.array_join(words(phrase), " ")
