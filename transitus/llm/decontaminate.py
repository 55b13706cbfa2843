"""Benchmark decontamination: documents streamed through a suffix automaton of the test items."""

from __future__ import annotations

import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from transitus.llm.automaton import SuffixAutomaton
from transitus.llm.common import Shipped, no_text

WINDOW = 13
# A document is contaminated when its hit words are at least one in so many of its words.
COVERAGE = 20
# Words of test items in one automaton; more items make more automata, each broadcast on its own.
AUTOMATON_WORDS = 1_000_000

# Bytes to words: A-Z become a-z; what is neither a letter, a digit nor above ASCII becomes a space.
_KEPT = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
FOLD = bytes((c + 32 if 0x41 <= c <= 0x5A else c if c in _KEPT else 0x20) for c in range(256))
SPANS = "array<struct<start:bigint,stop:bigint>>"
HITS = f"n_words bigint, spans {SPANS}, items array<string>"


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class ItemIndex:
    """Which items a run of words occurs in, for runs that are windows."""

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        self.window, self.ids, self.graph = window, {}, SuffixAutomaton()
        told = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words(text)]) for name, text in items]
        for _, symbols in told:
            self.graph.add(symbols)
        # by state: the items in which its runs end; short whole items as (words, item)
        ends, self.short = defaultdict(set), defaultdict(list)
        for name, symbols in told:
            if len(symbols) >= window:
                for state in self.graph.states_of(symbols):
                    ends[state].add(name)
            elif symbols:
                *_, state = self.graph.states_of(symbols)
                self.short[state].append((len(symbols), name))
        link, length = self.graph.link, self.graph.length
        for state in self.graph.by_length():
            if ends.get(state) and length[link[state]] >= window:
                ends[link[state]] |= ends[state]
        # only states that hold runs of exactly `window` words are asked
        self.ends = {s: frozenset(names) for s, names in ends.items() if length[link[s]] < window <= length[s]}
        self.below = [False] * len(length)  # whether a state or a suffix of it is a short item
        for state in reversed(self.graph.by_length()):
            self.below[state] = state in self.short or self.below[link[state]]

    def hits(self, text_words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of hit words, and the items with an occurring window."""
        link, length, below, window = self.graph.link, self.graph.length, self.below, self.window
        get = self.ids.get
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        symbols = [get(w, -1) for w in text_words]
        for at, (state, run) in enumerate(self.graph.matches(symbols, window), 1):
            if run < window and not below[state]:
                continue
            longest = 0
            if run >= window:
                if names := self.ends.get(state):
                    found |= names
                    longest = window
            while below[state]:
                for size, name in self.short.get(state, ()):
                    if size <= run:
                        found.add(name)
                        longest = max(longest, size)
                state = link[state]
                run = length[state]
            if longest:
                start = at - longest
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, at))
        return spans, found


def _item_shards(benchmark: DataFrame, most: int) -> list[list[tuple[str, str | None]]]:
    """Items dealt by hash into lists of about `most` words, each small enough for the driver and a broadcast."""
    said = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text"))
    size = said.agg(F.sum(F.octet_length(no_text("text")))).first()[0] or 0
    parts = 1 + size // (6 * most)
    dealt = lambda k: said.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
    return [[("" if r[0] is None else r[0], r[1]) for r in dealt(k).collect()] for k in range(parts)]


def item_hits(text: Column, benchmark: DataFrame, window: int = WINDOW, most: int = AUTOMATON_WORDS) -> Column:
    """For each text a struct of `HITS`: its words, the merged spans of hit words, the items with windows in it.

    A window is `window` consecutive words of an item, or the whole of a shorter item that has words. A null or
    empty text has no words; null or empty items have no window; a null item_id reads as an empty string, and rows
    that repeat an item_id are one item. The items are read here, automata of at most about `most` words are
    broadcast one by one; texts of any length are streamed word by word.
    """
    held = [Shipped(benchmark.sparkSession, ItemIndex(items, window)) for items in _item_shards(benchmark, most)]

    @F.pandas_udf(HITS)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for one in texts:
            told = words(one)
            spans, items = [], set()
            for index in held:
                more, names = index.get().hits(told)
                spans, items = spans + more, items | names
            if len(held) > 1:
                spans = merged(spans)
            rows.append((len(told), [{"start": a, "stop": b} for a, b in spans], sorted(items)))
        return pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return scan(text)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda total, s: total + s["stop"] - s["start"])


def contaminated(hits: Column, coverage: int = COVERAGE) -> Column:
    count = n_hit(hits["spans"])
    return (count > 0) & (count * coverage >= hits["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit, n_items, items, contaminated, spans (in words)."""
    scanned = docs.select("doc_id", item_hits(F.col("text"), benchmark, window).alias("_hits"))
    return scanned.select(
        "doc_id", F.col("_hits.n_words").alias("n_words"), n_hit(F.col("_hits.spans")).alias("n_hit"),
        F.size("_hits.items").cast("bigint").alias("n_items"), F.col("_hits.items").alias("items"),
        contaminated(F.col("_hits"), coverage).alias("contaminated"), F.col("_hits.spans").alias("spans"),
    )


@F.pandas_udf(StringType())
def cut_spans(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts without the words of the given spans and what lies between words of one span."""
    out = []
    for text, runs in zip(texts, spans, strict=True):
        if text is None or not len(runs):
            out.append(text)
            continue
        raw = text.encode()
        edges = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(FOLD))]
        kept, at = [], 0
        for run in runs:
            kept.append(raw[at : edges[run["start"]][0]])
            at = edges[run["stop"] - 1][1]
        out.append(b"".join([*kept, raw[at:]]).decode())
    return pd.Series(out, dtype=object)


def items_digest(items: Column) -> Column:
    """Lower-case hex SHA-256 of the sorted item ids, comma-joined."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)
