"""Removal of word strings that an earlier document has, by matching statistics from suffix automata of shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitus.llm.automaton import SuffixAutomaton
from transitus.llm.common import discard, stage
from transitus.llm.runs import KEY, Runs, apply_spans, texts_of, united, with_runs

LENGTH, GRAM = 50, 20
# Distinct pieces around equal cores that one automaton takes; cores with more are divided first.
GROUP_PIECES = 500
# Pieces of one shard, on average.
SHARD_PIECES = 500
# The rank of a document without an id: later than any other.
LAST = (1 << 63) - 1
CUT = "doc_id bigint, text_key bigint, n_words bigint, n_removed bigint, kept string"


class _WordPrints(dict):
    """64-bit fingerprints of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class _Words:
    def __init__(self) -> None:
        self.seen = _WordPrints()

    def __call__(self, text: str) -> np.ndarray:
        told = text.encode().split()
        return np.fromiter(map(self.seen.__getitem__, told), np.uint64, len(told))


def earliest(pieces: list[tuple[int, bytes]], length: int) -> list[list[int]]:
    """For each (rank, words) and each string of `length` words in it the smallest rank of a piece that has it."""
    graph, ids = SuffixAutomaton(), {}
    told = [[ids.setdefault(w, len(ids)) for w in words.split()] for _, words in pieces]
    for symbols in told:
        graph.add(symbols)
    first = [LAST] * len(graph.length)
    for (rank, _), symbols in zip(pieces, told, strict=True):
        for state in graph.states_of(symbols):
            first[state] = min(first[state], rank)
    for state in graph.by_length():
        up = graph.link[state]
        first[up] = min(first[up], first[state])
    out = []
    for symbols in told:
        out.append([first[state] for state, run in graph.matches(symbols, length) if run >= length])
    return out


def _piece_ranks(finder: Runs, texts: DataFrame, pieces: DataFrame) -> DataFrame:
    """lo, core, hull, ranks: for the strings of each piece, in order, the earliest document that has them.

    Each shard holds all pieces of its cores. Strings that are equal have equal cores, so a piece meets all its
    equals in its shard: the shard's automaton is built from its pieces, and they stream through it.
    """
    shards = 1 + pieces.count() // SHARD_PIECES

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, runs in zip(batch["text"], batch["_runs"], strict=True):
                words = text.encode().split()
                rows += [(r["lo"], r["core"], r["hull"], r["rank"], b" ".join(words[r["start"] : r["stop"]])) for r in runs]
            yield pd.DataFrame(rows, columns=["lo", "core", "hull", "rank", "words"])

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        ranks = earliest(list(zip(rows["rank"], rows["words"], strict=True)), finder.length)
        return rows[["lo", "core", "hull"]].assign(ranks=ranks)

    told = pieces.select("_at.doc_id", "_at.text_key", F.struct("lo", "core", "hull", "rank", "_at.start", "_at.stop").alias("_run"))
    return (
        with_runs(texts, told).mapInPandas(read, "lo int, core bigint, hull bigint, rank bigint, words binary")
        # a text that is there twice tells its pieces twice
        .dropDuplicates(["lo", "core", "hull"])
        .groupBy(F.pmod(F.xxhash64(*KEY), F.lit(shards)).alias("_shard"))
        .applyInPandas(shard, "lo int, core bigint, hull bigint, ranks array<bigint>")
    )


def earlier_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """doc_id, text_key, start, stop (words): strings of `length` words that a document with a smaller doc_id has.

    Candidates are runs around marks whose core is in documents of two ids. Equal pieces are one, ranked by the
    smallest doc_id, and a later document with the same piece loses all of it. For the first document of a piece a
    core with one piece needs no search; one with up to `group_pieces` goes to a shard; beyond that the runs are
    divided, which makes cores longer, up to whole strings, where pieces are equal.
    """
    finder = Runs(length, gram, _Words())
    rank = F.coalesce("doc_id", F.lit(LAST))
    span = ["doc_id", "text_key", "start", "stop"]
    runs, found = stage(finder.first(docs), "marks"), []
    for level in range(len(finder.widths)):
        if level:
            if live.isEmpty():
                break
            texts = stage(texts_of(docs, live), "texts")
            runs = stage(finder.divided(texts, live, level), "runs")
            discard(live, texts)
        cores = stage(
            runs.groupBy(*KEY).agg(F.min(rank).alias("_a"), F.max(rank).alias("_b")).filter("_a < _b").select(*KEY), "cores"
        )
        shared = stage(runs.join(cores, KEY, "left_semi"), "shared")
        discard(runs, cores)
        pieces = stage(
            shared.groupBy(*KEY, "hull").agg(
                F.min(rank).alias("rank"), F.min_by(F.struct(*span), rank).alias("_at")
            ),
            "pieces",
        )
        sizes = stage(pieces.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_pieces")).filter("_pieces > 1"), "sizes")
        most = group_pieces if level + 1 < len(finder.widths) else LAST
        some, many = sizes.filter(F.col("_pieces") <= most).select(*KEY), sizes.filter(F.col("_pieces") > most).select(*KEY)
        # An earlier document with the same piece has all its strings: only the first one of each piece goes on.
        ranked = stage(
            shared.join(pieces.select(*KEY, "hull", F.col("rank").alias("_first")), [*KEY, "hull"]).withColumn("_rank", rank),
            "ranked",
        )
        discard(shared)
        found.append(stage(ranked.filter("_first < _rank").select(*span), "spans"))
        heads = ranked.filter("_first = _rank")
        searched = stage(pieces.join(some, KEY, "left_semi"), "searched")
        if not searched.isEmpty():
            texts = stage(texts_of(docs, searched.select("_at.*")), "texts")
            ranks = stage(_piece_ranks(finder, texts, searched), "piece_ranks")
            hit = heads.join(ranks, [*KEY, "hull"]).select(
                "doc_id", "text_key",
                F.explode(F.expr(
                    f"filter(transform(ranks, (r, i) -> if(r < _rank, struct(start + i AS start, start + i + {length} AS stop), null)),"
                    " s -> s is not null)"
                )).alias("_span"),
            )
            hit = hit.select("doc_id", "text_key", "_span.start", "_span.stop")
            found.append(stage(hit, "spans"))
            discard(texts, ranks)
        live = stage(heads.join(many, KEY, "left_semi").select("doc_id", "text_key", "mark", "lo"), "live")
        discard(ranked, pieces, sizes, searched)
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    return spans


def remove_earlier(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, text_key, n_words, n_removed, kept (words joined by a space).

    Words are what ASCII white space parts; a null text has none. Removed are the words of every string of
    `length` words that also starts in a document with a smaller doc_id, judged on the input. Documents that share
    an id do not remove from each other; one without an id counts as later than all others. Shorter texts lose
    nothing. An empty table gives an empty result; other columns are not looked at.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch["text"], batch["spans"], strict=True):
                words, kept, at = text.encode().split(), [], 0
                for start, stop in united(spans):
                    kept += words[at:start]
                    at = stop
                kept += words[at:]
                rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
            out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])
            yield pd.concat([batch[["doc_id", "text_key"]].reset_index(drop=True), out], axis=1)

    return apply_spans(docs, earlier_spans(docs, length, gram, group_pieces)).mapInPandas(cut, CUT)
