"""Repeated strings of a fixed length, found from sampled positions whose ranks are refined at growing lengths.

A string of `length` symbols (bytes, words) that occurs twice holds, at the same place in both, a *mark*: the
smallest fingerprint among the grams of some stretch. So instead of every position only marks are ranked, about
two in each `length`. A *run* is a mark with an interval of offsets: the strings that start `lo` to `hi` symbols
before it. What all strings of a run share is its core, what they cover is its hull. A core that nothing else has
rules out the whole run; otherwise the interval is divided, and the cores of the parts, longer on both sides, are
ranked anew, until a run is unique or is one string of full length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitus.llm.common import maybe_broadcast, no_text, stage, text_key

U64 = np.uint64
RUN = "doc_id bigint, text_key bigint, mark int, lo int, start int, stop int, core bigint, hull bigint"
KEY = ["lo", "core"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(29))) * U64(0x9FB21C651E98DF25)
    return x ^ (x >> U64(32))


class Prints:
    """Fingerprints of runs of symbols from prefix sums of symbol x base^position, modulo 2^64."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(1, U64), np.ones(1, U64)

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(symbols):
            size = 2 * len(symbols) + 1
            with np.errstate(over="ignore"):
                ones = np.ones(1, U64)
                self.up = np.cumprod(np.concatenate((ones, np.full(size, self.base, U64))), dtype=U64)
                back = pow(self.base, -1, 1 << 64)
                self.down = np.cumprod(np.concatenate((ones, np.full(size, back, U64))), dtype=U64)
        sums = np.zeros(len(symbols) + 1, U64)
        np.cumsum(symbols * self.up[: len(symbols)], out=sums[1:])
        return sums

    def of(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((sums[stop] - sums[start]) * self.down[start])

    def grams(self, sums: np.ndarray, size: int) -> np.ndarray:
        count = len(sums) - size
        return _mixed((sums[size:] - sums[:-size]) * self.down[:count])


def marks(grams: np.ndarray, span: int) -> np.ndarray:
    """Places of the smallest, leftmost value of any `span` values in a row."""
    placed = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U64)
    width = 1
    while 2 * width <= span:
        placed = np.minimum(placed[:-width], placed[width:])
        width *= 2
    if width < span:
        placed = np.minimum(placed[: len(placed) + width - span], placed[span - width :])
    return np.unique(placed[np.concatenate(([True], placed[1:] != placed[:-1]))] & U64(0xFFFFFFFF)).astype(np.int64)


class Runs:
    """Marks and runs for repeated strings of `length` symbols with marks on grams of `gram` symbols."""

    def __init__(self, length: int, gram: int, symbols: Callable[[str], np.ndarray], parts: int = 8) -> None:
        self.length, self.gram, self.symbols, self.parts = length, gram, symbols, parts
        self.offsets = length - gram + 1
        self.widths = [self.offsets]
        while self.widths[-1] > 1:
            self.widths.append(-(-self.widths[-1] // parts))
        self.core, self.hull = Prints(0x9E3779B97F4A7C15), Prints(0xC2B2AE3D27D4EB4F)

    def _described(self, n: int, cores: np.ndarray, hulls: np.ndarray, mark: np.ndarray, lo: np.ndarray, width: int) -> dict:
        """Runs with at least one string inside the text. A hull cut off by the text's edge carries where."""
        hi = np.minimum(lo + width, self.offsets) - 1
        first, last = np.maximum(lo, mark + self.length - n), np.minimum(hi, mark)
        inside = first <= last
        mark, lo, hi, first, last = (x[inside] for x in (mark, lo, hi, first, last))
        start, stop = mark - last, mark - first + self.length
        cut = ((first - lo) * 4096 + (hi - last)).astype(U64)
        core = self.core.of(cores, mark - lo, mark - hi + self.length)
        hull = self.hull.of(hulls, start, stop) ^ _mixed(cut)
        return {"mark": mark, "lo": lo, "start": start, "stop": stop, "core": core.view(np.int64), "hull": hull.view(np.int64)}

    @staticmethod
    def _rows(batch: pd.DataFrame, found: list[tuple[int, dict]]) -> pd.DataFrame:
        """One frame for what was found in the texts of a batch, given by their places."""
        at = np.repeat([k for k, _ in found], [len(f["mark"]) for _, f in found])
        rows = {"doc_id": batch["doc_id"].astype("Int64").take(at).array, "text_key": batch["text_key"].to_numpy()[at]}
        return pd.DataFrame(rows | {name: np.concatenate([f[name] for _, f in found]) for name in found[0][1]})

    def _texts(self, texts: pd.Series) -> Iterator[tuple]:
        """Place, size and both prefix sums of the texts that are long enough."""
        for at, text in enumerate(texts):
            if len(text) * 4 >= self.length:
                symbols = self.symbols(text)
                if len(symbols) >= self.length:
                    yield at, len(symbols), self.core.prefix(symbols), self.hull.prefix(symbols)

    def first(self, docs: DataFrame) -> DataFrame:
        """All marks of all texts with their whole interval; one pass over the texts, which are not shuffled."""

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with np.errstate(over="ignore"):
                for batch in batches:
                    out = []
                    for at, size, cores, hulls in self._texts(batch["text"]):
                        mark = marks(self.core.grams(cores, self.gram), self.offsets)
                        lo = np.zeros(len(mark), np.int64)
                        out.append((at, self._described(size, cores, hulls, mark, lo, self.offsets)))
                    if out:
                        yield self._rows(batch, out)

        return keyed(docs).mapInPandas(scan, RUN)

    def divided(self, texts: DataFrame, runs: DataFrame, level: int) -> DataFrame:
        """The parts of `runs` (of interval width `widths[level - 1]`), described from the texts that hold them."""
        wider, width = self.widths[level - 1], self.widths[level]

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with np.errstate(over="ignore"):
                for batch in batches:
                    out, lists = [], batch["_runs"].to_numpy()
                    for at, size, cores, hulls in self._texts(batch["text"]):
                        pairs = np.array([(r["mark"], r["lo"]) for r in lists[at]], np.int64)
                        steps = np.arange(0, wider, width)
                        mark = np.repeat(pairs[:, 0], len(steps))
                        lo = (pairs[:, 1, None] + steps).ravel()
                        keep = lo < self.offsets
                        out.append((at, self._described(size, cores, hulls, mark[keep], lo[keep], width)))
                    if out:
                        yield self._rows(batch, out)

        return with_runs(texts, runs.select("doc_id", "text_key", F.struct("mark", "lo").alias("_run"))).mapInPandas(scan, RUN)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), no_text("text").alias("text"), text_key("text").alias("text_key"))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def with_runs(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """Texts (doc_id, text_key, text) with `_runs`, the list of the distinct `_run` of each; others are left out.

    The list is bounded by the length of the text.
    """
    lists = runs.groupBy("doc_id", "text_key").agg(F.collect_set("_run").alias("_runs"))
    return texts.join(lists, same_row(texts, lists)).select(texts["doc_id"], texts["text_key"], "text", "_runs")


def texts_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts that `rows` (a written table with doc_id, text_key) name; the list is broadcast if it is short."""
    wanted = maybe_broadcast(stage(rows.select("doc_id", "text_key").distinct(), "wanted"))
    texts = keyed(docs)
    return texts.join(wanted, same_row(texts, wanted), "left_semi")


def apply_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows of `docs` as doc_id, text_key, text with `spans`, a sorted list of (start, stop) from `spans`; may be null."""
    lists = spans.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    texts = keyed(docs)
    return texts.join(lists, same_row(texts, lists), "left").select(texts["doc_id"], texts["text_key"], "text", "spans")


def united(spans) -> list[list[int]]:
    """Overlapping or touching spans as one; `spans` is sorted."""
    out: list[list[int]] = []
    for span in spans if spans is not None else ():
        if out and span["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], span["stop"])
        else:
            out.append([span["start"], span["stop"]])
    return out
