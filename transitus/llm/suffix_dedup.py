"""Removal of repeated byte strings: ranks of sampled positions, refined at growing lengths until unique or long enough."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitus.llm.common import discard, stage
from transitus.llm.runs import KEY, Runs, apply_spans, same_row, texts_of, united

LENGTH, GRAM = 400, 160
CUT = "doc_id bigint, text_key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
_LETTERS = np.random.default_rng(7).integers(0, 1 << 63, 256, np.int64).astype(np.uint64)


def _bytes(text: str) -> np.ndarray:
    return _LETTERS[np.frombuffer(text.encode(), np.uint8)]


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, text_key, start, stop: spans of `docs` covered by strings of `length` bytes that occur elsewhere too.

    Each round ranks the cores of all live runs (counts by core), drops those that are unique, and settles those
    whose whole hull occurs twice. The others are divided, with one settled run for each hull as a witness, so
    that what remains finds its equal. After the last round cores are the strings themselves. Equality is that
    of two 64-bit fingerprints.
    """
    finder = Runs(length, gram, _bytes)
    runs, found, texts = stage(finder.first(docs), "marks"), [], None
    for level in range(len(finder.widths)):
        if level:
            if live.isEmpty():
                break
            texts = texts if texts is not None else stage(texts_of(docs, live), "texts")
            runs = stage(finder.divided(texts, live, level), "runs")
            discard(live)
        ranks = stage(runs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*KEY), "ranks")
        shared = stage(runs.join(ranks, KEY, "left_semi"), "shared")
        discard(runs, ranks)
        hulls = stage(
            shared.groupBy(*KEY, "hull").agg(
                F.count(F.lit(1)).alias("_n"), F.min(F.struct("doc_id", "text_key", "mark")).alias("_first")
            ).filter("_n > 1"),
            "hulls",
        )
        sorted_out = stage(
            shared.join(hulls.select(*KEY, "hull", F.lit(True).alias("_settled")), [*KEY, "hull"], "left"), "sorted_out"
        )
        discard(shared)
        found.append(stage(sorted_out.filter("_settled").select("doc_id", "text_key", "start", "stop"), "spans"))
        if level + 1 < len(finder.widths):
            loose = sorted_out.filter("_settled is null")
            near = loose.select(*KEY).distinct()
            witness = hulls.join(near, KEY, "left_semi").select("_first.*", "lo")
            live = stage(loose.select("doc_id", "text_key", "mark", "lo").unionByName(witness), "live")
        discard(sorted_out, hulls)
    if texts is not None:
        discard(texts)
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    return spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, text_key, n_bytes, n_removed, n_spans, kept (bytes).

    Texts are UTF-8 bytes, a null text is empty; all bytes are removed that lie in a string of `length` bytes that
    also starts anywhere else, in the same document or another. What is repeated is judged on the input. Shorter
    texts lose nothing. Rows with equal id and text count as two documents; a null doc_id is a document like any
    other. An empty table gives an empty result; other columns are not looked at.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch["text"], batch["spans"], strict=True):
                raw, kept, at = text.encode(), [], 0
                gone = united(spans)
                for start, stop in gone:
                    kept.append(raw[at:start])
                    at = stop
                rest = b"".join([*kept, raw[at:]])
                rows.append((len(raw), len(raw) - len(rest), len(gone), rest))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])
            yield pd.concat([batch[["doc_id", "text_key"]].reset_index(drop=True), out], axis=1)

    return apply_spans(docs, repeated_spans(docs, length, gram)).mapInPandas(cut, CUT)
