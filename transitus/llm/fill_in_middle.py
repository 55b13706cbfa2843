"""Fill-in-the-middle: texts cut in three at code points, read from a sparse index of their multibyte characters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitus.llm.common import no_text

# What marks prefix, suffix and middle in an output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORMED = "n bigint, form string, prefix_chars bigint, middle_chars bigint, prefix_bytes bigint, middle_bytes bigint, output string"


class Exceptions:
    """The multibyte characters of a UTF-8 text: where each starts and how many bytes beyond one it takes.

    Between them code points and bytes advance alike, so a cut is converted by looking up how many exceptions lie
    before it. Memory goes with the number of exceptions; the text of one byte a character has none.
    """

    def __init__(self, data: bytes) -> None:
        raw = np.frombuffer(data, dtype=np.uint8)
        self.starts = np.flatnonzero(raw >= 0xC0)
        lead = raw[self.starts]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.before = np.concatenate(([0], np.cumsum(excess)))
        self.points = self.starts - self.before[:-1]
        self.size = len(data)
        self.length = self.size - int(self.before[-1])

    def byte_of(self, points) -> np.ndarray:
        """Byte offsets of code point offsets from 0 to `length`."""
        points = np.asarray(points, dtype=np.int64)
        return points + self.before[np.searchsorted(self.points, points)]

    def point_of(self, offsets) -> np.ndarray:
        """Code point offsets of byte offsets that lie between characters."""
        offsets = np.asarray(offsets, dtype=np.int64)
        return offsets - self.before[np.searchsorted(self.starts, offsets)]


def formed(text: str | None, draws: tuple[int, int, int, int], plain: int, spm: int) -> tuple:
    """A row of `FORMED` for a text: two draws choose the cuts, one whether it stays plain, one its order."""
    text = text or ""
    data = text.encode()
    index = Exceptions(data)
    n = index.length
    if not data or draws[2] % 100 >= 100 - plain or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, None, None, text
    cuts = sorted(draw % (n + 1) for draw in draws[:2])
    first, second = index.byte_of(cuts).tolist()
    prefix, middle, suffix = (part.decode() for part in (data[:first], data[first:second], data[second:]))
    if draws[3] % 100 < spm:
        form, output = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    else:
        form, output = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return n, form, cuts[0], cuts[1] - cuts[0], first, second - first, output


def rebuilt(output: str | None, form: str | None) -> str | None:
    """The text that was made into `output`; no part holds a mark, so the first one of each kind is the border."""
    if output is None or form not in ("psm", "spm"):
        return output
    parted, middle = output.split(MIDDLE, 1)
    if form == "psm":
        prefix, suffix = parted[len(PREFIX) :].split(SUFFIX, 1)
    else:
        suffix, prefix = parted[len(SUFFIX) :].split(PREFIX, 1)
    return prefix + middle + suffix


def draws(doc_id: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the digest of seed and id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are ignored): doc_id and `FORMED`.

    `n` counts code points. `plain` per cent of the texts stay whole, as do empty ones (a null text is empty) and
    those that hold a mark; their cuts are null. Of the rest `spm` per cent get the order suffix, prefix, middle.
    The choice goes by seed and id alone, so repeated rows get equal results and rows of one id the same draws.
    Row by row: nothing is shuffled, and memory goes with a batch of texts.
    """

    @F.pandas_udf(FORMED)
    def form(texts: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        rows = [formed(t, tuple(map(int, h)), plain, spm) for t, *h in zip(texts, a, b, c, d, strict=True)]
        # nullable integers: plain texts have no cuts
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in FORMED.split(", ")], dtype=object)
        return out.astype({c: "Int64" for c in out.columns if c not in ("form", "output")})

    drawn = form(no_text("text"), *draws("doc_id", seed))
    return docs.select("doc_id", drawn.alias("_formed")).select("doc_id", "_formed.*")


def restore(output: Column, form: Column) -> Column:
    """The texts that `fill_in_middle` made into these outputs; a null output gives null."""

    @F.pandas_udf("string")
    def texts(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([rebuilt(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return texts(output, form)
