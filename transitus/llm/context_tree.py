"""Language-model scores by context-tree weighting over the bytes of texts.

Each byte is eight binary decisions; every decision has a tree of contexts of its own, whose nodes are the 0 to
`depth` bytes before. A node estimates its bit by Krichevsky and Trofimov, and the tree weighs the estimates of all
depths: a node's block probability is half its own estimate's and half the product of its children's. As the
estimator depends on counts only, the weights follow from counts of byte strings, and the probability of a byte is
the mixture along its contexts.

A string of `depth` + 1 bytes is one 64-bit number, a *gram*: the context with its latest byte first, then the byte
itself. Sorted, the grams of a context lie together at every depth.

The corpus is written once, cut into *chunks* of about 32 MB with the distinct grams and words of each. Corpus counts
are sums over chunks; the model gives one score to every distinct gram of the corpus, trees divided by the three
latest bytes of the context; and the scores return to the chunks that asked, where the texts are added up. Nothing
that grows with the corpus is broadcast or collected: only the contexts of no and of one byte are (65,535 nodes at
most).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitus.llm.common import no_text, prepared, stage

DEPTH = 5
CHUNK_BYTES = 32 << 20
# Bytes that are counted at once, and rows of the model worked on at once: both bound the memory of a task.
BLOCK_BYTES, BLOCK_ROWS, OUT_ROWS = 1 << 20, 250_000, 1 << 16
# No UTF-8 text has these bytes: before a text and after it. The end is scored as a symbol.
PAD, END = b"\xfe", b"\xff"
# No word is a space: the end of a text, counted as a token.
END_TOKEN = b" "
U64 = np.uint64


# Grams --------------------------------------------------------------------------------------------------------


def grams(told: bytes, depth: int) -> np.ndarray:
    """The gram of each byte of `told` from number `depth` on, padding included."""
    count = len(told) - depth
    if count <= 0:
        return np.zeros(0, U64)
    room = told + bytes(8)
    # eight bytes from each place on as one number, the first byte lowest: the latest context byte comes highest
    wide = np.ndarray((count,), "<u8", room, strides=(1,))
    context = wide & U64((1 << 8 * depth) - 1)
    return (context << U64(8)) | ((wide >> U64(8 * depth)) & U64(255))


def framed(data: bytes, depth: int) -> bytes:
    return PAD * depth + data + END


def blocks(texts: Iterable[bytes], depth: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams of framed texts with the number of their text, in blocks of about `BLOCK_BYTES` and at most `most` texts."""
    told, owners, size = [], [], 0
    for number, data in enumerate(texts):
        whole = framed(data, depth)
        for start in range(0, max(1, len(whole) - depth), BLOCK_BYTES):
            piece = whole[start : start + BLOCK_BYTES + depth]
            told.append(piece)
            owners.append((number, len(piece)))
            size += len(piece)
            if size >= BLOCK_BYTES or len(told) >= most:
                yield _block(told, owners, depth)
                told, owners, size = [], [], 0
    if told:
        yield _block(told, owners, depth)


def _block(told: list[bytes], owners: list[tuple[int, int]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    found = grams(b"".join(told), depth)
    owner = np.repeat(*np.array(owners).T)[depth:]
    # the first bytes of a piece are context only: where it follows another, its first places reach across
    starts = np.cumsum([0] + [size for _, size in owners[:-1]])
    own = np.ones(len(found), dtype=bool)
    for start in starts[1:]:
        own[start - depth : start] = False
    return found[own], owner[own]


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and where their runs start."""
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
    return ordered[first], first


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of (keys, counts) with their summed counts, sorted."""
    if not parts:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    found, first = runs(keys[order])
    return found, np.add.reduceat(counts[order], first) if len(found) else counts


class Dictionary:
    """Distinct grams and words of a chunk with their counts in the texts to learn from (0: only in others)."""

    def __init__(self, depth: int) -> None:
        self.depth, self.held, self.size = depth, {True: [], False: []}, {True: 0, False: 0}
        self.parts, self.rows = [], 0
        self.words, self.others = Counter(), set()

    def add(self, data: bytes, learn: bool) -> None:
        tokens = [*data.split(), END_TOKEN]
        if learn:
            self.words.update(tokens)
        else:
            self.others.update(tokens)
        self.held[learn].append(data)
        self.size[learn] += len(data)
        if self.size[learn] >= BLOCK_BYTES:
            self._count(learn)

    def _count(self, learn: bool) -> None:
        for found, _ in blocks(self.held[learn], self.depth, 1 << 30):
            found.sort()
            keys, first = runs(found)
            counts = np.diff(np.append(first, len(found)))
            self.parts.append((keys, counts if learn else np.zeros_like(counts)))
            self.rows += len(keys)
        self.held[learn], self.size[learn] = [], 0
        if self.rows > 8 * BLOCK_ROWS:
            self.parts = [merged(self.parts)]
            self.rows = 0

    def close(self) -> tuple[np.ndarray, np.ndarray, list[bytes], list[int]]:
        for learn in (True, False):
            self._count(learn)
        keys, counts = merged(self.parts)
        others = [w for w in self.others if w not in self.words]
        return keys, counts, [*self.words, *others], [*self.words.values(), *[0] * len(others)]


def _chunks(docs: DataFrame, depth: int) -> DataFrame:
    """`docs` (doc_id, learn, text) with their chunk, and as further rows the chunk's grams and words with counts.

    Texts are lower-cased and compressed: they are written once and shuffled once.
    """
    fields = [
        T.StructField("chunk", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("learn", T.BooleanType()),
        T.StructField("text", T.BinaryType()), T.StructField("gram", T.LongType()), T.StructField("word", T.BinaryType()),
        T.StructField("n", T.LongType()),
    ]
    names = [f.name for f in fields]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 24, Dictionary(depth), 0
        kinds = {"chunk": pa.int64(), "learn": pa.bool_(), "text": pa.binary(), "gram": pa.int64(), "word": pa.binary(), "n": pa.int64()}

        def rows(count: int, **columns) -> pa.RecordBatch:
            columns["chunk"] = pa.repeat(pa.scalar(number, pa.int64()), count)
            return pa.RecordBatch.from_arrays(
                [columns[n] if n in columns else pa.nulls(count, kinds[n]) for n in names], names=names
            )

        def close() -> Iterator[pa.RecordBatch]:
            keys, counts, words, times = held.close()
            for at in range(0, len(keys), OUT_ROWS):
                part = slice(at, at + OUT_ROWS)
                yield rows(len(keys[part]), gram=pa.array(keys[part].astype(np.int64)), n=pa.array(counts[part], pa.int64()))
            for at in range(0, len(words), OUT_ROWS):
                part = slice(at, at + OUT_ROWS)
                yield rows(len(words[part]), word=pa.array(words[part], pa.binary()), n=pa.array(times[part], pa.int64()))

        for batch in batches:
            kinds["doc_id"] = batch.schema.field("doc_id").type
            start, learns = 0, batch.column("learn").to_pylist()
            texts = [t.lower() for t in batch.column("text").to_pylist()]
            for at, (data, learn) in enumerate(zip(texts, learns, strict=True)):
                held.add(data, learn)
                size += len(data)
                if size < CHUNK_BYTES and at + 1 < len(texts):
                    continue
                part = batch.slice(start, at + 1 - start)
                yield rows(part.num_rows, doc_id=part.column("doc_id"), learn=part.column("learn"), text=pa.array([zlib.compress(t, 1) for t in texts[start : at + 1]], pa.binary()))
                start = at + 1
                if size >= CHUNK_BYTES:
                    yield from close()
                    number, held, size = number + 1, Dictionary(depth), 0
        if size or held.words or held.others:
            yield from close()

    return docs.mapInArrow(cut, T.StructType(fields))


# The model ----------------------------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0: raised to 8 or more, then Stirling's series."""
    x = np.array(x, dtype=np.float64)
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift[low] -= np.log(x[low])
        x[low] += 1
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * x * x)) / (x * x)) / (x * x)) / x
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series


def log_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def mixed(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Logarithm of half of each."""
    return np.logaddexp(own, children) - math.log(2)


class Level:
    """The nodes of one depth: for each of the eight bits the runs of equal (context, bits before)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts, self.nodes, self.firsts, self.zeros, self.ones, self.weight = keys, counts, [], [], [], [], []
        for bit in range(8):
            prefix, first = runs(keys >> U64(8 - bit))
            node = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
            one = ((keys >> U64(7 - bit)) & U64(1)).astype(bool)
            total = np.add.reduceat(counts, first)
            ones = np.add.reduceat(np.where(one, counts, 0), first)
            self.nodes.append(node)
            self.firsts.append(first)
            self.zeros.append(total - ones)
            self.ones.append(ones)

    def estimate(self, bit: int) -> np.ndarray:
        """For each row its own bit's estimate."""
        node = self.nodes[bit]
        one = ((self.keys >> U64(7 - bit)) & U64(1)).astype(bool)
        zeros, ones = self.zeros[bit][node], self.ones[bit][node]
        return (np.where(one, ones, zeros) + 0.5) / (zeros + ones + 1.0)


class Trees:
    """Context trees of sorted grams from `depth` up to contexts of `top` bytes; all grams of such a context are there."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, top: int) -> None:
        level = Level(keys, counts.astype(np.float64))
        self.levels, self.up = [level], []
        logs = [log_block(z, o) for z, o in zip(level.zeros, level.ones, strict=True)]
        for size in range(depth - 1, top - 1, -1):
            drop = U64(8 * (depth - size) + 8)
            below = level
            # the byte and the latest bytes of its context
            shorter = ((below.keys >> drop) << drop) | (below.keys & U64(255))
            found, up = np.unique(shorter, return_inverse=True)
            level = Level(found, np.bincount(up, below.counts, len(found)))
            for bit in range(8):
                parent = level.nodes[bit][up[below.firsts[bit]]]
                own = log_block(level.zeros[bit], level.ones[bit])
                both = mixed(own, np.bincount(parent, logs[bit], len(own)))
                level.weight.append(np.exp(own - math.log(2) - both))
                logs[bit] = both
            self.levels.append(level)
            self.up.append(up)
        self.logs = logs

    def tops(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Of the nodes at `top`: the key of their context, their bits before, zeros, ones and log probability."""
        level = self.levels[-1]
        for bit in range(8):
            rows = level.keys[level.firsts[bit]]
            yield rows, (1 << bit) | ((rows & U64(255)) >> U64(8 - bit)).astype(np.int64), level.zeros[bit], level.ones[bit], self.logs[bit]

    def chances(self, bit: int) -> np.ndarray:
        """Probability of each gram's bit given its context, mixed over the depths from `top` on."""
        chance = self.levels[0].estimate(bit)
        at = np.arange(len(chance))
        for level, up in zip(self.levels[1:], self.up, strict=True):
            at = up[at]
            weight = level.weight[bit][level.nodes[bit]][at]
            chance = weight * level.estimate(bit)[at] + (1 - weight) * chance
        return chance


def whole_contexts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Sorted rows in tables that end with a value of `column`."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < BLOCK_ROWS:
            continue
        table = pa.Table.from_batches(held)
        values = table.column(column).to_numpy()
        cut = int(np.searchsorted(values, values[-1]))
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        rows = table.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held)


# Trees meet in contexts of this many bytes; shorter ones are joined as tables.
TOP = 3
NODE = "context bigint, node int, zeros double, ones double, log double"


def _deep(rows: DataFrame, depth: int) -> DataFrame:
    """`NODE` of the contexts of `TOP` bytes, from `rows` (context, gram, n)."""

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_contexts(batches, "context"):
            keys = table.column("gram").to_numpy().astype(U64)
            for row, node, zeros, ones, log in Trees(keys, table.column("n").to_numpy(), depth, TOP).tops():
                context = (row >> U64(8 * (depth - TOP) + 8)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(context), pa.array(node, pa.int32()), pa.array(zeros), pa.array(ones), pa.array(log)],
                    names=["context", "node", "zeros", "ones", "log"],
                )

    return rows.repartition("context").sortWithinPartitions("context", "gram").mapInArrow(climb, NODE)


def _parents(nodes: DataFrame) -> DataFrame:
    """The nodes of contexts shorter by a byte, each with `weight`, the share of its own estimate."""

    @F.pandas_udf("double")
    def _log_block(zeros: pd.Series, ones: pd.Series) -> pd.Series:
        return pd.Series(log_block(zeros.to_numpy(np.float64), ones.to_numpy(np.float64)))

    summed = nodes.groupBy(F.shiftright("context", 8).alias("context"), "node").agg(
        *[F.sum(c).alias(c) for c in ("zeros", "ones", "log")]
    )
    own = summed.withColumn("_own", _log_block("zeros", "ones"))
    highest = F.greatest("_own", "log")
    both = highest + F.log(F.exp(F.col("_own") - highest) + F.exp(F.col("log") - highest)) - math.log(2)
    return own.withColumn("log", both).select(
        "context", "node", "zeros", "ones", "log", F.exp(F.col("_own") - math.log(2) - F.col("log")).alias("weight")
    )


def _shallow(deep: DataFrame) -> DataFrame:
    """For each node of `deep` what contexts of 0, 1 and 2 bytes give a zero and a one, and the share they leave."""
    levels = []
    for size in (2, 1, 0):
        levels.append(stage(_parents(levels[-1] if levels else deep), f"ctw-nodes-{size}"))
    rows = deep.select("context", "node")
    zero, one, rest = F.lit(0.0), F.lit(0.0), F.lit(1.0)
    for size, level in zip((0, 1, 2), reversed(levels), strict=True):
        given = level.select(
            F.col("context").alias("_c"), F.col("node").alias("_n"), F.col("weight").alias(f"_w{size}"),
            ((F.col("zeros") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)).alias(f"_z{size}"),
        )
        # at most 255 and 65,280 rows; contexts of two bytes are shuffled
        given = F.broadcast(given) if size < 2 else given
        rows = rows.join(given, (F.shiftright("context", 8 * (TOP - size)) == F.col("_c")) & (F.col("node") == F.col("_n"))).drop("_c", "_n")
        share = rest * F.col(f"_w{size}")
        zero, one = zero + share * F.col(f"_z{size}"), one + share * (1 - F.col(f"_z{size}"))
        rest = rest * (1 - F.col(f"_w{size}"))
    return rows.select("context", "node", zero.alias("zero"), one.alias("one"), rest.alias("rest"))


def gram_scores(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, score): log10 of the probability of each gram's byte after its context, from `counts` (gram, n).

    Grams with n = 0 were only asked for. Trees are divided by the `TOP` latest bytes of the context. A division has
    at most 256 ** (`depth` - `TOP` + 1) grams (16.8 million at depth 5) and is worked on by one task.
    """
    rows = counts.select(F.shiftright("gram", 8 * (depth - TOP) + 8).alias("context"), "gram", "n")
    shallow = _shallow(stage(_deep(rows, depth), "ctw-deep"))
    nothing = [F.lit(None).cast("double").alias(c) for c in ("zero", "one", "rest")]
    both = rows.select("context", F.lit(1).alias("kind"), "gram", "n", *nothing).unionByName(
        shallow.select("context", F.lit(0).alias("kind"), F.col("node").cast("bigint").alias("gram"), F.lit(0).cast("bigint").alias("n"), "zero", "one", "rest")
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_contexts(batches, "context"):
            above = table.column("kind").to_numpy() == 0
            context, gram = table.column("context").to_numpy(), table.column("gram").to_numpy()
            places = (context[above] << 8) | gram[above]
            zero, one, rest = (table.column(c).to_numpy()[above] for c in ("zero", "one", "rest"))
            own, keys = context[~above], gram[~above].astype(U64)
            trees = Trees(keys, table.column("n").to_numpy()[~above], depth, TOP)
            total = np.zeros(len(keys))
            for bit in range(8):
                at = np.searchsorted(places, (own << 8) | (1 << bit) | ((keys & U64(255)) >> U64(8 - bit)).astype(np.int64))
                first = np.where((keys >> U64(7 - bit)) & U64(1), one[at], zero[at])
                total += np.log10(first + rest[at] * trees.chances(bit))
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(total)], names=["gram", "score"])

    return both.repartition("context").sortWithinPartitions("context", "kind", "gram").mapInArrow(score, "gram bigint, score double")


# Scores of texts ----------------------------------------------------------------------------------------------

SCORED = (
    "n_bytes bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"
)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def _many_rows(spark, rows: int) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def score_texts(docs: DataFrame, learn: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are ignored): doc_id, held_out and `SCORED`.

    The model learns the bytes of the rows for which `learn` holds (by default those not `held_out`; null counts as
    false) and scores all: `score` is the log10 probability of the text, with A-Z lower-cased, and its end;
    `bits_per_byte` is its code length. `base_score` is the log10 probability of its words and end by their counts
    in the rows learnt from, with half a count added for each word and for unknown ones. Null texts are empty: their
    end alone is scored. With nothing to learn from each bit counts one, and `base_score` is that of zero counts.
    Repeated rows are counted and scored each for itself; a null doc_id is learnt from. Texts may be of any length:
    they are counted in blocks, and a text above `CHUNK_BYTES` is a chunk of its own. `depth` is from 3 to 6.
    """
    if not TOP <= depth <= 6:
        raise ValueError("depth must be from 3 to 6")
    spark = prepared(docs.sparkSession)
    learn = ~held_out() if learn is None else F.coalesce(learn, F.lit(False))
    cut = stage(_chunks(docs.select("doc_id", learn.alias("learn"), no_text("text").cast("binary").alias("text")), depth), "ctw-chunks")
    _many_rows(spark, OUT_ROWS)

    of_word = Window.partitionBy("word").orderBy("chunk")
    words = stage(
        cut.filter(F.col("word").isNotNull()).select(
            "chunk", "word", F.sum("n").over(Window.partitionBy("word")).alias("c"), (F.row_number().over(of_word) == 1).alias("first")
        ).filter("c > 0"),
        "ctw-words",
    )
    sums = words.filter("first").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = int(sums["n"]), int(sums["v"])
    asked = cut.filter(F.col("gram").isNotNull()).select("chunk", "gram", "n")
    counts = stage(asked.groupBy("gram").agg(F.sum("n").alias("n")), "ctw-grams")
    scores = stage(gram_scores(counts, depth), "ctw-scores")
    facts = asked.join(scores, "gram").select("chunk", "gram", F.lit(None).cast("binary").alias("word"), F.col("score").alias("value")).unionByName(
        words.select("chunk", F.lit(None).cast("bigint").alias("gram"), "word", F.col("c").cast("double").alias("value"))
    )
    # read anew: Spark does not group two sides that come from one reading
    again = spark.read.schema(cut.schema).parquet(cut.written_to)
    texts = again.filter(F.col("text").isNotNull()).select("chunk", "doc_id", "learn", "text")
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType())]
    kinds = [f.split() for f in SCORED.split(", ")]
    fields += [T.StructField(name, T.LongType() if kind == "bigint" else T.DoubleType()) for name, kind in kinds]
    below = n + 0.5 * (v + 1)

    def add_up(rows: pa.Table, known: pa.Table) -> pa.Table:
        named = known.column("word").is_valid()
        listed = known.filter(named)
        # most words have one of few counts, whose logarithms are held once
        logs = {c: math.log10((c + 0.5) / below) for c in pc.unique(listed.column("value")).to_pylist()}
        base = {w.as_py(): logs[c] for w, c in zip(listed.column("word"), listed.column("value").to_pylist(), strict=True)}
        known = known.filter(known.column("gram").is_valid())
        order = np.argsort(known.column("gram").to_numpy())
        keys, values = known.column("gram").to_numpy()[order].astype(U64), known.column("value").to_numpy()[order]
        unknown, out = math.log10(0.5 / below), []

        def texts() -> Iterator[bytes]:
            for packed in rows.column("text"):
                data = zlib.decompress(packed.as_py())
                tokens = [*data.split(), END_TOKEN]
                found = [base[t] for t in tokens if t in base]
                plain = math.fsum(found) + (len(tokens) - len(found)) * unknown
                out.append((len(data), len(tokens), len(found), n, plain))
                yield data

        score = np.zeros(rows.num_rows)
        room = U64(64 - 8 * (depth + 1))
        for found, owner in blocks(texts(), depth, (1 << int(room)) - 1):
            # gram and place of its text in the block as one number: sorted, each distinct gram is looked up once
            first = owner[0]
            both = (found << room) | (owner - first).astype(U64)
            both.sort()
            distinct, starts = runs(both >> room)
            value = np.repeat(values[np.searchsorted(keys, distinct)], np.diff(np.append(starts, len(both))))
            part = np.bincount((both & ((U64(1) << room) - U64(1))).astype(np.int64), value)
            score[first : first + len(part)] += part
        out = [(*row, total, -total * math.log2(10) / (row[0] + 1)) for row, total in zip(out, score.tolist(), strict=True)]
        columns = [pa.array(c) for c in zip(*out, strict=True)]
        held = pc.invert(rows.column("learn"))
        return pa.table([rows.column("doc_id"), held, *columns], names=[f.name for f in fields])

    return texts.groupBy("chunk").cogroup(facts.groupBy("chunk")).applyInArrow(add_up, T.StructType(fields))
