"""Near duplicates: an LSH forest over MinHash signatures proposes pairs, full shingle sets confirm them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitus.llm.common import BATCH_ROWS, maybe_broadcast, stage
from transitus.llm.graph import components
from transitus.llm.runs import Prints, keyed, same_row, texts_of

# Shingles of one side of a block of documents that are compared with each other.
BLOCK_SHINGLES = 2_000_000
SKETCH = "doc_id bigint, text_key bigint, n_shingles bigint, node bigint, signature binary, sketch binary"


@dataclass(frozen=True)
class Forest:
    """Shingles of `shingle` words, linked at a similarity of percent / 100 or more.

    `trees` sorted orders of `depth` minima each. Regions are runs of equal prefixes: `start` minima long, and
    longer, up to `depth`, as long as more than `region` documents share one. A pair of similarity s meets in a
    region with probability 1 - (1 - s^start)^trees, 0.99999 for 0.8. Where regions are full the prefix is longer,
    and nearer documents meet; the nodes of full regions are therefore placed in `further` orders as well. Pairs are
    confirmed if their sketches (one byte of each minimum) agree nearly as much as linked documents do; `sigmas`
    standard deviations are allowed for.

    A linked pair is thus missed with a probability of at most (1 - s^start)^trees + (1 - s^depth)^(trees + further)
    + P(a sketch disagrees): 1.0e-5 + 9.6e-6 + 8.3e-6 at 0.8, 2.4e-7 + 1.6e-7 + 5.9e-6 at 0.85. The middle term is for
    pairs of crowded regions only.
    """

    shingle: int = 5
    percent: int = 80
    trees: int = 16
    depth: int = 6
    start: int = 3
    region: int = 2_000
    sigmas: float = 4.5

    @property
    def minima(self) -> int:
        return self.trees * self.depth

    @property
    def further(self) -> int:
        """Orders of `depth` minima that, with the first `trees`, miss a pair as rarely as `trees` of `start` minima do."""
        if self.percent >= 100:
            return 0
        miss = lambda minima: math.log1p(-((self.percent / 100) ** minima))
        return max(0, math.ceil(self.trees * miss(self.start) / miss(self.depth)) - self.trees)

    @property
    def agreeing(self) -> int:
        """Bytes of two sketches that must agree."""
        share = self.percent / 100
        return max(1, math.floor(self.minima * share - self.sigmas * math.sqrt(self.minima * share * (1 - share))))


class Shingles:
    def __init__(self, size: int) -> None:
        self.size, self.prints, self.words = size, Prints(0x9E3779B97F4A7C15), {}

    def _word(self, word: bytes) -> int:
        value = self.words.get(word)
        if value is None:
            if len(self.words) >= 500_000:
                self.words.clear()
            value = self.words[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def __call__(self, text: str) -> np.ndarray:
        """Sorted fingerprints of the distinct shingles: A-Z lower-cased, words parted by ASCII white space."""
        told = text.encode().lower().split()
        if not told:
            return np.zeros(0, np.uint64)
        symbols = np.fromiter(map(self._word, told), np.uint64, len(told))
        with np.errstate(over="ignore"):
            return np.unique(self.prints.grams(self.prints.prefix(symbols), min(self.size, len(told))))


class Minima:
    def __init__(self, seed: int, count: int) -> None:
        self.factors = np.random.default_rng(seed).integers(0, 1 << 62, count, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factors), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(grams), 1024):
            part = (grams[None, at : at + 1024] * self.factors[:, None]) >> np.uint64(32)
            least = np.minimum(least, part.min(axis=1).astype(np.uint32))
        return least


def sketches(docs: DataFrame, forest: Forest) -> DataFrame:
    """One row for each document: its set's size and fingerprint (`node`), its signature and sketch."""
    minima = Minima(11, forest.minima)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(forest.shingle)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                grams = shingles(text)
                if not len(grams):
                    rows.append((0, 0, None, None))
                    continue
                least = minima(grams)
                node = np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).astype(np.int64)
                rows.append((len(grams), node, least.astype(">u4").tobytes(), (least & 255).astype(np.uint8).tobytes()))
            out = pd.DataFrame(rows, columns=["n_shingles", "node", "signature", "sketch"])
            yield pd.concat([batch[["doc_id", "text_key"]].reset_index(drop=True), out], axis=1)

    return keyed(docs).mapInPandas(scan, SKETCH)


def regions(sets: DataFrame, forest: Forest) -> tuple[DataFrame, DataFrame | None]:
    """region, node, tree, members for all regions of two documents or more, at the depth that each one needs.

    Besides, the nodes that left a full region for a longer prefix, if there are any.
    """
    rows = sets.select(
        "node", "signature", F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1))).alias("tree")
    )
    found = crowd = None
    for depth in range(forest.start, forest.depth + 1):
        at = F.col("tree") * (4 * forest.depth) + 1
        placed = rows.select("node", "tree", F.xxhash64("tree", F.lit(depth), F.substring("signature", at, F.lit(4 * depth))).alias("region"))
        sizes = placed.groupBy("region").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
        held = stage(placed.join(stage(sizes, "sizes"), "region"), "regions")
        full = held.filter(F.col("members") > forest.region)
        last = depth == forest.depth or full.isEmpty()
        settled = held if last else held.filter(F.col("members") <= forest.region)
        found = settled if found is None else found.unionByName(settled)
        if last:
            return found, crowd
        if crowd is None:  # longer prefixes part these nodes, and no others
            crowd = full.select("node").distinct()
        rows = full.select("node", "tree").join(sets.select("node", "signature"), "node")
    return found, crowd


def further_regions(docs: DataFrame, sets: DataFrame, crowd: DataFrame, forest: Forest) -> DataFrame:
    """As `regions`, for the nodes of `crowd`: the `forest.further` orders, in which all prefixes are `depth` long."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, minima = Shingles(forest.shingle), Minima(13, forest.further * forest.depth)
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "signature": [minima(shingles(t)).astype(">u4").tobytes() for t in batch["text"]]})

    where = stage(sets.select("node", "doc_id", "text_key").join(crowd, "node"), "crowd")
    texts = texts_of(docs, where)
    told = texts.join(where, same_row(texts, where)).select("node", "text").mapInPandas(scan, "node bigint, signature binary")
    signed = stage(told.dropDuplicates(["node"]), "further")
    place = F.xxhash64("tree", F.lit(forest.depth), F.substring("signature", (F.col("tree") - forest.trees) * (4 * forest.depth) + 1, F.lit(4 * forest.depth)))
    trees = F.sequence(F.lit(forest.trees), F.lit(forest.trees + forest.further - 1))
    placed = signed.select("node", "signature", F.explode(trees).alias("tree")).select("node", "tree", place.alias("region"))
    sizes = placed.groupBy("region").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    return stage(placed.join(stage(sizes, "sizes"), "region"), "regions")


def _agreement(batch: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(batch["sketch"]), np.uint8).reshape(len(batch), -1)


def _groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Whole groups, many at a time, from batches that are sorted by `key`."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        last = held[key].to_numpy() == held[key].iloc[-1]
        if not last.all() and len(held) >= 8 * BATCH_ROWS:
            yield held[~last].reset_index(drop=True)
            held = held[last].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def _near(rows: pd.DataFrame, key: str, forest: Forest) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places i < j of rows of one group whose sketches and sizes allow a link, and how many bytes agree."""
    group, sketch, size = rows[key].to_numpy(), _agreement(rows), rows["n_shingles"].to_numpy()
    i = np.arange(len(rows))
    lag = 1
    while True:
        i = i[i + lag < len(rows)]
        i = i[group[i] == group[i + lag]]
        if not len(i):
            return
        j = i + lag
        small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        fit = 100 * small >= forest.percent * large
        a, b = i[fit], j[fit]
        same = (sketch[a] == sketch[b]).sum(axis=1)
        yes = same >= forest.agreeing
        yield a[yes], b[yes], same[yes]
        lag += 1


def proposed(members: DataFrame, forest: Forest) -> DataFrame:
    """a, b, dense: pairs of neighbours in the sorted orders that may be linked.

    A region whose likely pairs are at most four for each member gives all of them. In a denser one, as copies of
    one text make, each member is paired with the likeliest of those before it and with the one that agrees most
    with all (the text that the others were copied from, as a rule), and the region is named (`dense`) for a
    second look once these pairs are confirmed.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _groups(batches, "piece"):
            node, piece, region = rows["node"].to_numpy(), rows["piece"].to_numpy(), rows["region"].to_numpy()
            label = np.unique(piece, return_inverse=True)[1]
            count = np.zeros(label.max() + 1, np.int64)
            room = 4 * np.bincount(label)
            pairs: list[tuple[np.ndarray, np.ndarray]] = []
            best, parent = np.zeros(len(rows), np.int64), np.full(len(rows), -1)
            closeness = np.zeros(len(rows))
            for a, b, same in _near(rows, "piece", forest):
                closeness[a] += same
                closeness[b] += same
                np.add.at(count, label[a], 1)
                better = same > best[b]
                best[b[better]], parent[b[better]] = same[better], a[better]
                open_ = count[label[a]] <= room[label[a]]
                pairs.append((a[open_], b[open_]))
            dense = (count > room) | (rows.groupby(label)["members"].first().to_numpy() > forest.region)
            a = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
            b = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
            few = ~dense[label[a]]
            child = np.flatnonzero((parent >= 0) & dense[label])
            central = np.zeros(len(count), np.int64)
            by_closeness = np.argsort(closeness, kind="stable")
            central[label[by_closeness]] = by_closeness
            member = np.flatnonzero(dense[label] & (central[label] != np.arange(len(rows))))
            left = np.concatenate((a[few], parent[child], central[label[member]]))
            right = np.concatenate((b[few], child, member))
            whole = np.unique(region[dense[label]])
            yield pd.DataFrame({
                "a": np.concatenate((np.minimum(node[left], node[right]), whole)),
                "b": np.concatenate((np.maximum(node[left], node[right]), whole)),
                "dense": np.concatenate((np.zeros(len(left), bool), np.ones(len(whole), bool))),
            })

    # A region that stays full at the last depth is cut into pieces that share its first member.
    parts = F.ceil(F.col("members") / forest.region).cast("int")
    whole = members.filter(F.col("members") <= forest.region).withColumn("piece", F.col("region"))
    crowd = members.filter(F.col("members") > forest.region)
    first = stage(crowd.groupBy("region").agg(F.min("node").alias("node"), F.first("members").alias("members")), "first")
    dealt = crowd.withColumn("piece", F.xxhash64("region", F.pmod(F.xxhash64("node"), parts)))
    shared = first.withColumn("_k", F.explode(F.sequence(F.lit(0), parts - 1))).join(
        members.select("node", "n_shingles", "sketch").dropDuplicates(["node"]), "node"
    ).withColumn("piece", F.xxhash64("region", F.col("_k").cast("bigint")))
    columns = ["piece", "region", "node", "members", "n_shingles", "sketch"]
    rows = whole.select(*columns)
    if not first.isEmpty():
        rows = rows.unionByName(dealt.select(*columns)).unionByName(shared.select(*columns))
    return rows.repartition("piece").sortWithinPartitions("piece", "sketch").mapInPandas(scan, "a bigint, b bigint, dense boolean")


def shingle_sets(docs: DataFrame, where: DataFrame, forest: Forest) -> DataFrame:
    """node, grams (the sorted fingerprints as bytes) for the nodes of `where` (node, doc_id, text_key)."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(forest.shingle)
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "grams": [shingles(t).tobytes() for t in batch["text"]]})

    texts = texts_of(docs, where)
    told = texts.join(where, same_row(texts, where)).select("node", "text").dropDuplicates(["node"])
    return told.mapInPandas(scan, "node bigint, grams binary")


def linked_in_regions(members: DataFrame, forest: Forest) -> DataFrame:
    """a, b: links between `members` (region, tree, node, root, n_shingles, sketch, grams, homes) whose roots differ.

    In each region the members outside its commonest root are compared with all, in blocks of bounded size; those
    of the commonest root, already one component, are not compared with each other. Full sets are compared on the
    spot, so that only links come out. A pair is looked at in the first tree in which both share a region
    (`homes`: the regions of a node by tree), and not if links of the same block have joined it already.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _groups(batches, "piece"):
            node, tree = rows["node"].to_numpy(), rows["tree"].to_numpy()
            root, piece = rows["root"].tolist(), rows["piece"].tolist()
            homes = np.stack(rows["homes"].to_numpy()).astype(np.int64)
            grams = [np.frombuffer(g, np.uint64) for g in rows["grams"]]
            joined: dict[tuple[int, int], tuple[int, int]] = {}

            def top(key: tuple[int, int], joined=joined) -> tuple[int, int]:
                while key in joined:
                    key = joined[key]
                return key

            for a, b, _ in _near(rows, "piece", forest):
                shared = (homes[a] == homes[b]) & (homes[a] >= 0)
                here = shared.argmax(axis=1) == tree[a]
                links = []
                for i, j in zip(a[here].tolist(), b[here].tolist(), strict=True):
                    left, right = top((piece[i], root[i])), top((piece[j], root[j]))
                    if left == right:
                        continue
                    common = len(np.intersect1d(grams[i], grams[j], assume_unique=True))
                    if 100 * common >= forest.percent * (len(grams[i]) + len(grams[j]) - common):
                        joined[left] = right
                        links.append((node[i], node[j]))
                if links:
                    yield pd.DataFrame(links, columns=["a", "b"])

    counts = stage(
        members.groupBy("region", "root").agg(F.count(F.lit(1)).alias("_n"), F.sum("n_shingles").alias("_size")), "counts"
    )
    blocks = lambda rows, size: F.ceil(F.greatest(rows / forest.region, size / BLOCK_SHINGLES)).cast("int")
    main = stage(
        counts.groupBy("region").agg(
            F.max(F.struct("_n", "root", "_size")).alias("_top"), F.sum("_n").alias("_all"), F.sum("_size").alias("_whole")
        )
        .filter(F.col("_all") > F.col("_top._n"))
        .select(
            "region", F.col("_top.root").alias("_main"), blocks(F.col("_top._n"), F.col("_top._size")).alias("_i"),
            blocks(F.col("_all") - F.col("_top._n"), F.col("_whole") - F.col("_top._size")).alias("_o"),
        ),
        "main",
    )
    rows = (
        members.join(main, "region")
        .withColumn("_inside", F.col("root") == F.col("_main"))
        .withColumn("_block", F.pmod(F.xxhash64("node"), F.when(F.col("_inside"), F.col("_i")).otherwise(F.col("_o"))).cast("int"))
    )
    every = lambda n: F.sequence(F.lit(0), n - 1)
    place = lambda x, y, z: F.struct(x.alias("x"), y.alias("y"), F.lit(z).alias("z"))
    block = F.col("_block")
    inside = rows.filter("_inside").withColumn("_key", F.explode(F.transform(every(F.col("_o")), lambda o: place(block, o, 0))))
    outside = rows.filter("not _inside").withColumn(
        "_key",
        F.explode(F.concat(
            F.transform(every(F.col("_i")), lambda i: place(i, block, 0)),
            F.transform(every(F.col("_o")), lambda o: place(F.least(o, block), F.greatest(o, block), 1)),
        )),
    )
    columns = ["piece", "node", "tree", "root", "n_shingles", "sketch", "homes", "grams"]
    dealt = inside.unionByName(outside).withColumn("piece", F.xxhash64("region", "_key.x", "_key.y", "_key.z")).select(*columns)
    return dealt.repartition("piece").sortWithinPartitions("piece", "sketch").mapInPandas(scan, "a bigint, b bigint").distinct()


def confirmed(docs: DataFrame, sets: DataFrame, pairs: DataFrame, forest: Forest) -> DataFrame:
    """a, b of those `pairs` whose full shingle sets are similar enough."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    where = stage(sets.select("node", "doc_id", "text_key").join(ends, "node"), "ends")
    texts = texts_of(docs, where)
    told = stage(
        texts.join(where, same_row(texts, where)).select("node", "text").dropDuplicates(["node"]), "compared"
    )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, remembered = Shingles(forest.shingle), {}

        def known(node: int, text: str) -> np.ndarray:
            if node not in remembered:
                if len(remembered) >= BATCH_ROWS:
                    remembered.clear()
                remembered[node] = shingles(text)
            return remembered[node]

        for batch in batches:
            linked = []
            for a, b, text_a, text_b in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"], strict=True):
                left, right = known(a, text_a), known(b, text_b)
                common = len(np.intersect1d(left, right, assume_unique=True))
                linked.append(100 * common >= forest.percent * (len(left) + len(right) - common))
            yield batch.loc[linked, ["a", "b"]]

    left = told.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = told.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").mapInPandas(scan, "a bigint, b bigint")


def near_dedup(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept, text_key.

    A document is the set of its distinct shingles of `forest.shingle` words; with fewer words, all of them are
    one; without words (or text) the set is empty and linked with nothing. Documents are linked if their sets,
    compared in full, are similar enough; equal sets are one node from the start. `component_id` is the smallest
    doc_id that links reach, `kept` whether it is the row's own. Null doc_ids are larger than any other: such a
    row is kept only if no row with an id is reached. Rows that repeat a doc_id share its fate only where they are
    linked. An empty table gives an empty result; other columns are not looked at.
    """
    rows = stage(sketches(docs, forest), "sketches")
    filled = rows.filter("n_shingles > 0")
    sets = stage(filled.dropDuplicates(["node"]), "sets")
    placed, crowd = regions(sets, forest)
    if crowd is not None and forest.further:
        placed = placed.unionByName(further_regions(docs, sets, crowd, forest))
    described = placed.join(sets.select("node", "n_shingles", "sketch"), "node")
    found = stage(proposed(described, forest), "proposed")
    pairs = stage(found.filter("not dense").select("a", "b").distinct(), "pairs")
    links = stage(confirmed(docs, sets, pairs, forest), "links")
    roots = stage(components(links), "roots")
    dense = found.filter("dense").select(F.col("a").alias("region")).distinct()
    crowded = stage(
        placed.join(maybe_broadcast(stage(dense, "dense")), "region", "left_semi").select("region", "tree", "node"), "crowded"
    )
    if not crowded.isEmpty():
        by_tree = F.map_from_entries(F.collect_list(F.struct("tree", F.col("region").bitwiseAND(F.lit((1 << 63) - 1)))))
        homes = crowded.groupBy("node").agg(by_tree.alias("_by")).select(
            "node", F.transform(F.sequence(F.lit(0), F.lit(forest.trees + forest.further - 1)), lambda t: F.coalesce(F.element_at("_by", t), F.lit(-1))).alias("homes")
        )
        rooted = stage(homes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
        where = stage(sets.select("node", "doc_id", "text_key").join(rooted.select("node"), "node", "left_semi"), "where")
        full = stage(shingle_sets(docs, where, forest), "crowd_sets")
        told = stage(rooted.join(full, "node").join(sets.select("node", "n_shingles", "sketch"), "node"), "told")
        more = stage(linked_in_regions(crowded.join(told, "node"), forest), "more_links")
        if not more.isEmpty():
            roots = stage(components(links.unionByName(more)), "roots")
    firsts = filled.groupBy("node").agg(F.min("doc_id").alias("_first")).join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node")
    )
    firsts = stage(firsts, "firsts")
    least = stage(firsts.groupBy("root").agg(F.min("_first").alias("component_id")), "least")
    named = stage(firsts.join(least, "root").select("node", "component_id"), "components")
    plain = ["doc_id", "n_shingles", "component_id", "text_key"]
    whole = filled.select("doc_id", "n_shingles", "node", "text_key").join(named, "node").select(*plain).unionByName(
        rows.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id")).select(*plain)
    )
    return whole.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
