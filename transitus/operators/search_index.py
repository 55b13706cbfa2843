"""A stored inverted index, extended by segments, and exact BM25 search that reads postings only.

An index is a folder of tables. Each call of `add` writes one *segment*: its postings (word, document, occurrences and
length of the document), in folders by a hash of the word; the number of documents of each word; and for each word its
*blocks*, groups of postings with like occurrences and like length, with the most occurrences and the least length in
them. The segment counts once its row in the table of segments is written, which comes last: what a broken run left
behind is not read.

Blocks bound the weight of a posting from above whatever the corpus grows to, as weights rise with occurrences and
fall with length. A search uses them twice: for the most that a word can add to a query, and to leave out blocks whose
documents cannot reach a query's k-th best.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transitus.functions.columns import n_rows
from transitus.functions.skew import HOT_ROWS, heaviest, salted_join
from transitus.functions.text import with_word_counts, words
from transitus.session import stage

# A weight is below 2.2 * ln(documents + 1); up to 18 digits a decimal is one long in shuffles and files.
WEIGHT = "decimal(18,6)"
K1, B = 1.2, 0.75
# Folders that postings are dealt over by word: a search reads those of its words.
BUCKETS = 64
# Postings of a word share a block if they have as many occurrences (up to MANY) and lengths within a factor of 2 ** (1 / FINE).
MANY, FINE = 16, 4
# Leading documents, as a multiple of k, that are scored in full to set the bar.
LEADING = 4
SEGMENTS = "segment string, n_docs bigint, n_words bigint"


class SearchIndex:
    """An index in a folder that all executors share; `key` names a document and `kind` is its type.

    Whoever opens a folder again gives the same number of `buckets`.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, kind: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.kind, self.buckets = spark, path.rstrip("/"), key, kind, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("word"), F.lit(self.buckets)).cast("int")

    def _read(self, table: str, schema: str) -> DataFrame:
        """Rows of the segments that count; none in an index without any."""
        try:
            rows = self.spark.read.schema(f"segment string, {schema}").parquet(f"{self.path}/{table}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], f"segment string, {schema}")
        return rows if table == "segments" else rows.join(self.segments().select("segment"), "segment", "left_semi")

    def segments(self) -> DataFrame:
        return self._read("segments", SEGMENTS.split(", ", 1)[1])

    def postings(self) -> DataFrame:
        return self._read("postings", f"bucket int, word string, {self.key} {self.kind}, _tf bigint, _dl int, block int")

    def frequency(self) -> DataFrame:
        return self._read("words", "word string, _df bigint").groupBy("word").agg(F.sum("_df").alias("_df"))

    def blocks(self) -> DataFrame:
        return self._read("blocks", "bucket int, word string, block int, _most bigint, _least int")

    def documents(self) -> DataFrame:
        return self._read("documents", f"{self.key} {self.kind}")

    def add(self, docs: DataFrame, text: str = "text", only: DataFrame | None = None) -> str:
        """Index the documents of `docs` that the index does not hold yet, as a new segment; returns its name.

        `only` (word) restricts the postings to some words, for an index that answers known queries. Rows without a
        key are left out, null texts have no words, and a key that `docs` repeats is one document with all its words.
        Words are counted within their row and shuffled once; `docs` is read for its keys and for its texts.
        """
        fresh = docs.filter(F.col(self.key).isNotNull())
        if not self.segments().isEmpty():
            fresh = fresh.join(self.documents().select(self.key), self.key, "left_anti")
        fresh = fresh.select(self.key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
        one = with_word_counts(fresh, F.col("_text")).select(self.key, "word", "_tf", "_dl")
        if only is not None:
            one = one.join(only.select("word").distinct(), "word", "left_semi")
        sizes = fresh.groupBy(self.key).agg(n_rows().alias("_rows"))
        if not sizes.filter("_rows > 1").isEmpty():
            whole = fresh.groupBy(self.key).agg(F.sum(F.size(words("_text"))).cast("int").alias("_dl"))
            one = one.groupBy(self.key, "word").agg(F.sum("_tf").alias("_tf")).join(whole, self.key)
        segment = uuid.uuid4().hex
        block = F.least("_tf", F.lit(MANY)) * 1_000 + F.floor(F.log2(F.greatest("_dl", F.lit(1))) * FINE)
        # what follows from the other columns is added behind the shuffle
        dealt = one.select("word", self.key, "_dl", "_tf").repartition(self._bucket(), F.pmod(F.xxhash64(self.key), F.lit(16)))
        postings = dealt.withColumn("block", block.cast("int")).withColumn("bucket", self._bucket())

        def write(df: DataFrame, table: str, *by: str) -> None:
            df.withColumn("segment", F.lit(segment)).write.mode("append").partitionBy("segment", *by).parquet(f"{self.path}/{table}")

        write(postings.sortWithinPartitions("bucket", "word"), "postings", "bucket")
        held = self.spark.read.parquet(f"{self.path}/postings").filter(F.col("segment") == segment)
        # a few groups hold most blocks: summed per block, then per word
        write(
            held.groupBy("bucket", "word", "block")
            .agg(F.max("_tf").alias("_most"), F.min("_dl").alias("_least"), n_rows().alias("_n")).repartition("bucket"),
            "blocks", "bucket",
        )
        blocks = self.spark.read.parquet(f"{self.path}/blocks").filter(F.col("segment") == segment)
        write(blocks.groupBy("word").agg(F.sum("_n").alias("_df")), "words")
        write(sizes.select(self.key), "documents")
        # all words stand in the postings unless `only` left some out
        lengths = held.select(F.col("_tf").alias("w")) if only is None else fresh.select(F.size(words("_text")).cast("bigint").alias("w"))
        counted = sizes.select(F.lit(1).alias("d"), F.lit(0).cast("bigint").alias("w")).unionByName(lengths.select(F.lit(0).alias("d"), "w"))
        write(counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for c, n in (("d", "n_docs"), ("w", "n_words"))]), "segments")
        return segment

    def search(self, queries: DataFrame, k: int, query_key: str, text: str = "text", common_share: float = 0.1, min_rows: int = HOT_ROWS) -> DataFrame:
        """Best `k` documents per query by BM25 over all words of the query, exact: query, rank, document, score.

        Equal query texts are searched once. Term weights are rounded to six places as decimals before they are
        summed. A query is first scored by its rarer words, those in at most `common_share` of all documents; the
        documents that lead get their whole scores, whose k-th best is a bar. Where all common words together stay
        below the bar, only documents found already can reach it, and only they ask for common words. Otherwise the query is scored in full, without the blocks whose best posting and
        the most that its other words add stay below the bar.
        """
        key = self.key
        hashed = queries.select(query_key, F.sha2(text, 256).alias("_q"), text)
        asked = hashed.groupBy("_q").agg(F.min(text).alias(text)).select("_q", F.explode(F.array_distinct(words(text))).alias("word"))
        sums = self.segments().agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("w")).first()
        n, all_words = F.lit(float(sums["n"])), F.lit(float(sums["w"]))
        wanted = stage(asked.select("word").distinct().withColumn("bucket", self._bucket()), "asked-words")
        idf = F.log(F.lit(1.0) + (n - F.col("_df") + F.lit(0.5)) / (F.col("_df") + F.lit(0.5)))

        def weight(tf: str, dl: str) -> Column:
            norm = F.lit(1 - B) + F.lit(B) * F.col(dl).cast("double") * n / all_words
            return F.round(idf * F.col(tf).cast("double") * F.lit(K1 + 1) / (F.col(tf).cast("double") + F.lit(K1) * norm), 6).cast(WEIGHT)

        frequency = stage(self.frequency().join(wanted.select("word"), "word", "left_semi"), "asked-frequency")
        # a posting's weight is the same for all queries
        weighed = stage(
            self.postings().join(wanted, ["bucket", "word"], "left_semi").join(frequency, "word")
            .select("word", "block", key, weight("_tf", "_dl").alias("_w")),
            "asked-postings",
        )
        tops = stage(
            self.blocks().join(wanted, ["bucket", "word"], "left_semi").join(frequency, "word")
            .groupBy("word", "block").agg(F.max(weight("_most", "_least")).alias("_top")),
            "asked-blocks",
        )
        most = tops.groupBy("word").agg(F.max("_top").alias("_top"))
        terms = stage(
            asked.join(frequency, "word").join(most, "word").withColumn("_common", F.col("_df") > n * F.lit(common_share)), "asked-terms"
        )
        hot = heaviest(frequency, "word", "_df", min_rows)

        def scored(hits: DataFrame) -> DataFrame:
            return hits.groupBy("_q", key).agg(F.sum("_w").alias("_s"))

        rare = stage(scored(salted_join(weighed, terms.filter("not _common").select("_q", "word"), "word", hot, [key])), "asked-rare")
        best = Window.partitionBy("_q").orderBy(F.desc("_s"), key)

        def with_common(found: DataFrame) -> DataFrame:
            """Whole scores of (_q, document, score by the rarer words); rows grow with what was found."""
            # written, so that few of them are known to be few and are sent to the postings
            pairs = stage(found.select("_q", key).join(terms.filter("_common").select("_q", "word"), "_q"), "asked-pairs")
            added = pairs.join(weighed, [key, "word"]).select("_q", key, F.col("_w").alias("_s"))
            return found.unionByName(added).groupBy("_q", key).agg(F.sum("_s").alias("_s"))

        leading = stage(
            rare.withColumn("_at", F.row_number().over(best)).filter(F.col("_at") <= LEADING * k).drop("_at"), "asked-leading"
        )
        bar = with_common(leading).withColumn("_at", F.row_number().over(best)).filter(F.col("_at") == k).select("_q", F.col("_s").alias("_bar"))
        sums_of = terms.groupBy("_q").agg(
            F.sum("_top").alias("_all"), F.coalesce(F.sum(F.when(F.col("_common"), F.col("_top"))), F.lit(0).cast(WEIGHT)).alias("_rest")
        )
        limits = stage(sums_of.join(bar, "_q", "left"), "asked-limits")
        open_ = F.col("_bar").isNull() | (F.col("_rest") >= F.col("_bar"))
        # a document in a block left out is below the bar, whatever else it holds
        full = terms.join(limits.filter(open_), "_q").select("_q", "word", "_top", "_all", "_bar")
        useful = full.join(tops.select("word", "block", F.col("_top").alias("_own")), "word").filter(
            F.col("_bar").isNull() | (F.col("_all") - F.col("_top") + F.col("_own") >= F.col("_bar"))
        ).select("_q", "word", "block")
        place = F.struct("word", "block").alias("_place")
        # written for the same reason: without hot words no posting is sent to a list of none
        hot_places = stage(tops.join(hot, "word").select(place, "_hot"), "asked-hot-places")
        opened = scored(salted_join(weighed.select(place, key, "_w"), useful.select("_q", place), "_place", hot_places, [key]))
        near = rare.join(limits.filter(~open_), "_q").filter(F.col("_s") + F.col("_rest") >= F.col("_bar")).select("_q", key, "_s")
        closed = with_common(near)
        last = Window.partitionBy("_q").orderBy(F.desc("score"), key)
        top = (
            opened.unionByName(closed).select("_q", key, F.col("_s").cast("double").alias("score"))
            .withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
        )
        return hashed.drop(text).join(top, "_q").select(query_key, "rank", key, "score")
