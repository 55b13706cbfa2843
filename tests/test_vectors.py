"""Vector search by cells against a full search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from transitus.operators import text, vectors


def plain(rows, queries, k):
    ids, own = [i for i, _ in rows], vectors.unit(np.array([v for _, v in rows], dtype=float))
    out = []
    for q, v in queries:
        near = np.round(own @ vectors.unit(np.array([v], dtype=float))[0], 6)
        for rank, at in enumerate(sorted(range(len(ids)), key=lambda a: (-near[a], ids[a]))[:k], 1):
            out.append((q, rank, ids[at], near[at] + 0.0))
    return sorted(out)


def clustered(count, dims=8, seed=1):
    """A third of the vectors in one narrow cluster, copies and zero vectors among them."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, dims))
    pick = np.where(draw.random(count) < 1 / 3, 0, draw.integers(0, 12, count))
    out = centres[pick] + draw.normal(scale=0.15, size=(count, dims))
    out[::37] = out[0]
    out[5::61] = 0
    return [(int(i), [float(x) for x in v]) for i, v in enumerate(out)]


@pytest.mark.parametrize("cells, slice_rows, lot_rows", [(None, 8192, 1024), (40, 16, 3), (1, 50, 1000)])
def test_search_equals_full_search(spark, monkeypatch, cells, slice_rows, lot_rows):
    monkeypatch.setattr(vectors, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(vectors, "LOT_ROWS", lot_rows)
    rows = clustered(600)
    queries = [(f"q{i}", v) for i, v in clustered(25, seed=2)] + [("zero", [0.0] * 8), ("same", rows[0][1])]
    table = spark.createDataFrame([*rows, (None, rows[1][1]), (9999, None)], "id bigint, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([*queries, ("none", None)], "q string, embedding array<double>")
    index = vectors.build(table, "id", cells=cells)
    got = [(r["q"], r["rank"], r["id"], r["cosine"] + 0.0) for r in vectors.search(index, asked, 7, "q").collect()]
    assert sorted(got) == plain(rows, queries, 7)


def test_bounds_leave_cells_out(spark):
    """Most cells are skipped for a query near a narrow cluster, and all are open for a zero query."""
    rows = clustered(600)
    index = vectors.build(spark.createDataFrame(rows, "id bigint, embedding array<double>"), "id", cells=24)
    near = [(f"q{i}", v) for i, v in rows if i % 7 == 1][:20]
    probes = []
    whole = vectors._best

    def counted(index, asked, *rest):
        probes.append(asked.count())
        return whole(index, asked, *rest)

    vectors._best = counted
    try:
        asked = spark.createDataFrame(near, "q string, embedding array<double>")
        assert vectors.search(index, asked, 3, "q").count() == 60
    finally:
        vectors._best = whole
    assert probes[0] == 20 * vectors.FIRST_CELLS and probes[1] < 20 * 24 / 2


def test_nothing_to_find(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0])], "id int, embedding array<float>")
    queries = spark.createDataFrame([(1, [0.5, 0.5])], "q int, embedding array<float>")
    assert text.similar_vectors(table, queries.limit(0), 3, "id", "q").count() == 0
    assert text.similar_vectors(table.limit(0), queries, 3, "id", "q").count() == 0
    assert text.similar_vectors(table, queries, 3, "id", "q").select("rank", F.round("cosine", 3)).collect() == [(1, 0.707)]
