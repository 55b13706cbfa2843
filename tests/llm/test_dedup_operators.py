"""Deduplication, archive and shards against plain versions, with nulls, ties, repeated rows and empty tables."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from transitus.llm import exact_dedup, graph, near_dedup, sharding, substring_dedup, suffix_dedup, warc
from transitus.llm.common import drop_rows, prepared, stage

CLASH = "doc_id bigint, text string, start string, kept string, _row string, text_key string, node string"


def frame(spark, rows):
    prepared(spark)
    return spark.createDataFrame([(i, t, "", "", "", "", "") for i, t in rows], CLASH)


def prose(rng, count, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(count)]


def mixture(seed, count, size):
    """Texts with copies, near copies, shared passages, repeats inside a text, nulls, short and long ones."""
    rng = random.Random(seed)
    shared = [prose(rng, size // 2) for _ in range(4)]
    texts = [None, "", " ", "x", "same words", "same words"]
    for k in range(count):
        told = prose(rng, rng.randrange(2, size))
        if k % 3 == 0:
            at = rng.randrange(len(told))
            told[at:at] = rng.choice(shared)
        if k % 5 == 0:
            told = told + told
        if k % 4 == 0 and k > 8:
            told = (texts[rng.randrange(6, len(texts))] or "x").split()
            for _ in range(rng.randrange(3)):
                told[rng.randrange(len(told))] = "edit"
        texts.append((" " if k % 2 else "\n").join(told))
    return texts + ["a " * 700, "a " * 900, "ab" * 800]


def test_exact(spark):
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "c" * 70 + "x"), (7, "c" * 70 + "y"), (8, "c" * 70 + "x"), (8, "c" * 70 + "x"), (None, "a"), (9, "é")]
    docs = frame(spark, rows)
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    for digest_all in (False, True):
        found = exact_dedup.exact_dedup(docs, digest_all=digest_all).collect()
        assert len(found) == len(rows)
        assert sum(r["kept"] for r in found) == len(groups)
        by = {r["doc_id"]: r for r in found}
        for t, ids in groups.items():
            for i in ids:
                assert (by[i]["keep_id"], by[i]["group_size"]) == (max(x for x in ids if x is not None), len(ids))
                if digest_all or len(ids) > 1:
                    assert by[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    left = drop_rows(docs, stage(exact_dedup.exact_dedup(docs), "found"))
    assert left.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == sorted((max(i for i in ids if i is not None), "" if t == "" else t) for t, ids in groups.items())
    folded = exact_dedup.exact_dedup(frame(spark, [(1, "A"), (2, "a")]), normalise=F.lower)
    assert {r["keep_id"] for r in folded.collect()} == {2}
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_exact_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "maybe_broadcast", lambda df: df)
    found = exact_dedup.exact_dedup(frame(spark, [(1, "a"), (2, "a"), (3, "b")])).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in found) == [(1, 2, False), (2, 2, True), (3, 3, True)]


@pytest.mark.parametrize("length, gram", [(40, 8), (64, 25)])
def test_suffix(spark, length, gram):
    texts = mixture(length, 60, 60)
    rows = list(enumerate(texts)) + [(3, texts[9]), (None, texts[10]), (20, texts[20])]
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[k : k + length] for r in raws for k in range(len(r) - length + 1))
    expected = Counter()
    for (i, _), raw in zip(rows, raws, strict=True):
        gone = set()
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] > 1:
                gone.update(range(k, k + length))
        kept = bytes(b for k, b in enumerate(raw) if k not in gone)
        expected[i, len(raw), len(gone), sum(k - 1 not in gone for k in gone), kept] += 1
    found = suffix_dedup.remove_repeats(frame(spark, rows), length, gram).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found) == expected
    assert suffix_dedup.remove_repeats(frame(spark, rows).limit(0), length, gram).count() == 0


@pytest.mark.parametrize("group_pieces", [1, 3, 500])
def test_substring(spark, group_pieces):
    length = 12
    texts = mixture(group_pieces, 60, 50)
    rows = list(enumerate(texts)) + [(3, texts[9]), (None, texts[10]), (20, texts[20])]
    first = {}
    for i, t in rows:
        told = (t or "").encode().split()
        for k in range(len(told) - length + 1):
            run = tuple(told[k : k + length])
            first[run] = min(first.get(run, float("inf")), float("inf") if i is None else i)
    expected = Counter()
    for i, t in rows:
        told, gone = (t or "").encode().split(), set()
        for k in range(len(told) - length + 1):
            if first[tuple(told[k : k + length])] < (float("inf") if i is None else i):
                gone.update(range(k, k + length))
        kept = b" ".join(w for k, w in enumerate(told) if k not in gone).decode()
        expected[i, len(told), len(gone), kept] += 1
    found = substring_dedup.remove_earlier(frame(spark, rows), length, 5, group_pieces).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in found) == expected
    assert substring_dedup.remove_earlier(frame(spark, rows).limit(0), length, 5).count() == 0


def components_of(sets, percent):
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("short", [True, False])
def test_exact_digest_of_texts_alone_is_null(spark, monkeypatch, short):
    if not short:  # as for a list of shared (length, prefix) that is too long to broadcast
        monkeypatch.setattr(exact_dedup, "maybe_broadcast", lambda df: df)
    found = exact_dedup.exact_dedup(frame(spark, [(1, "a"), (2, "a"), (3, "alone")])).collect()
    assert {r["doc_id"]: r["text_sha256"] is None for r in found} == {1: False, 2: False, 3: True}


def near_texts(seed):
    rng = random.Random(seed)
    texts = [None, "", "one", "ONE", "two words", "two  Words", "a b c", "a b c d"]
    for base in range(6):
        told = prose(rng, rng.choice([8, 30, 120]), 5000)
        for _ in range(rng.choice([1, 4, 40])):
            copy = list(told)
            for _ in range(rng.randrange(1 + len(told) // 15)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(9)}"
            texts.append(" ".join(copy))
    return texts


# region=8 makes regions go deeper, stay full, and be cut into pieces
@pytest.mark.parametrize("shingle, percent, region", [(3, 85, 2_000), (5, 80, 8), (1, 90, 50)])
def test_near(spark, shingle, percent, region):
    texts = near_texts(shingle)
    sets = {}
    for i, t in enumerate(texts):
        told = (t or "").encode().lower().split()
        size = min(shingle, len(told))
        sets[i] = {tuple(told[k : k + size]) for k in range(len(told) - size + 1)} if told else set()
    want = components_of(sets, percent)
    forest = near_dedup.Forest(shingle, percent, region=region)
    found = near_dedup.near_dedup(frame(spark, list(enumerate(texts))), forest).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == {
        i: (len(sets[i]), want[i], want[i] == i) for i in sets
    }


def test_near_crowded_pairs(spark):
    """Documents of one template stay below the threshold; each has one partner at it, in regions that are all full."""
    rng = random.Random(21)
    template = prose(rng, 260, 100_000)
    texts = []
    for _ in range(60):
        told = template + prose(rng, 60, 100_000)
        copy = list(told)
        copy[260:296] = prose(rng, 36, 100_000)  # some 284 of 356 words in common
        texts += [" ".join(told), " ".join(copy)]
    forest = near_dedup.Forest(shingle=1, percent=79, trees=5, start=1, region=8)
    assert near_dedup.Forest().further == 22 and near_dedup.Forest(percent=100).further == 0
    sets = {i: set(t.split()) for i, t in enumerate(texts)}
    want = components_of(sets, forest.percent)
    assert all(want[i] == i - i % 2 for i in sets)
    found = near_dedup.near_dedup(frame(spark, list(enumerate(texts))), forest).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == want


def test_near_odd_rows(spark):
    text = "one two three four five six seven"
    found = near_dedup.near_dedup(frame(spark, [(None, text), (4, text), (4, text), (None, "else where"), (5, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in found) == [
        (0, 0, True), (0, 4, False), (4, 4, True), (4, 4, True), (5, 5, True)
    ]
    assert near_dedup.near_dedup(frame(spark, [(1, "x")]).limit(0)).count() == 0


def test_components(spark):
    prepared(spark)
    rng = random.Random(5)
    chain = [(k, k + 1) for k in range(0, 40)]
    star = [(1000, 1000 + k) for k in range(1, 60)]
    links = chain + star + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(7, 7)]
    sets = defaultdict(set)
    for a, b in links:
        joined = sets[a] | sets[b] | {a, b}
        for node in joined:
            sets[node] = joined
    found = graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r["node"]: r["root"] for r in found} == {n: min(s) for n, s in sets.items() if len(s) > 1}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_warc(spark, tmp_path):
    rows = [
        (5, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (9, None, "same"), (3, "u", None), (4, "u", ""), (1, "u", "é\r\n\r\nWARC-Type: x\r\n"),
        (2, "again", "same"), (None, "n", "alone"),
    ]
    pages = spark.createDataFrame([(i, u, h, "", "") for i, u, h in rows], "page_id bigint, url string, html string, sha256 string, record_type string")
    prepared(spark)

    def expected(least):
        out = []
        for i, _, h in rows:
            raw = (h or "").encode()
            ids = [x for x, _, other in rows if (other or "") == (h or "") and x is not None]
            revisit = len(raw) >= least and bool(ids) and i != min(ids)
            digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
            out.append((i, len(raw), digest, "revisit" if revisit else "response", min(ids) if revisit else None))
        return Counter(out)

    for least in (0, 3, 5):
        assert Counter(map(tuple, warc.round_trip(pages, least).collect())) == expected(least)
    folder = str(tmp_path / "archive")
    warc.write_archive(pages, folder)
    assert warc.read_payloads(spark, folder).count() == len({(h or "") for _, _, h in rows})
    for r in warc.read_records(spark, folder).collect():
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert block[int(fields[b"Content-Length"]) :] == b"\r\n\r\n"
        if r["record_type"] == "response":
            assert block[:-4] == bytes(r["payload"])
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_damaged_payload_fails(spark, tmp_path):
    prepared(spark)
    folder = str(tmp_path / "archive")
    spark.createDataFrame([("00", bytearray(b"x"))], "sha256 string, payload binary").write.parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_payloads(spark, folder).collect()


def test_shards(spark):
    rng = random.Random(3)
    texts = [" ".join(prose(rng, rng.randrange(1, 40))) for _ in range(300)] + [None, "", "z" * 3000, "é"] + ["copy " * 30] * 60
    rows = list(enumerate(texts)) + [(None, "no id"), (7, texts[7])]
    found = sharding.byte_shards(frame(spark, rows), 6).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    shards, homes = defaultdict(list), defaultdict(set)
    for r in found:
        shards[r["shard"]].append(r)
        homes[r["text_crc32"], r["size"]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(len(h) == 1 for h in homes.values())
    assert all(sorted(r["slot"] for r in rows) == list(range(len(rows))) for rows in shards.values())
    # the 60 copies are more than a sixth of all bytes: they have a shard alone, the others are near equal
    sizes = sorted(sum(r["size"] for r in rows) for rows in shards.values())
    assert sizes[-1] == 60 * 151
    assert sizes[-2] <= 1.3 * sizes[0]
    assert sharding.byte_shards(frame(spark, rows).limit(0), 6).count() == 0
    assert {r["shard"] for r in sharding.byte_shards(frame(spark, [(1, "a")]), 4).collect()} <= set(range(4))
