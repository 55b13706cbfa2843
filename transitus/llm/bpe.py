"""Byte-level BPE: merge ranks from a queue over a doubly linked list of symbols; decoding by concatenation."""

from __future__ import annotations

import hashlib
import heapq
import json

import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from transitus.llm.common import Shipped

# Fixed value: how this kind of vocabulary cuts a text into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Encoded pieces in each of the two halves of a worker's memory, and the longest piece worth remembering.
MEMORY_PIECES, MEMORY_CHARS = 250_000, 64
# Bits of an id in a pair, and of a place in an entry of the queue.
PAIR, PLACE = 32, 40
CODED = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself where printable, else the next from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Bpe:
    """A vocabulary file of the usual JSON form (model.vocab, model.merges, added_tokens)."""

    def __init__(self, said: str) -> None:
        whole = json.loads(said)
        model, letters = whole["model"], byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        ids = model["vocab"]
        self.bytes_of = {i: raw(token) for token, i in ids.items()}
        self.of_byte = [ids[letter] for letter, _ in sorted(letters.items(), key=lambda x: x[1])]
        # a pair as one number: its rank, and for each rank what the pair becomes
        self.ranks, self.joined = {}, []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(ids[left] << PAIR | ids[right], rank)
            self.joined.append(ids[left + right])
        added = {t["content"]: t["id"] for t in whole.get("added_tokens", [])}
        self.added = {text: i for text, i in added.items() if text}
        self.bytes_of |= {i: text.encode() for text, i in self.added.items()}
        self.decimal = {i: str(i) for i in self.bytes_of}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if added else None
        self.pieces = regex.compile(PIECES)
        self.memory: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Always the lowest rank, leftmost first.

        The queue holds rank and place as one number. It keeps entries of pairs that are gone; an entry is stale if the
        pair at its place has another rank by now.
        """
        symbols = [self.of_byte[b] for b in piece]
        end = len(symbols)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        rank_of, pop, push = self.ranks.get, heapq.heappop, heapq.heappush
        queue = []
        for at in range(end - 1):
            if (rank := rank_of(symbols[at] << PAIR | symbols[at + 1])) is not None:
                queue.append(rank << PLACE | at)
        heapq.heapify(queue)
        while queue:
            entry = pop(queue)
            rank, at = entry >> PLACE, entry & ((1 << PLACE) - 1)
            other = after[at]
            # what was merged into its neighbour is -1, and no pair of that has a rank
            if other >= end or rank_of(symbols[at] << PAIR | symbols[other]) != rank:
                continue
            joined = symbols[at] = self.joined[rank]
            symbols[other] = -1
            follower = after[at] = after[other]
            if follower < end:
                before[follower] = at
                if (rank := rank_of(joined << PAIR | symbols[follower])) is not None:
                    push(queue, rank << PLACE | at)
            if (leader := before[at]) >= 0 and (rank := rank_of(symbols[leader] << PAIR | joined)) is not None:
                push(queue, rank << PLACE | leader)
        out, at = [], 0
        while at < end:
            out.append(symbols[at])
            at = after[at]
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        memory = self.memory
        parts = self.split_added.split(text) if self.split_added else [text]
        for odd, part in enumerate(parts):
            if odd % 2:
                out.append(self.added[part])
                continue
            for piece in self.pieces.findall(part):
                ids = memory.get(piece)
                if ids is None:
                    ids = self.older.get(piece) or tuple(self.merge(piece.encode()))
                    if len(piece) <= MEMORY_CHARS:
                        if len(memory) >= MEMORY_PIECES:
                            # what was asked for since the last time stays for another round
                            self.older, self.memory = memory, {}
                            memory = self.memory
                        memory[piece] = ids
                out += ids
        return out

    def written(self, ids: list[int]) -> str:
        """The ids in decimal, joined by commas."""
        return ",".join(map(self.decimal.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Bytes of the tokens in a row; what is no UTF-8 becomes the replacement character."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def vocabulary(spark: SparkSession, path: str) -> Shipped:
    """Broadcasts the parsed vocabulary file, whose size bounds the broadcast."""
    with open(path, encoding="utf-8") as file:
        return Shipped(spark, Bpe(file.read()), keep=True)


def encoder(spark: SparkSession, path: str):
    """A function from a text column to its token ids (array<int>). A null text has none."""
    said = vocabulary(spark, path)

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        bpe = said.get()
        return pd.Series([bpe.encode(t or "") for t in texts], dtype=object)

    return encode


def decoder(spark: SparkSession, path: str):
    """A function from a column of token ids to text. Null ids give a null text, unknown ids fail."""
    said = vocabulary(spark, path)

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        bpe = said.get()
        return pd.Series([None if i is None else bpe.decode(list(i)) for i in ids], dtype=object)

    return decode


def round_trip(spark: SparkSession, text: Column, path: str, with_ids: bool = False) -> Column:
    """A struct of `CODED` for each text: number and digest of its ids, and digest of the text decoded from them.

    `with_ids` adds the ids themselves.
    A null text counts as empty: no ids, digests of the empty string.
    """
    said = vocabulary(spark, path)

    @F.pandas_udf(CODED + ", ids array<int>" * with_ids)
    def code(texts: pd.Series) -> pd.DataFrame:
        bpe = said.get()
        rows = []
        for text in texts:
            ids = bpe.encode(text or "")
            joined = bpe.written(ids).encode()
            back = bpe.decode(ids).encode()
            row = (len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(back).hexdigest())
            rows.append((*row, ids) if with_ids else row)
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    return code(text)

