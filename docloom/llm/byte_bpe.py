"""Byte-level BPE encoding and decoding.

A segment tree over the byte positions of a piece stores the leftmost pair of
minimum rank: leaf i holds rank * width + i of the pair that starts at i, and
each node the minimum of its children, so the root names the next merge. A
merge changes three leaves (the pair itself, the pair before it, and the one
that vanishes), and so three paths of logarithmic length. Short pieces are
merged many at a time, one tree to a row of a matrix; long ones one by one.

Pieces are the matches of the split pattern. No match runs over the border
between a non-space and a single space, so texts without runs of white space
are cut at spaces first, and what a word gives is kept in a bounded cache.

Null texts count as empty: no tokens, the digest of no bytes. Repeated rows are
encoded alike. Only doc_id and text are read, so other columns cannot clash.
Texts and pieces of any length are encoded whole.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import groups, keep, map_arrow, record_batch

NONE = np.int32(1 << 30)  # above rank * width + place at a width of LONG
NO_PAIR = 1 << 62  # the same for pieces of any length
LONG = 128
CACHED_WORDS, CACHED_CHARS = 700_000, 8_000_000
#: What the regex library or re may take for white space, twice.
RUN = re.compile(r"[\s\x1c-\x1f\x85]{2}")


class ByteBpe:
    """Encoder and decoder for a file of base64 tokens and ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.by_text = {str(rank): token for rank, token in self.tokens.items()}
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        self.words: dict[str, str] = {}
        self.cached_chars = 0

    @staticmethod
    def at(path: str, pattern: str) -> ByteBpe:
        return keep(("bpe", path, pattern), lambda: ByteBpe(path, pattern))

    # --- merging -------------------------------------------------------
    def merge_long(self, piece: bytes) -> list[int]:
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        ids, pairs, none = [int(self.byte_ids[b]) for b in piece], self.pairs, NO_PAIR
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            if (rank := pairs.get(ids[i] << 20 | ids[i + 1])) is not None:
                tree[width + i] = rank * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = width + i
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        def pair(i: int, j: int) -> int:
            rank = pairs.get(ids[i] << 20 | ids[j])
            return none if rank is None else rank * width + i

        while (top := tree[1]) < none:
            rank, i = divmod(top, width)
            gone = after[i]
            ids[i], ids[gone] = rank, -1
            follow = after[i] = after[gone]
            put(gone, none)
            if follow < n:
                before[follow] = i
                put(i, pair(i, follow))
            else:
                put(i, none)
            if before[i] >= 0:
                put(before[i], pair(before[i], i))
        return [x for x in ids if x >= 0]

    def pair_values(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """rank * width + at of each pair, NONE without a rank."""
        key = left.astype(np.int64) << 20 | right
        found = self.pair_keys.searchsorted(key)
        found[found == len(self.pair_keys)] = 0
        values = self.pair_ranks.take(found) * width + at
        values[self.pair_keys.take(found) != key] = NONE
        return values

    def merge_rows(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """All pieces at once; each has width bytes at most, and width is a power of two. The matrices are kept flat."""
        count, levels = len(pieces), width.bit_length() - 1
        lengths = np.array([len(p) for p in pieces], np.int32)
        place = np.arange(width, dtype=np.int32)
        inside = place < lengths[:, None]
        raw = np.zeros((count, width), np.uint8)
        raw[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.byte_ids.take(raw)
        trees = np.full((count, 2 * width), NONE)
        paired = inside[:, 1:]
        trees[:, width : 2 * width - 1][paired] = self.pair_values(ids[:, :-1][paired], ids[:, 1:][paired], np.tile(place[:-1], (count, 1))[paired], width)
        node = width
        while node > 1:
            np.minimum(trees[:, node : 2 * node : 2], trees[:, node + 1 : 2 * node : 2], out=trees[:, node // 2 : node])
            node //= 2
        after, before = np.tile(place + 1, count), np.tile(place - 1, count)
        live, ids, tree = inside.ravel().copy(), ids.ravel(), trees.ravel()
        row = np.arange(count)
        while True:
            top = tree.take(row * (2 * width) + 1)
            on = top < NONE
            row, top = row[on], top[on]
            if not len(row):
                break
            rank, i = top >> levels, top & (width - 1)
            base, root = row * width, row * (2 * width)
            here = base + i
            gone = after.take(here)
            follow = after.take(base + gone)
            ids[here], after[here] = rank, follow
            live[base + gone] = False
            tree[root + width + gone] = NONE
            tree[root + width + i] = NONE
            if len(has := np.flatnonzero(follow < lengths.take(row))):
                next_to = base[has] + follow[has]
                before[next_to] = i[has]
                tree[root[has] + width + i[has]] = self.pair_values(rank[has], ids.take(next_to), i[has], width)
            ahead = before.take(here)
            if len(has := np.flatnonzero(ahead >= 0)):
                prior = ahead[has]
                tree[root[has] + width + prior] = self.pair_values(ids.take(base[has] + prior), rank[has], prior, width)
            for leaf, at in ((gone, root), (i, root), (ahead[has], root[has])):
                node = (width + leaf) >> 1
                for _ in range(levels):
                    both = at + 2 * node
                    tree[at + node] = np.minimum(tree.take(both), tree.take(both + 1))
                    node = node >> 1
        flat, begin, out = ids[live].tolist(), 0, []
        for end in live.reshape(count, width).sum(1).cumsum().tolist():
            out.append(flat[begin:end])
            begin = end
        return out

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, list[int]]:
        out, by_width = {}, {}
        for piece in pieces:
            if (rank := self.ranks.get(piece)) is not None:
                out[piece] = [rank]
            elif len(piece) > LONG:
                out[piece] = self.merge_long(piece)
            else:
                by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(piece)
        for width, some in by_width.items():
            step = max(1, (1 << 16) // width)
            for k in range(0, len(some), step):
                part = some[k : k + step]
                out.update(zip(part, self.merge_rows(part, width), strict=True))
        return out

    # --- texts ----------------------------------------------------------
    def learn(self, chunks: list[str]) -> None:
        """Put the ids of these chunks, joined by commas, into the cache of words."""
        split = list(map(self.pattern.findall, chunks))
        distinct = list({p for pieces in split for p in pieces})
        raw = [p.encode() for p in distinct]
        ids = self.encode_pieces(raw)
        joined = {p: ",".join(map(str, ids[r])) for p, r in zip(distinct, raw, strict=True)}
        self.words.update((c, joined[pieces[0]] if len(pieces) == 1 else ",".join([joined[p] for p in pieces])) for c, pieces in zip(chunks, split, strict=True))

    def chunks(self, text: str) -> list[str]:
        """Parts of the text that are encoded alike alone and in their place."""
        if not text:
            return []
        if RUN.search(text):
            return self.pattern.findall(text)
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + w for w in rest]

    def encode_texts(self, texts: list[str]) -> list[str]:
        """Per text its ids, joined by commas."""
        cut = list(map(self.chunks, texts))
        wanted = set().union(*cut)
        missing = [c for c in wanted if c not in self.words]
        self.cached_chars += sum(map(len, missing))
        if len(self.words) + len(missing) > CACHED_WORDS or self.cached_chars > CACHED_CHARS:
            self.words.clear()
            missing = list(wanted)
            self.cached_chars = sum(map(len, missing))
        self.learn(missing)
        known = self.words.__getitem__
        return [",".join(map(known, chunks)) for chunks in cut]

    def decode_joined(self, ids: str) -> bytes:
        return b"".join(map(self.by_text.__getitem__, ids.split(","))) if ids else b""

    def encode(self, text: str) -> list[int]:
        ids = self.encode_texts([text])[0]
        return [int(i) for i in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


def byte_bpe(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int, empty for no text) and decoded (binary) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # many small objects, no cycles
        coder = ByteBpe.at(path, pattern)
        for part, texts in groups(batches):
            got = coder.encode_texts(texts)
            ids = [np.array(g.split(","), np.int32) if g else np.empty(0, np.int32) for g in got]
            yield record_batch({"doc_id": part.column(0), "ids": ids, "decoded": list(map(coder.decode_joined, got))}, {"doc_id": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.binary()})

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids array<int>, decoded binary", keeps=True)


def byte_bpe_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 digests of the comma-joined ids and of the bytes decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # many small objects, no cycles
        coder = ByteBpe.at(path, pattern)
        for part, texts in groups(batches):
            got = coder.encode_texts(texts)
            sha = lambda data: hashlib.sha256(data).hexdigest()
            yield record_batch(
                {"doc_id": part.column(0), "n_tokens": [g.count(",") + bool(g) for g in got], "ids_sha256": [sha(g.encode()) for g in got], "decoded_sha256": [sha(coder.decode_joined(g)) for g in got]},
                {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()},
            )

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", keeps=True)
