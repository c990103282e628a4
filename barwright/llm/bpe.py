"""Byte-level BPE encoding and decoding.

Method: a segment tree over the byte positions of a piece stores, per node, the leftmost pair of least rank. A merge
changes three leaves (the merged position, its live left neighbour and the swallowed right neighbour) and repairs their paths
to the root. Short pieces are merged many at a time: one numpy array holds the trees of all pieces of a length class, and each
step takes the root of every unfinished tree. Long pieces use the same tree one at a time.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from barwright.llm.common import batch_of, map_arrow
from barwright.llm.memory import Memory

NONE = np.int64(1) << 62
# Ranks take the bits above; 40 bits of positions leave 22 for ranks.
POSITION_BITS = 40
# Pieces up to this many bytes are merged in arrays; longer ones alone.
SHORT = 64
# Chunks that a Python worker remembers, twice.
REMEMBERED = 400_000
# Characters of text whose unknown chunks are encoded together.
SLICE = 1_000_000
# White space of Unicode; Python's own classes also count four separators of ASCII.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# A run without white space and the blank before it; pieces never cross these chunks.
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


class Merges:
    """Ranks of pairs of tokens, and the token that a merge of each rank makes."""

    #: None: the rank is the token's number.
    made: np.ndarray | None = None
    #: How a token's number is written.
    kind = "<u4"

    def index(self, pairs: dict[int, int]) -> None:
        """pairs: rank of each pair, keyed by left << 32 | right."""
        self.pairs = pairs
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        if max(pairs.values(), default=0) >= 1 << (62 - POSITION_BITS):
            raise ValueError("more merges than ranks fit beside positions")
        order = np.argsort(keys)
        self.keys = np.append(keys[order], NONE)
        self.merged = np.append(np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))[order], NONE)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def first_tokens(self, raw: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of the single bytes of pieces (rows) of the given sizes."""
        raise NotImplementedError


class Ranks(Merges):
    """The vocabulary of one rank file and the ranks of all pairs of its tokens."""

    def __init__(self, lines: list[bytes], pattern: str):
        self.rank = {base64.b64decode(token): int(number) for token, number in (line.split() for line in lines if line.strip())}
        self.pattern = regex.compile(pattern.replace("[^\\s", f"[^{WHITE}").replace("\\S", f"[^{WHITE}]").replace("\\s", f"[{WHITE}]"))
        self.bytes = [b""] * (max(self.rank.values()) + 1)
        for token, number in self.rank.items():
            self.bytes[number] = token
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, number in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = number
        self.index(pairs)
        self.known = Memory(REMEMBERED)

    def first_tokens(self, raw: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.of_byte[raw]


@lru_cache(maxsize=4)
def load_ranks(path: str, pattern: str) -> Ranks:
    with open(path, "rb") as file:
        return Ranks(file.readlines(), pattern)


def merge_short(pieces: list[bytes], ranks: Merges, leaves: int) -> list[bytes]:
    """All pieces of at most `leaves` (a power of two) bytes; per piece its ids as little-endian 32-bit integers."""
    n = len(pieces)
    size = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
    raw = np.frombuffer(b"".join(piece.ljust(leaves, b"\0") for piece in pieces), dtype=np.uint8).reshape(n, leaves)
    token = ranks.first_tokens(raw, size)
    column = np.arange(leaves)
    following = np.broadcast_to(column + 1, (n, leaves)).copy()
    before = np.broadcast_to(column - 1, (n, leaves)).copy()
    live = column < size[:, None]
    tree = np.full((n, 2 * leaves), NONE, dtype=np.int64)
    first = np.where(column[:-1] + 1 < size[:, None], ranks.pair_rank(token[:, :-1], token[:, 1:]), NONE)
    tree[:, leaves:2 * leaves - 1] = np.where(first < NONE, first << POSITION_BITS | column[:-1], NONE)
    for node in range(leaves - 1, 0, -1):
        np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
    rows = np.arange(n)
    while True:
        root = tree[rows, 1]
        rows, root = rows[root < NONE], root[root < NONE]
        if not len(rows):
            break
        at = root & ((1 << POSITION_BITS) - 1)
        gone = following[rows, at]
        after = following[rows, gone]
        rank = root >> POSITION_BITS
        token[rows, at] = rank if ranks.made is None else ranks.made[rank]
        live[rows, gone] = False
        following[rows, at] = after
        inside = after < size[rows]
        before[rows[inside], after[inside]] = at[inside]
        right = np.where(inside, after, 0)
        rank = np.where(inside, ranks.pair_rank(token[rows, at], token[rows, right]), NONE)
        tree[rows, leaves + at] = np.where(rank < NONE, rank << POSITION_BITS | at, NONE)
        tree[rows, leaves + gone] = NONE
        previous = before[rows, at]
        has = previous >= 0
        left_rows, left = rows[has], previous[has]
        rank = ranks.pair_rank(token[left_rows, left], token[left_rows, at[has]])
        tree[left_rows, leaves + left] = np.where(rank < NONE, rank << POSITION_BITS | left, NONE)
        touched = np.concatenate([rows, rows, left_rows])
        node = np.concatenate([at, gone, left]) + leaves
        while leaves > 1 and node[0] > 1:
            node = node >> 1
            tree[touched, node] = np.minimum(tree[touched, 2 * node], tree[touched, 2 * node + 1])
    ends = np.cumsum(live.sum(axis=1)) * int(ranks.kind[-1])
    packed = token[live].astype(ranks.kind).tobytes()
    return [packed[start:end] for start, end in zip(np.concatenate([[0], ends[:-1]]), ends)]


def merge_long(piece: bytes, ranks: Merges) -> bytes:
    """One piece of any length on the same tree, kept in lists."""
    n = len(piece)
    if n > 1 << POSITION_BITS:
        raise ValueError("a piece longer than its positions can say")
    leaves = 1 << max(1, (n - 1).bit_length())
    token = ranks.first_tokens(np.frombuffer(piece, dtype=np.uint8)[None], np.array([n]))[0].tolist()
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    none, pairs = int(NONE), ranks.pairs
    tree = [none] * (2 * leaves)

    def leaf(left: int, right: int) -> int:
        rank = pairs.get(token[left] << 32 | token[right]) if right < n else None
        return none if rank is None else rank << POSITION_BITS | left

    for i in range(n):
        tree[leaves + i] = leaf(i, i + 1)
    for node in range(leaves - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def repair(position: int, key: int) -> None:
        node = leaves + position
        tree[node] = key
        while node > 1:
            node >>= 1
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                break
            tree[node] = least

    while tree[1] < none:
        at = tree[1] & ((1 << POSITION_BITS) - 1)
        gone = following[at]
        after = following[gone]
        rank = tree[1] >> POSITION_BITS
        token[at] = rank if ranks.made is None else int(ranks.made[rank])
        following[at] = after
        if after < n:
            before[after] = at
        repair(gone, none)
        repair(at, leaf(at, after))
        if before[at] >= 0:
            repair(before[at], leaf(before[at], at))
    ids, at = [], 0
    while at < n:
        ids.append(token[at])
        at = following[at]
    return np.array(ids, dtype=ranks.kind).tobytes()


def merge_all(pieces: list[bytes], ranks: Merges) -> dict[bytes, bytes]:
    """Ids of distinct pieces of any lengths."""
    out: dict[bytes, bytes] = {}
    classes: dict[int, list[bytes]] = {}
    for piece in pieces:
        if len(piece) > SHORT:
            out[piece] = merge_long(piece, ranks)
        else:
            classes.setdefault(1 << max(1, (len(piece) - 1).bit_length()), []).append(piece)
    for leaves, members in classes.items():
        for start in range(0, len(members), 4096):
            some = members[start:start + 4096]
            out.update(zip(some, merge_short(some, ranks, leaves)))
    return out


def merge_pieces(pieces: list[bytes], ranks: Ranks) -> dict[bytes, bytes]:
    """Ids of each distinct piece; a piece that is itself a token keeps its own id, as the public library does."""
    distinct = dict.fromkeys(pieces)
    out = {piece: ranks.rank[piece].to_bytes(4, "little") for piece in distinct if piece in ranks.rank}
    return out | merge_all([piece for piece in distinct if piece not in out], ranks)


def encode_texts(texts: list[str], ranks: Ranks) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers. Chunks met before in this worker are looked up."""
    chunks = [CHUNK.findall(text) for text in texts]

    def make(new: list[str]) -> list[tuple[str, bytes]]:
        split = {chunk: [piece.encode() for piece in ranks.pattern.findall(chunk)] for chunk in new}
        ids = merge_pieces([piece for pieces in split.values() for piece in pieces], ranks)
        return [(chunk, b"".join(map(ids.__getitem__, pieces))) for chunk, pieces in split.items()]

    known = ranks.known.fill(set().union(*chunks), make)
    return [b"".join(map(known.__getitem__, own)) for own in chunks]


def slices(texts: list[str], limit: int = SLICE) -> Iterator[list[str]]:
    """Consecutive texts, about `limit` characters at a time."""
    some, held = [], 0
    for text in texts:
        some.append(text)
        held += len(text)
        if held >= limit:
            yield some
            some, held = [], 0
    if some:
        yield some


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, ids): ids are the token numbers of the whole text as little-endian unsigned 32-bit integers.

    A null or empty text has no ids. Rows are independent: repeated keys and null keys stay as they are; other columns are not
    read. The rank file lies on every machine.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path, pattern)
        for batch in batches:
            texts = [value or "" for value in batch.column(1).to_pylist()]
            ids = [row for some in slices(texts) for row in encode_texts(some, ranks)]
            yield batch_of((key, "ids"), (batch.column(0), pa.array(ids, type=pa.binary())))

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(df.select(key, text), run, f"`{key}` {kind}, ids binary")


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """Rows (key, ids, decoded): the bytes of the tokens, joined. Null ids decode to nothing; an id outside the vocabulary fails."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = load_ranks(path, pattern).bytes
        for batch in batches:
            rows = [np.frombuffer(value or b"", dtype="<u4").tolist() for value in batch.column(1).to_pylist()]
            yield batch_of((key, "ids", "decoded"), (batch.column(0), batch.column(1), pa.array([b"".join(map(tokens.__getitem__, row)) for row in rows], type=pa.binary())))

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(df.select(key, ids), run, f"`{key}` {kind}, ids binary, decoded binary")
