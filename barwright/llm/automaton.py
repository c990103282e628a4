"""BPE encoding and decoding by a tokenization automaton.

Method: the merges are compiled, in order, into a deterministic automaton over tokens that accepts exactly one way to write every
byte string: the one that BPE gives. It starts as one state with an arc for every byte. The gadget of a merge (u, v) adds arcs for
the new token wherever u and then v could be read, leading where v led, and splits the state that u leads to: u leads to a copy
without the arc v. A state is thus its parent and one arc taken away. Because the new token may stand wherever u may, an arc taken
away takes the later tokens that begin with it along; with tokens numbered in post-order of their beginnings these are one interval,
and a state is a short sorted row of forbidden intervals.

A word is encoded by reading arcs from every position: each position is reached by one arc alone, and the arcs that end at the end
of the word, followed back, are its tokens. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from barwright.llm.bpe import CHUNK, WHITE, slices
from barwright.llm.common import batch_of, map_arrow
from barwright.llm.memory import Memory

# Words up to this many bytes are read many at a time; longer ones alone.
SHORT = 48
# Words read together; chunks that a Python worker remembers, twice.
TOGETHER, REMEMBERED = 4096, 400_000


class Automaton:
    """States, arcs and labels of a vocabulary: `labels` bytes per token number, `merges` pairs of token numbers and what they make."""

    def __init__(self, labels: dict[int, bytes], singles: list[int], merges: list[tuple[int, int, int]]):
        if len({made for _, _, made in merges} | set(singles)) < len(merges) + len(singles):
            raise ValueError("a token of this vocabulary is made in several ways")
        self.labels = labels
        self.made: dict[tuple[int, int], int] = {}
        # How a token was made: (rank, beginning, end); single bytes were there before all ranks.
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.leads = dict.fromkeys(singles, 0)
        self.states: list[tuple[int, int, int]] = [(-1, -1, -1)]
        for rank, (u, v, w) in enumerate(merges):
            self.gadget(rank, u, v, w)
        self.compile_rows()
        self.compile_trie()

    def gadget(self, rank: int, u: int, v: int, w: int) -> None:
        """Arcs of the token w = uv, and the split of the state that u leads to. A pair that can never be read adds no arc."""
        if u not in self.leads or v not in self.leads or not self.readable(u, v):
            return
        self.leads[w] = self.leads[v]
        self.states.append((self.leads[u], v, rank))
        self.leads[u] = len(self.states) - 1
        self.made[u, v] = rank
        self.parts[w] = (rank, u, v)

    def readable(self, u: int, v: int) -> bool:
        """Whether the arc v leaves the state that u leads to: no merge of an end of u and a beginning of v came before they grew."""
        left, before_left = u, float("inf")
        while True:
            right, before_right = v, float("inf")
            while True:
                rank = self.made.get((left, right))
                if rank is not None and rank < before_left and rank <= before_right:
                    return False
                if right not in self.parts:
                    break
                before_right, right, _ = self.parts[right]
            if left not in self.parts:
                return True
            before_left, _, left = self.parts[left]

    def compile_rows(self) -> None:
        """Sorted forbidden intervals of every state in use, as one table keyed by state * width + column."""
        begins: dict[int, list[int]] = {}
        for token, (_, u, _) in self.parts.items():
            begins.setdefault(u, []).append(token)
        column, first, number = {}, {}, 0
        for root in [token for token in self.leads if token not in self.parts]:
            stack = [(root, False)]
            while stack:
                token, done = stack.pop()
                if done:
                    column[token] = number
                    number += 1
                else:
                    first[token] = number
                    stack.append((token, True))
                    # Tokens in the order of their ranks, so the later ones and the token itself are one interval.
                    stack += [(child, False) for child in reversed(begins.get(token, []))]
        ranks = {token: [self.parts[child][0] for child in own] for token, own in begins.items()}

        def interval(token: int, rank: int) -> tuple[int, int]:
            later = bisect_left(ranks.get(token, []), rank)
            return (first[begins[token][later]] if later < len(begins.get(token, [])) else column[token]), column[token]

        used = sorted(set(self.leads.values()) | {0})
        place = {state: i for i, state in enumerate(used)}
        width = number + 1
        low, high = [], []
        for state in used:
            row, at = [], state
            while at:
                parent, token, rank = self.states[at]
                row.append(interval(token, rank))
                at = parent
            row.sort()
            base, end = place[state] * width, -1
            for a, b in row:
                if a > end:
                    low.append(base + a)
                    high.append(base + b)
                elif b > end:
                    high[-1] = base + b
                end = max(end, b)
        self.width, self.start = width, place[0]
        self.low, self.high = [-1, *low], [-1, *high]
        self.low_table, self.high_table = np.array(self.low, dtype=np.int64), np.array(self.high, dtype=np.int64)
        size = max(self.leads) + 1
        self.column, self.target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for token, state in self.leads.items():
            self.column[token], self.target[token] = column[token], place[state]
        self.columns, self.targets = self.column.tolist(), self.target.tolist()

    def compile_trie(self) -> None:
        """Labels of all arcs as a tree of bytes: next[node << 8 | byte] and the token that ends at a node."""
        self.next: dict[int, int] = {}
        self.ends = [-1]
        for token in self.leads:
            node = 0
            for byte in self.labels[token]:
                key = node << 8 | byte
                node = self.next.get(key)
                if node is None:
                    node = self.next[key] = len(self.ends)
                    self.ends.append(-1)
            self.ends[node] = token
        keys = np.fromiter(self.next, dtype=np.int64, count=len(self.next))
        order = np.argsort(keys)
        self.next_keys = np.append(keys[order], np.int64(1) << 62)
        self.next_nodes = np.append(np.fromiter(self.next.values(), dtype=np.int64, count=len(self.next))[order], 0)
        self.ends_table = np.array(self.ends, dtype=np.int64)

    def read_short(self, words: list[bytes]) -> list[bytes]:
        """Tokens of words of at most SHORT bytes, all read side by side; per word little-endian 32-bit numbers."""
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        size = np.array([len(words[i]) for i in order], dtype=np.int64)
        longest = int(size[0]) if len(size) else 0
        raw = np.frombuffer(b"".join(words[i].ljust(longest, b"\0") for i in order), dtype=np.uint8).reshape(len(words), longest).astype(np.int64)
        state = np.full((len(words), longest + 1), self.start, dtype=np.int64)
        arc = np.zeros((len(words), longest + 1), dtype=np.int64)
        for i in range(longest):
            rows = np.arange(np.searchsorted(-size, -i))
            node = np.zeros(len(rows), dtype=np.int64)
            for j in range(i, longest):
                rows, node = rows[size[rows] > j], node[size[rows] > j]
                key = node << 8 | raw[rows, j]
                at = np.searchsorted(self.next_keys, key)
                met = self.next_keys[at] == key
                rows, node = rows[met], self.next_nodes[at[met]]
                if not len(rows):
                    break
                token = self.ends_table[node]
                is_end = token >= 0
                own, token = rows[is_end], token[is_end]
                key = state[own, i] * self.width + self.column[token]
                free = self.high_table[np.searchsorted(self.low_table, key, side="right") - 1] < key
                own, token = own[free], token[free]
                state[own, j + 1] = self.target[token]
                arc[own, j + 1] = token
        out: list[bytes] = [b""] * len(words)
        lengths = {token: len(self.labels[token]) for token in set(arc.ravel().tolist()) if token in self.leads}
        for place, i in enumerate(order):
            ids, own, at = [], arc[place].tolist(), len(words[i])
            while at:
                ids.append(own[at])
                at -= lengths[own[at]]
            out[i] = np.array(ids[::-1], dtype="<u4").tobytes()
        return out

    def read_long(self, word: bytes) -> bytes:
        """Tokens of one word of any length."""
        n = len(word)
        state, arc = array("q", bytes(8 * (n + 1))), array("q", bytes(8 * (n + 1)))
        state[0] = self.start
        step, ends, low, high, width = self.next, self.ends, self.low, self.high, self.width
        column, target = self.columns, self.targets
        for i in range(n):
            base, node = state[i] * width, 0
            for j in range(i, n):
                node = step.get(node << 8 | word[j])
                if node is None:
                    break
                token = ends[node]
                if token >= 0:
                    key = base + column[token]
                    if high[bisect_right(low, key) - 1] < key:
                        state[j + 1], arc[j + 1] = target[token], token
        ids, at = [], n
        while at:
            ids.append(arc[at])
            at -= len(self.labels[ids[-1]])
        return np.array(ids[::-1], dtype="<u4").tobytes()

    def read(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Tokens of distinct words."""
        out = {word: self.read_long(word) for word in words if len(word) > SHORT}
        short = sorted((word for word in words if len(word) <= SHORT), key=len)
        for start in range(0, len(short), TOGETHER):
            some = short[start:start + TOGETHER]
            out.update(zip(some, self.read_short(some)))
        return out


class TokenizerFile:
    """What a tokenizer file says: labels (bytes) per token number, numbers of single bytes, merges, and added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        model, added = said["model"], said["added_tokens"]
        if said["normalizer"] or said["pre_tokenizer"].get("type") != "ByteLevel" or said["pre_tokenizer"]["add_prefix_space"] or any(
                token[flag] for token in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only byte-level vocabularies without normalizer and with plain added tokens are read")
        # The public rule for bytes as characters: printable ones stand for themselves, the others follow from 256 on.
        plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 256 and b != 173]
        others = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        numbers = model["vocab"]
        self.special = {token["content"]: token["id"] for token in added}
        self.arcs = {number: bytes(map(byte.__getitem__, token)) for token, number in numbers.items() if token not in self.special}
        self.labels = self.arcs | {number: token.encode() for token, number in self.special.items()}
        self.singles = [numbers[char] for char in byte]
        pairs = [tuple(merge.split(" ")) if isinstance(merge, str) else tuple(merge) for merge in model["merges"]]
        self.merges = [(numbers[a], numbers[b], numbers[a + b]) for a, b in pairs]


class Tokenizer:
    """The automaton of a tokenizer file, the split into words ahead of it, and added tokens, which are cut out of a text first."""

    def __init__(self, path: str, pattern: str):
        file = TokenizerFile(path)
        self.automaton = Automaton(file.arcs, file.singles, file.merges)
        self.special = {token: np.array([number], dtype="<u4").tobytes() for token, number in file.special.items()}
        # The longest of the added tokens that begin at one place is cut out.
        self.cuts = regex.compile("|".join(regex.escape(token) for token in sorted(file.special, key=len, reverse=True))) if file.special else None
        self.pattern = regex.compile(pattern.replace("[^\\s", f"[^{WHITE}").replace("\\S", f"[^{WHITE}]").replace("\\s", f"[{WHITE}]"))
        self.known = Memory(REMEMBERED)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers. Chunks met before in this worker are looked up."""
        def spans(text: str) -> list[str]:
            """Stretches between added tokens, and the added tokens in their places (every second one)."""
            if not any(token in text for token in self.special):
                return [text]
            out, at = [], 0
            for cut in self.cuts.finditer(text):
                out += [text[at:cut.start()], cut.group()]
                at = cut.end()
            return [*out, text[at:]]

        def make(new: list[str]) -> list[tuple[str, bytes]]:
            split = {chunk: [word.encode() for word in self.pattern.findall(chunk)] for chunk in new}
            ids = self.automaton.read(list({word for words in split.values() for word in words}))
            return [(chunk, b"".join(map(ids.__getitem__, words))) for chunk, words in split.items()]

        cut = [spans(text) for text in texts]
        chunks = [[CHUNK.findall(span) for span in own[::2]] for own in cut]
        known = self.known.fill({chunk for own in chunks for span in own for chunk in span}, make)
        out = []
        for own, spans_of in zip(cut, chunks):
            ids = [b"".join(map(known.__getitem__, span)) for span in spans_of]
            out.append(ids[0] + b"".join(self.special[token] + after for token, after in zip(own[1::2], ids[1:])))
        return out


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Tokenizer:
    return Tokenizer(path, pattern)


@lru_cache(maxsize=2)
def load_labels(path: str) -> dict[int, bytes]:
    return TokenizerFile(path).labels


def spell(ids: bytes, labels: dict[int, bytes]) -> str:
    """The labels of the arcs, joined. Bytes that are no UTF-8 become replacement characters."""
    return b"".join(map(labels.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, ids): ids are the token numbers of the whole text as little-endian unsigned 32-bit integers.

    A null or empty text has no ids. The strings of added tokens become those tokens. Rows are independent: repeated and null keys stay
    as they are; other columns are not read. The tokenizer file lies on every machine, and each Python worker compiles it once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path, pattern)
        for batch in batches:
            texts = [value or "" for value in batch.column(1).to_pylist()]
            ids = [row for some in slices(texts) for row in tokenizer.encode(some)]
            yield batch_of((key, "ids"), (batch.column(0), pa.array(ids, type=pa.binary())))

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(df.select(key, text), run, f"`{key}` {kind}, ids binary")


def decode(df: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """Rows (key, ids, decoded): the text that the tokens spell. Null ids decode to nothing; an id outside the vocabulary fails."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = load_labels(path)
        for batch in batches:
            texts = [spell(value or b"", labels) for value in batch.column(1).to_pylist()]
            yield batch_of((key, "ids", "decoded"), (batch.column(0), batch.column(1), pa.array(texts, type=pa.string())))

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(df.select(key, ids), run, f"`{key}` {kind}, ids binary, decoded string")
