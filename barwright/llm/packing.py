"""Packing of token sequences by first-fit decreasing.

Method: documents are dealt into randomised groups. In each group the pieces are taken from the longest to the shortest, and each
goes to the first bin that still has room. A tournament tree over the bins holds the largest free capacity of every subtree, so
that bin is found by one walk from the root. Texts longer than a bin are cut into full bins and a rest first; afterwards the
emptiest bins of the group are dissolved and poured, cut where needed, into the room left in the others.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barwright.llm import bpe
from barwright.llm.common import batch_of, map_arrow
from barwright.llm.memory import Memory

CAPACITY, CLOSING = 4096, 2
# Between the tokeniser and the packer an id takes 16 bits; a larger vocabulary is refused.
KIND, WIDTH = "<u2", 2
# Ids and documents of one group; a group larger than that is packed in several runs.
GROUP_TOKENS, GROUP_DOCS = 4 << 20, 4096
# Text bytes that a randomised group gets on average.
GROUP_BYTES = 6 << 20
# Words and parts of words that a Python worker remembers, twice.
WORDS, PARTS = 400_000, 500_000
_ODD = re.compile("[\x1c-\x1f]")
# Words of these characters lower their case and split alike here and in the vocabulary's own rules (fixed values).
_SIMPLE = re.compile("[!-~\u00a1-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u012f\u0131-\u017e]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


class FirstFit:
    """Tournament tree of free capacities: the leftmost bin with enough room in logarithmic time."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> int:
        room, node = self.room, 1
        while node < self.leaves:
            node = 2 * node if room[2 * node] >= size else 2 * node + 1
        found = node - self.leaves
        room[node] -= size
        while node > 1:
            node >>= 1
            room[node] = max(room[2 * node], room[2 * node + 1])
        return found


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document number, start, length, bin, offset) of one group, ordered by bin and offset."""
    full, rests = [], []
    for number, length in enumerate(lengths):
        whole = length // capacity
        full += [(number, i * capacity, capacity) for i in range(whole)]
        if length % capacity:
            rests.append((length % capacity, number, whole * capacity))
    rests.sort(key=lambda rest: (-rest[0], rest[1]))
    tree = FirstFit(max(1, len(rests)), capacity)
    bins: list[list[tuple[int, int, int]]] = []
    for size, number, start in rests:
        at = tree.put(size)
        if at == len(bins):
            bins.append([])
        bins[at].append((number, start, size))
    held = [sum(piece[2] for piece in one) for one in bins]
    order = sorted(range(len(bins)), key=lambda i: (-held[i], i))
    gaps = iter(order)
    target = next(gaps, None)
    while order:
        source = order[-1]
        if target is None or source == target or held[source] == capacity:
            break
        while bins[source]:
            while target is not None and target != source and held[target] == capacity:
                target = next(gaps, None)
            if target is None or target == source:
                break
            number, start, size = bins[source].pop()
            part = min(size, capacity - held[target])
            bins[target].append((number, start, part))
            held[target] += part
            held[source] -= part
            if part < size:
                bins[source].append((number, start + part, size - part))
        if bins[source]:
            break
        order.pop()
    pieces, sequence = [], 0
    for one in [[piece] for piece in full] + [one for one in bins if one]:
        offset = 0
        for number, start, size in one:
            pieces.append((number, start, size, sequence, offset))
            offset += size
        sequence += 1
    return pieces


class WordMerges(bpe.Merges):
    """The merges of a vocabulary of words: every byte is a character, and the last of a word carries a mark of the word's end."""

    kind = KIND

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        numbers, end = model["vocab"], model["end_of_word_suffix"]
        if max(numbers.values()) >= 1 << (8 * WIDTH):
            raise ValueError("ids of this vocabulary need more than 16 bits")
        # The public rule for bytes as characters: printable ones stand for themselves, the others follow from 256 on.
        plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 256 and b != 173]
        others = [b for b in range(256) if b not in plain]
        char = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.inner, self.last = (np.array([numbers[char[b] + suffix] for b in range(256)], dtype=np.int64) for suffix in ("", end))
        merges = [tuple(merge.split(" ")) if isinstance(merge, str) else tuple(merge) for merge in model["merges"]]
        self.made = np.array([numbers[a + b] for a, b in merges], dtype=np.int64)
        self.index({numbers[a] << 32 | numbers[b]: rank for rank, (a, b) in enumerate(merges)})

    def first_tokens(self, raw: np.ndarray, size: np.ndarray) -> np.ndarray:
        token = self.inner[raw]
        rows = np.arange(len(raw))
        token[rows, size - 1] = self.last[raw[rows, size - 1]]
        return token


@lru_cache(maxsize=2)
def load_tokenizer(path: str, words: int = WORDS, parts: int = PARTS):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    added = tokenizer.get_added_tokens_decoder().values()
    if any(token.normalized for token in added):
        raise ValueError("added tokens of this vocabulary are found in normalised text")
    return tokenizer, WordMerges(path), Memory(words), Memory(parts), tuple(token.content for token in added)


def encode_texts(texts: list[str], path: str, words: int = WORDS, parts: int = PARTS) -> list[bytes]:
    """Ids of whole texts, as the public library gives them. The vocabulary drops white space and never merges across it, so ids
    are looked up word by word, and unknown words part by part; words beyond plain Latin letters are left to the library."""
    tokenizer, merges, known_words, known_parts, added = load_tokenizer(path, words, parts)

    def library(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype=KIND).tobytes()

    def merge(parts: list[str]) -> list[tuple[str, bytes]]:
        raw = [part.encode() for part in parts]
        ids = bpe.merge_all(raw, merges)
        return list(zip(parts, map(ids.__getitem__, raw)))

    def encode_words(words: list[str]) -> Iterator[tuple[str, bytes]]:
        plain = words if _SIMPLE.fullmatch("".join(words)) else [word for word in words if _SIMPLE.fullmatch(word)]
        low = " ".join(plain).lower().split(" ") if plain else []
        # A word of letters is one part; only the others have to be split.
        whole = [word.isalpha() for word in low]
        split = [None if one else _PARTS.findall(word) for word, one in zip(low, whole)]
        wanted = {word for word, one in zip(low, whole) if one}.union(*[own for own in split if own])
        parts = known_parts.fill(wanted, merge)
        yield from ((name, parts[word] if own is None else b"".join(map(parts.__getitem__, own))) for name, word, own in zip(plain, low, split))
        if len(plain) < len(words):
            yield from ((word, library(word)) for word in set(words).difference(plain))

    words = [None if _ODD.search(text) or any(token in text for token in added) else text.split() for text in texts]
    known = known_words.fill(set().union(*[own for own in words if own]), encode_words)
    # Some ASCII separators are white space for Python and not for the vocabulary, and added tokens are cut out of the text before
    # anything else: such texts go to the library whole.
    return [library(text) if own is None else b"".join(map(known.__getitem__, own)) for text, own in zip(texts, words)]


def tokenise(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", words: int = WORDS, parts: int = PARTS) -> DataFrame:
    """Rows (key, ids): little-endian 16-bit ids of the whole text and the closing id; a null or empty text has the closing id only.

    `words` and `parts` are how many of them a Python worker remembers: fewer take less memory and more time, results are the same.
    """
    closing = CLOSING.to_bytes(WIDTH, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [own + closing for own in encode_texts([value or "" for value in batch.column(1).to_pylist()], path, words, parts)]
            yield batch_of((key, "ids"), (batch.column(0), pa.array(ids, type=pa.binary())))

    return map_arrow(df.select(F.col(key).cast("bigint").alias(key), text), run, f"`{key}` bigint, ids binary")


def pack(tokens: DataFrame, groups: int, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Pieces (key, start, length, ids, doc_tokens, sequence_id, offset) of rows (key, ids); the ids of pieces are little-endian 32-bit.

    Each id lies in exactly one piece, offsets are gapless, no sequence exceeds the capacity. Repeated and null keys are documents
    of their own. A group is read in order of the key and packed whenever it holds GROUP_TOKENS ids or GROUP_DOCS documents, so a
    task never holds more than that and one document, whatever the number of rows with one key.
    """
    names = (key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    dealt = tokens.select(F.pmod(F.xxhash64(F.lit("pack"), F.col(key)), F.lit(groups)).alias("group"), key, "ids")
    parts = max(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(groups // 4, 8192), 1)
    dealt = dealt.repartition(parts, "group").sortWithinPartitions("group", key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, base, keys, rows, held = None, 0, [], [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            pieces = pack_lengths([len(row) // WIDTH for row in rows], capacity)
            for start in range(0, len(pieces), 512):
                some = pieces[start:start + 512]
                columns = ([keys[n] for n, *_ in some], [s for _, s, *_ in some], [size for _, _, size, *_ in some], [np.frombuffer(rows[n], KIND, size, WIDTH * s).astype("<u4").tobytes() for n, s, size, *_ in some],
                           [len(rows[n]) // WIDTH for n, *_ in some], [group * (1 << 24) + base + b for *_, b, _ in some], [o for *_, o in some])
                yield batch_of(names, [pa.array(column, type=kind) for column, kind in zip(columns, kinds)])

        for batch in batches:
            for number, one, ids in zip(*(column.to_pylist() for column in batch.columns)):
                if rows and (number != group or held >= GROUP_TOKENS or len(rows) >= GROUP_DOCS):
                    yield from packed()
                    # Bins of the group so far: never more than its ids over half a capacity, and one.
                    base = base + 2 * (held // capacity) + len(rows) + 1 if number == group else 0
                    keys, rows, held = [], [], 0
                elif number != group:
                    base = 0
                group = number
                keys.append(one)
                rows.append(ids)
                held += len(ids) // WIDTH
        if rows:
            yield from packed()

    return map_arrow(dealt, run, f"`{key}` bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def group_count(df: DataFrame, text: str = "text") -> int:
    size = df.agg(F.sum(F.octet_length(text) + 2).alias("bytes")).first()["bytes"] or 0
    return max(1, int(size // GROUP_BYTES))
