"""Tokenization automaton, blocked lexical search, vector codes on small tables."""

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest

from barwright.llm import automaton, codes, lexical

from test_texts import ODD, noise

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def plain_bpe(text: bytes, merges):
    tokens = list(text)
    while True:
        ranked = [(rank, i) for i in range(len(tokens) - 1) for rank, (u, v, _) in enumerate(merges) if (u, v) == (tokens[i], tokens[i + 1])]
        if not ranked:
            return tokens
        rank, at = min(ranked)
        tokens[at:at + 2] = [merges[rank][2]]


def random_merges(rng, letters, count):
    """Merges in an order that no training would give, so that some can never be read."""
    labels, merges = {b: bytes([b]) for b in letters}, []
    while len(merges) < count:
        u, v = rng.choice(list(labels)), rng.choice(list(labels))
        label = labels[u] + labels[v]
        if label not in labels.values() and len(label) < 9:
            labels[256 + len(merges)] = label
            merges.append((u, v, 256 + len(merges)))
    return labels, merges


@pytest.mark.parametrize("seed", range(12))
def test_automaton_equals_plain_merging(seed):
    rng = random.Random(seed)
    letters = b"ab" if seed % 2 else b"abcd"
    labels, merges = random_merges(rng, letters, rng.randint(1, 30))
    machine = automaton.Automaton(labels, list(letters), merges)
    words = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(300)] + [letters[:1] * n for n in range(1, 60)]
    expected = [plain_bpe(word, merges) for word in words]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in machine.read_short(words)] == expected
    assert [np.frombuffer(machine.read_long(word), "<u4").tolist() for word in words] == expected


def test_automaton_refuses_tokens_made_twice():
    with pytest.raises(ValueError):
        automaton.Automaton({97: b"a", 1: b"aa", 2: b"aaa"}, [97], [(97, 97, 1), (97, 1, 2), (1, 97, 2)])


def test_automaton_operator_equals_the_public_library(spark):
    from tokenizers import Tokenizer
    public = Tokenizer.from_file(TOKENIZER)
    texts = ODD + noise() + ["a<|endoftext|>b", "<|endoftext|><|endoftext|>", "x <|endoftext|> y\n", "<|ENDOFTEXT|>", "".join(map(chr, range(1, 0x3000, 7))), "zxq" * 500, "the" * 400]
    rows = [(i if i % 5 else None, text, "x", 1) for i, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, decoded int")
    ids = automaton.encode(frame, TOKENIZER, public_tokenizers.PATTERN)
    found = sorted((r["doc_id"] or -1, bytes(r["ids"]), r["decoded"]) for r in automaton.decode(ids, TOKENIZER).collect())
    expected = []
    for number, text, *_ in rows:
        own = public.encode(text or "", add_special_tokens=False).ids
        expected.append((number or -1, np.array(own, "<u4").tobytes(), public.decode(own, skip_special_tokens=False)))
    assert found == sorted(expected) and [x for _, _, x in sorted(expected)] == [x for _, _, x in found]
    assert automaton.encode(frame.limit(0), TOKENIZER, public_tokenizers.PATTERN).count() == 0


def test_cut_tokens_decode_to_replacement_characters():
    from tokenizers import Tokenizer
    public, labels = Tokenizer.from_file(TOKENIZER), automaton.load_labels(TOKENIZER)
    ids = public.encode("字😀é", add_special_tokens=False).ids
    for some in [ids[1:], ids[:-1], ids[::-1], ids[1::2]]:
        assert automaton.spell(np.array(some, "<u4").tobytes(), labels) == public.decode(some, skip_special_tokens=False)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_search(docs, items, best):
    held = [(key, plain_terms(text)) for key, text in docs]
    held = [(key, own) for key, own in held if own]
    count, total = len(held), sum(len(own) for _, own in held)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, own in wanted.items():
        weight = {term: math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1))) for term in own if (df := sum(term in have for _, have in held))}
        scored = []
        for key, have in held:
            m = 100 - 50 + (50 * len(have) * count) // total
            score = sum(w * ((1000000000 * have.count(term)) // (1000 * have.count(term) + 20 * m)) for term, w in weight.items() if term in have)
            if score > 0:
                scored.append((-score, key is None, key or 0))
        out += [(item, rank + 1, None if missing else key, -score) for rank, (score, missing, key) in enumerate(sorted(scored)[:best])]
    return out


def same(rows):
    return sorted(rows, key=lambda row: (row[0] is None, row[0] or 0, row[1]))


@pytest.mark.parametrize("seed", range(3))
def test_search_equals_plain_scoring(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(lexical, "DOCUMENTS", 16)
    monkeypatch.setattr(lexical, "ITEMS", 3)
    # Sums of a few products pass this limit, so columns are cut.
    monkeypatch.setattr(lexical, "EXACT", 1 << 33)
    if seed == 2:
        monkeypatch.setattr(lexical, "BLOCK_ITEMS", 4)
    words = ["alpha", "Beta", "GAMMA", "été", "字", "x1", "İ", "d_e", "a-b", "\x1c", " "]
    docs = [(rng.choice([i, i, 7, None]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "?!"), (503, "beta " * 5000)] + [(600 + i, "alpha beta") for i in range(40)] + [(600, "alpha beta")] * 3
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for i in range(9)] + [(3, "beta 字"), (None, "alpha"), (20, None), (21, "nowhere"), (22, "")]
    frame = spark.createDataFrame([(key, text, 1, 2, 3, "y") for key, text in docs], "doc_id bigint, text string, score int, rank int, ids int, item string").repartition(5)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, score int")
    found = [tuple(row) for row in lexical.search(frame, asked, best=7).collect()]
    assert same(found) == same(plain_search(docs, items, 7))


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert lexical.search(docs, items).count() == 0
    assert lexical.search(spark.createDataFrame([(1, "a")], docs.schema), items.limit(0)).count() == 0


def test_column_cuts_bound_the_sums():
    weights = np.array([[5.0, 0, 7, 1, 9], [1, 1, 1, 30, 1]])
    found = lexical.cuts(weights, 1 << 49)
    assert [a for a, _ in found] == [0, *[b for _, b in found][:-1]] and found[-1][1] == 5
    assert all(b - a == 1 or weights[:, a:b].sum(axis=1).max() * (1 << 49) < lexical.EXACT for a, b in found)


def plain_codes(rows):
    kept = [(key, label, [math.floor(1024 * float(np.float32(x))) for x in v]) for key, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][2]) // 4
    first = sorted(kept, key=lambda row: (row[0] is None, row[0] or 0, row[2]))[:256]
    book = [[row[2][p * width:(p + 1) * width] for row in first] for p in range(4)]
    part = [[row[2][p * width:(p + 1) * width] for p in range(4)] for row in kept]

    def near(v, entries):
        return min((sum((a - b) ** 2 for a, b in zip(v, entry)), n) for n, entry in enumerate(entries))

    for _ in range(4):
        for p in range(4):
            members = {}
            for own in part:
                members.setdefault(near(own[p], book[p])[1], []).append(own[p])
            for n, some in members.items():
                book[p][n] = [sum(column) // len(some) for column in zip(*some)]
    out = []
    for (key, label, _), own in zip(kept, part):
        found = [near(own[p], book[p]) for p in range(4)]
        out.append((key, label, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found)))
    sums = {}
    for _, label, _, error in out:
        sums[label] = sums.get(label, 0) + error
    return [(key, code, error, sums[label]) for key, label, code, error in out], hashlib.sha256(",".join(str(x) for entries in book for entry in entries for x in entry).encode()).hexdigest()


def vectors(count, rng, scale=1.0):
    base = [[rng.gauss(0, scale) for _ in range(8)] for _ in range(20)]
    return [[float(np.float32(x + rng.gauss(0, scale / 10))) for x in rng.choice(base)] for _ in range(count)]


@pytest.mark.parametrize("case", ["many", "few", "large"])
def test_codes_equal_plain_rounds(spark, case):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 1, 2]), v) for i, v in enumerate(vectors(40 if case == "few" else 600, rng, 9000.0 if case == "large" else 1.0))]
    rows += [(1000 + i, 1, rows[3][2]) for i in range(200)] + [(None, None, rows[5][2]), (7, 2, rows[9][2]), (7, 2, rows[9][2])]
    odd = [(2000, 1, None), (2001, 1, [None] * 8), (2002, 1, [float("nan")] * 8), (2003, 1, [float("inf")] + [0.0] * 7), (-1, 1, [1.0] * 7 + [None])]
    frame = spark.createDataFrame([(key, v, label, "x", 1) for key, label, v in rows + odd], "vec_id bigint, embedding array<float>, label int, code string, row int").repartition(3)
    coded, book = codes.compress(frame)
    found = [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in codes.with_label_errors(coded).collect()]
    expected, digest = plain_codes(rows)

    def order(some):
        return sorted(some, key=lambda row: (row[0] is None, row[0] or 0, row[1:]))
    assert order(found) == order(expected) and codes.book_digest(book) == digest


def test_codes_of_odd_tables(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    coded, book = codes.compress(spark.createDataFrame([(1, None, 1)], schema))
    assert codes.with_label_errors(coded).count() == 0 and book == []
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([(1, [1.0, 2.0], 1)], schema))
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], schema))
    with pytest.raises(OverflowError):
        codes.compress(spark.createDataFrame([(1, [1e30] * 4, 1)], schema))


def test_residents_stay_and_only_changed_members_move(spark):
    rng = random.Random(6)
    rows = np.arange(4000)
    part = np.array([[rng.randint(-50, 50) for _ in range(2)] for _ in rows])
    book = [part[:16].copy() for _ in range(4)]
    position = rows % 4
    entry, _ = codes.placed(position, part, book)
    blocks = list(codes.divided((position, entry, rows, part), codes.owner_of(position, entry, rows, 4)))
    from barwright.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    state = spark.sparkContext.parallelize(blocks, 3).partitionBy(4, int)
    new = codes.updated(state, book)
    after = codes.moved(state, new, 4)
    assert after.getNumPartitions() == 4 and after.partitioner == state.partitioner

    def homes(rdd):
        found = rdd.mapPartitionsWithIndex(lambda at, read: [(at, owner, int(p), int(e), int(r)) for owner, (ps, es, rs, _) in read for p, e, r in zip(ps, es, rs)]).collect()
        assert all(at == owner == codes.owner_of(np.array([p]), np.array([e]), np.array([r]), 4)[0] or at == owner for at, owner, p, e, r in found)
        return {r: (at, p, e) for at, _, p, e, r in found}

    before, now = homes(state), homes(after)
    expected, _ = codes.placed(position, part, new)
    assert {r: e for r, (_, _, e) in now.items()} == dict(zip(rows.tolist(), expected.tolist()))
    stayed = [r for r in before if before[r][2] == now[r][2]]
    assert len(stayed) < len(rows) and all(before[r][0] == now[r][0] for r in stayed)
    # One exchange, of the members that moved.
    said = after._jrdd.rdd().toDebugString()
    assert said.count("ShuffledRDD") == 1 and "PartitionerAwareUnionRDD" in said
