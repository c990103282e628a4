"""Sharding and license scans against plain definitions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from barwright.llm import licenses, shards


def shard_rows():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    line = lambda: " ".join(word() for _ in range(8))
    shared = [line() for _ in range(15)]
    rows = [(i, "\n".join([shared[i % 15], line(), line()]), "a") for i in range(150)]
    rows += [(150 + i, line(), "b") for i in range(60)] + [(210 + i, "copy " * 20, "c") for i in range(90)] + [(300 + i, f"pair {i // 2}", "d") for i in range(40)]
    return rows + [(400, None, "x"), (401, "", "x"), (None, "null key", "x"), (402, "é字", "x"), (402, "é字", "x")]


def check_law(rows, got, shards_):
    assert Counter((r[0], r[1]) for r in rows) == Counter((r["_id"], r["_text"]) for r in got)
    counts = Counter(r["shard"] for r in got)
    assert max(counts.get(s, 0) for s in range(shards_)) - min(counts.get(s, 0) for s in range(shards_)) <= 1
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values()) and set(by) <= set(range(shards_))


@pytest.mark.parametrize("count", [8, 3])
def test_shards_are_level_and_keep_links(spark, count):
    rows = shard_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard string")
    texts = defaultdict(list)
    for i, t, _ in rows:
        texts[i].append(t)
    got = [r.asDict() for r in shards.assign(df, count).collect()]
    for r in got:
        r["_id"], r["_text"] = r["doc_id"], texts[r["doc_id"]][0]
        raw = (r["_text"] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "rows" and r["grown_shard"] is None
    check_law(rows, got, count)
    place = {r["doc_id"]: r["shard"] for r in got}
    same = sum(place[300 + i] == place[301 + i] for i in range(0, 40, 2))
    assert same >= 18
    # Documents that share a line meet far more often than by chance.
    pairs = [(i, j) for i in range(150) for j in range(i + 15, 150, 15)]
    assert sum(place[i] == place[j] for i, j in pairs) > 2 / count * len(pairs)


def test_shards_of_few_and_no_rows(spark):
    schema = "doc_id bigint, text string"
    assert shards.assign(spark.createDataFrame([], schema)).count() == 0
    got = shards.assign(spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], schema)).collect()
    assert sorted(r["slot"] for r in got) == [0, 0, 0] and len({r["shard"] for r in got}) == 3
    hot = shards.assign(spark.createDataFrame([(i, "same") for i in range(100)], schema)).collect()
    assert sorted(Counter(r["shard"] for r in hot).values()) == [12, 12, 12, 12, 13, 13, 13, 13]


WORD = re.compile(licenses.WORD)


def brute_scan(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    places, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        own = [i for i in range(len(words)) if words[i:i + len(parts)] == parts]
        places += own
        base |= {label} if own else set()
    labels, best = set(base), 0.0
    for start in range(0, max(len(words), 1), licenses.STEP):
        inside = words[start:start + licenses.BLOCK]
        block = set(inside)
        for label, passage, telling in licenses.TEMPLATES:
            tokens = set(passage.split())
            share, phrase = len(tokens & block) / len(tokens), telling.split()
            if share >= licenses.THRESHOLD and any(inside[i:i + len(phrase)] == phrase for i in range(len(inside))):
                labels.add(label)
                best = max(best, share)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else best


def license_texts():
    rng = random.Random(4)
    common = "the of and to is in that this software license under any".split()
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdef") for _ in range(4))
    out = [None, "", "MIT License", "mit  license MIT-LICENSE mit licensed", "É MIT License", "license mit", "GNU General Public License", "general public\nlicense general public license", "İmit license", "MIT License",
           "Apache License; apache license", "mit mit license license"]
    for i in range(120):
        passage = licenses.TEMPLATES[i % len(licenses.TEMPLATES)][1].split()
        kept = [w for w in passage if rng.random() > rng.choice((0, 0.1, 0.2, 0.3))]
        out.append(" ".join([word() for _ in range(rng.randint(0, 150))] + kept + [word() for _ in range(rng.randint(0, 150))]))
    return out + [" ".join(word() for _ in range(20_000))]


def test_licenses_against_brute_force(spark):
    texts = license_texts()
    df = spark.createDataFrame([(i, t, "labels", "x") for i, t in enumerate(texts)], "doc_id bigint, text string, labels string, block string")
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in licenses.scan(df).collect()}
    for i, text in enumerate(texts):
        want = brute_scan(text)
        assert got[i][:-1] == want[:-1] and got[i][-1] == pytest.approx(want[-1]), (i, text)


def test_license_lines_that_lack_the_telling_word(spark):
    """Lines that hold the share of a template of another license; labels of the fixed phrases stay."""
    lines = {"Released under the BSD license": "", "Released under the MIT license": "mit", "Released under the Apache License": "apache",
             "Licensed under the GNU General Public License, version 2.0": "gpl", "Licensed under the Apache License, Version 2.0": "apache",
             "Licensed under CC BY 4.0": "", "Licensed under CC BY-SA 4.0": "", "Licensed under CC BY-NC 4.0": "cc-by-nc",
             "this work is licensed under the mozilla public license version 3": "",
             "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation": "gpl"}
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    assert {text: r["labels"] for text, r in zip(lines, licenses.scan(df).orderBy("doc_id").collect())} == lines
    # The join itself still finds every block at the threshold.
    found = licenses.matches(df.where("doc_id = 0")).collect()
    assert [(r["label"], r["containment"], r["told"]) for r in found] == [("mit", 0.8, False)]


def test_license_words_out_of_order_or_of_another_license(spark):
    """A telling phrase must stand word after word; passages that licenses share give the label of the one that is told."""
    lines = {"the mit was released; a license under it": "", "under the licensed 0 2 version apache, a license": "", "nc cc, by licensed under 4.0": "",
             "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "bsl",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
             "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
             "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
             "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc",
             "redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation": "agpl,gpl",
             "This is free and unencumbered software released into the public domain.": "unlicense"}
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    assert {text: r["labels"] for text, r in zip(lines, licenses.scan(df).orderBy("doc_id").collect())} == lines


def test_templates_hold_their_telling_phrase():
    for label, passage, telling in licenses.TEMPLATES:
        assert f" {telling} " in f" {passage} " and len(passage.split()) <= licenses.STEP and WORD.findall(passage) == passage.split(), label


def test_licenses_repeated_keys_and_empty(spark):
    schema = "doc_id bigint, text string"
    rows = [(1, "MIT License"), (1, "plain"), (1, "plain"), (None, "Apache License")]
    got = sorted((str(r["doc_id"]), r["labels"]) for r in licenses.scan(spark.createDataFrame(rows, schema)).collect())
    assert got == [("1", ""), ("1", ""), ("1", "mit"), ("None", "apache")]
    assert licenses.scan(spark.createDataFrame([], schema)).count() == 0
