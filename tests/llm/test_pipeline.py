"""The pipeline on a small table, stage by stage against plain definitions, and the registered queries."""

import random
import zlib

import numpy as np
import public_tokenizers

import __spark_entry__ as entry
import corpus_pipeline
from barwright.llm import jaccard, packing, pii

from test_pairs import brute_texts
from test_texts import language_rows


def rows():
    rng = random.Random(8)
    out = [(i, text, lang, "s", len(text)) for i, text, lang, _ in language_rows()[:120]]
    for i in range(20):
        words = out[i][1].split()
        if len(words) > 60:
            words[rng.randrange(len(words))] = "changed"
        out.append((200 + i, " ".join(words), out[i][2], "s", 0))
    out += [(300, "the and tion er on ing a.b@mail5.example the and +1 (743) 555-3824 tion", "en", "s", 0)]
    return out + [(400, None, "en", "s", None), (401, "", None, "s", 0), (402, "?! 12", "fr", None, 5), (403, "the and ing tion " * 2000, None, "s", 0)]


def test_stages_and_run(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows(), schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language"](spark, docs, str(tmp_path))
    by_id = {r["doc_id"]: r for r in kept.collect()}
    assert set(by_id) == {r[0] for r in rows()} - {400, 401, 402} and kept.columns == docs.columns and by_id[403]["lang"] == "en"
    numbers = sorted(by_id)
    group = brute_texts([by_id[i]["text"] for i in numbers])[1]
    unique = stages["near_copies"](spark, kept, str(tmp_path))
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted({numbers[g] for g in group}) and unique.columns == docs.columns
    private = stages["private_data"](spark, unique, str(tmp_path))
    texts = {r["doc_id"]: r["text"] for r in private.collect()}
    assert set(texts) == {numbers[g] for g in group} and ".example the" in texts[300] and "a.b@" not in texts[300] and "555-3824" not in texts[300]
    assert all(texts[i] == by_id[i]["text"] for i in texts if not pii.detect(by_id[i]["text"])) and private.columns == docs.columns
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = packing.load_tokenizer(public_tokenizers.path("word_bpe_49k.json"))[0]
    assert {r["doc_id"] for r in pieces} == set(texts)
    for r in pieces:
        ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [2]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes())
    assert sum(r["length"] for r in pieces) == sum({r["doc_id"]: r["doc_tokens"] for r in pieces}.values())


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(name.startswith(f"op{n}_") for name in names) for n in range(1, 14)) and "pipeline" in names


def test_stages_keep_columns_whatever_their_names(spark, tmp_path):
    """Names that the operators use themselves, and one with a dot."""
    names = ["lang_pred", "score", "_text", "_key", "_mark", "__own_mark", "row", "key", "mark", "own_key", "own_mark", "kept", "_redraws", "redraws", "drawn", "a.b", "number", "bucket"]
    plain = rows()[:40] + [rows()[3], rows()[3]] + rows()[120:]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{name}` string" for name in names)
    docs = spark.createDataFrame([(*row, *[f"{name}-{row[0]}" for name in names]) for row in plain], schema)
    expected = spark.createDataFrame(plain, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, expected = stage(spark, docs, str(tmp_path)), stage(spark, expected, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        found = docs.collect()
        assert all(row[other] == f"{other}-{row['doc_id']}" for row in found for other in names)
        assert sorted(tuple(row)[:5] for row in found) == sorted(map(tuple, expected.collect()))
    assert len(found) == len({row["doc_id"] for row in found})


def test_joined_redraws_keep_columns(spark, monkeypatch):
    monkeypatch.setattr(pii, "CARRIED", -1)
    docs = spark.createDataFrame([(i, f"call +1 (743) 555-38{i:02d} now", f"x{i}") for i in range(30)] + [(None, None, "n")], "doc_id bigint, text string, _redraws string")
    found = pii.pseudonymise(docs).collect()
    assert sorted((-1 if row["doc_id"] is None else row["doc_id"], row["_redraws"]) for row in found) == sorted([(i, f"x{i}") for i in range(30)] + [(-1, "n")])


def test_marks_beyond_the_carried_number_give_the_same_rows(spark, monkeypatch):
    docs = spark.createDataFrame(rows() + rows()[:5] * 2, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    plain = sorted((r["doc_id"], r["text"] or "") for r in jaccard.distinct_documents(docs).collect())
    monkeypatch.setattr(jaccard, "FILTERED", 0)
    assert sorted((r["doc_id"], r["text"] or "") for r in jaccard.distinct_documents(docs).collect()) == plain
