import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from latentfield.llm import language_id as L
from latentfield.llm.language_id import PART, Binder, identify, is_held_out, language_id, learn


def test_held_out_accuracy(docs):
    got = language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_only_other_folds_are_learned(docs):
    assert {r.lang_pred for r in language_id(docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "zz").otherwise(F.col("lang")))).collect()}.isdisjoint({"zz"})


def test_odd_rows(odd, none):
    got = {r.doc_id: r for r in language_id(odd).collect()}
    assert {got[k].lang_pred for k in (1, 2, 3)} == {"und"} and got[1].score == 0
    assert language_id(odd).count() == odd.count() and language_id(none).count() == 0
    assert {r.lang_pred for r in identify(odd, learn(none)).collect()} == {"und"}


def test_bundle_is_the_sum_of_bound_letters():
    b = Binder(128)
    row, index, letters = b.grams([" ab cd ", " é "])
    assert sorted((int(r), "".join(map(chr, letters[i]))) for r, i in zip(row, index)) == [(0, " ab"), (0, " cd"), (0, "ab "), (0, "b c"), (0, "cd "), (1, " é ")]
    v = b.bundles(2, row, index, letters)
    want = sum(np.roll(b.letter(int(x)), 2) * np.roll(b.letter(int(y)), 1) * b.letter(int(z)) for x, y, z in letters[index[row == 0]])
    assert (v[0] == want).all() and v[1].any()


def test_parts_add_up():
    b, text = Binder(128), "abc de " * (PART // 5)
    whole = sum(b.bundles(len(p), *b.grams(p)).sum(axis=0) for _, p in b.parts([text]))
    assert (whole == b.bundles(1, *b.grams([f" {text} "]))[0]).all()


def test_letters_beside_nul_count(spark, docs):
    profiles = learn(docs.where(~is_held_out()).select("text", "lang"))
    rows = spark.createDataFrame([(1, "a\x00"), (2, "\x00 \x00"), (3, "a ")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(rows, profiles).collect()}
    assert got[2] == ("und", 0.0) and got[1] == got[3] and got[1][0] != "und"


def test_predictions_equal_brute_force(spark, docs):
    """Every gram of every text bound letter by letter, bundled and compared in plain loops over dictionaries."""
    b, d = Binder(128), 128
    few = docs.orderBy("doc_id").limit(60).cache()
    rows = few.collect()

    def bundle(text):
        out = np.zeros(d, np.int64)
        clean = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
        for i in range(len(clean) - 2):
            x, y, z = clean[i : i + 3]
            if y == " " and " " in (x, z):
                continue
            out += np.roll(b.letter(ord(x)).astype(np.int64), 2) * np.roll(b.letter(ord(y)).astype(np.int64), 1) * b.letter(ord(z))
        return out

    learned = {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None and r.text is not None:
            learned[r.lang] = learned.get(r.lang, 0) + bundle(r.text)
    names = sorted(k for k, v in learned.items() if v.any())
    unit = {k: learned[k] / np.linalg.norm(learned[k]) for k in names}
    mean = sum(unit.values()) / len(unit)
    want = {}
    for r in rows:
        v = bundle(r.text).astype(float)
        if not v.any():
            want[r.doc_id] = ("und", 0.0)
            continue
        v = v / np.linalg.norm(v) - mean
        cos = {k: v @ (unit[k] - mean) / np.linalg.norm(v) / np.linalg.norm(unit[k] - mean) for k in names}
        best = max(names, key=lambda k: round(cos[k], 9))
        want[r.doc_id] = (best, min(max(cos[best], 0.0), 1.0))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id(few, dimensions=d).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-6 for k in want)


def test_too_many_languages_are_refused(spark):
    rows = spark.createDataFrame([(f"abc{k}", f"l{k}") for k in range(5)], "text string, lang string")
    assert len(learn(rows, dimensions=64, most_languages=5).languages) == 5
    with pytest.raises(ValueError, match="languages"):
        learn(rows, dimensions=64, most_languages=4)


def test_any_number_of_languages(spark, monkeypatch):
    """3,000 labels, beyond what the driver takes: documents find their own language, blocks of prototypes give what one object gives."""
    monkeypatch.setattr(L, "HELD", 100)
    rng = random.Random(1)
    words = {k: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(4)] for k in range(3000)}
    rows = [(k * 2 + j, " ".join(rng.choice(words[k]) for _ in range(12)), f"l{k:04d}") for k in range(3000) for j in (0, 1)]
    df = spark.createDataFrame(rows + [(None, "abc", None), (9000, None, "l0001"), (9001, "12 34", "l0002")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id(df, dimensions=256, most_languages=2000).collect()}
    assert len(got) == 6003 and got[9000].lang_pred == got[9001].lang_pred == "und" and got[9001].score == 0
    learned = [(i, lang) for i, _, lang in rows if not got[i].held_out]
    assert sum(got[i].lang_pred == lang for i, lang in learned) > 0.97 * len(learned)
    few = df.where("doc_id < 1200")
    one = {r.doc_id: (r.lang_pred, r.score) for r in language_id(few, dimensions=256).collect()}
    for block, chunk in ((512, 2048), (64, 100)):
        monkeypatch.setattr(L, "BLOCK", block)
        monkeypatch.setattr(L, "CHUNK", chunk)
        table = {r.doc_id: (r.lang_pred, r.score) for r in language_id(few, dimensions=256, most_languages=10).collect()}
        assert {k: v[0] for k, v in table.items()} == {k: v[0] for k, v in one.items()} and all(abs(table[k][1] - one[k][1]) < 1e-8 for k in one)


def test_ties_go_to_the_first_name(spark):
    """Languages learned from the same text have the same prototype."""
    rows = [(k, "some words of a language", f"l{k % 3}") for k in range(30)] + [(k, "ganz andere wörter hier", "z") for k in range(30, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for most in (2000, 1):
        got = {r.doc_id: r.lang_pred for r in language_id(df, dimensions=256, most_languages=most).collect()}
        assert got == {k: "l0" if k < 30 else "z" for k in range(40)}
