import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.llm.op6_langid import Model, fit, held_out, identify, normalised, predict
from tessella.llm.registry import queries

TEXTS = {"aa": ["the cat sat on the mat again", "that hat"], "bb": ["der hund und die katze sind"]}


def plain_phrases(text, learned, block=512):
    """Greedy longest matches by substring search; a block begins a phrase, an unknown letter ends one."""
    count = 0
    for at in range(0, len(text), block):
        count += 1
        phrase = ""
        for c in text[at : at + block]:
            if phrase + c in learned:
                phrase += c
            else:
                count += 1
                phrase = c if c in learned else ""
    return count


def test_phrases_and_ranking():
    rnd = random.Random(1)
    given = ["The cat, the hat!", "Der Hund und der Mund", "x", "zzz the ???", "mat mat", "die katze " * 200, "".join(rnd.choices("thedrcaunk  ", k=1500))]
    model = Model({k: [normalised(t) for t in v] for k, v in TEXTS.items()})
    got = predict(model, given)
    for text, lang, score in zip(given, got["lang_pred"], got["score"], strict=True):
        clean = normalised(text)
        entropy = {}
        for name, texts in TEXTS.items():
            learned = "".join(normalised(t) + " " for t in texts)
            entropy[name] = plain_phrases(clean, learned) * math.log2(len(learned)) / len(clean)
        ranked = sorted(entropy.items(), key=lambda x: (x[1], x[0]))
        assert lang == ranked[0][0]
        assert score == pytest.approx(1 - ranked[0][1] / ranked[1][1])
        assert 0 <= score <= 1


def test_edges(spark):
    model = Model({k: [normalised(t) for t in v] for k, v in TEXTS.items()})
    kind = "doc_id long, text string, lang string, score string"
    docs = spark.createDataFrame([(1, None, "aa", "x"), (2, "123 !!", None, "x"), (None, "the cat", "bb", "x"), (None, "the cat", "bb", "x"), (4, "日本語", "aa", "x"), (5, "der Hund " * 60_000, "aa", "x")], kind)
    got = [(r["doc_id"], r[-2], r[-1]) for r in identify(docs.drop("score"), model).collect()]
    assert got[0] == (1, "und", 0.0) and got[1] == (2, "und", 0.0)
    assert [g[1] for g in got[2:4]] == ["aa", "aa"] and got[4][1] in ("aa", "bb") and got[5][1] == "bb"
    assert identify(docs.drop("score").limit(0), model).collect() == []
    nothing = fit(docs.select("text", "lang").filter("lang = 'none'"))
    assert {r["lang_pred"] for r in identify(docs.select("text"), nothing).collect()} == {"und"}
    one = identify(docs.select("text"), Model({"cc": ["abc"]})).collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("und", 0.0), ("cc", 1.0)}
    held = {r[0]: r[1] for r in spark.range(50).select("id", held_out(F.col("id"))).collect()}
    import zlib

    assert held == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)}


def test_held_out_accuracy(spark):
    got = queries()["op6_language_id"](spark, "/root/testdata/sf0.001").collect()
    truth = dict(duckdb.sql("select doc_id, lang from '/root/testdata/sf0.001/documents.parquet'").fetchall())
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(re.fullmatch("de|en|es|fr|und", r["lang_pred"]) and r["score"] == pytest.approx(r["score"]) for r in got)


def whole_phrases(text, learned):
    """Greedy longest matches over a whole text by substring search."""
    count, phrase = 1, ""
    for c in text:
        if phrase + c in learned:
            phrase += c
        else:
            count += 1
            phrase = c if c in learned else ""
    return count


def test_phrases_cross_blocks(monkeypatch):
    """Whole texts need the phrases that a plain search finds, whatever the blocks; states are carried over their borders."""
    from tessella.llm import op6_langid as L

    rnd = random.Random(3)
    texts = {"aa": ["abcdefghijklmnopqrstuvwxyz " * 30], "bb": ["the quick brown fox " * 20 + "jumps"], "cc": ["".join(rnd.choices("abcde ", k=900))], "dd": ["dog"]}
    texts = {k: [normalised(t) for t in v] for k, v in texts.items()}
    given = ["abcdefghijklmnopqrstuvwxyz " * 12, "fox jumps the quick", "".join(rnd.choices("abcdefox ", k=400)), "ab", "a", "é" * 40, "the quick brown fox " * 9 + "ä" + "dog" * 30]
    for block in (1, 3, 16, 512):
        monkeypatch.setattr(L, "BLOCK", block)
        model = Model(texts)
        coded = [L._coded(t, L._symbols(model.letters)) for t in given]
        got = L._parse(model, coded, True)
        for i, lang in enumerate(model.langs):
            learned = "".join(t + " " for t in texts[lang])
            assert got[i].tolist() == [whole_phrases(normalised(t), learned) for t in given]


def test_many_letters_and_languages():
    """Three thousand distinct letters and ten languages: the table grows with the letters learned, and is refused above its bound."""
    rnd = random.Random(4)
    letters = [c for c in map(chr, range(0x4E00, 0x5A00))][:3000]
    texts = {f"l{i}": ["".join(rnd.choices(letters[300 * i : 300 * i + 300], k=4000))] for i in range(10)}
    model = Model(texts)
    assert len(model.table) < 10 * 5 * 4000 + 10 * 2 * 3002
    got = predict(model, [texts[f"l{i}"][0][500:900] for i in range(10)], whole=True)
    assert got["lang_pred"].tolist() == [f"l{i}" for i in range(10)]
    with pytest.raises(ValueError, match="fewer letters"):
        Model(texts, most_entries=1000)


def test_ties_and_clashing_columns(spark):
    model = Model({"bb": ["the same words"], "aa": ["the same words"]})
    docs = spark.createDataFrame([(1, "same words", "x", "y", 3, 4)], "doc_id long, text string, lang_pred string, score string, found int, row int")
    got = identify(docs, model)
    assert got.columns == ["doc_id", "text", "found", "row", "lang_pred", "score"]
    assert tuple(got.first()) == (1, "same words", 3, 4, "aa", 0.0)
