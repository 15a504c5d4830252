import math
import unicodedata
import zlib
from collections import Counter

import numpy as np

from castwise.llm import language
from tests.llm.conftest import prose

FOLDER = "/root/testdata/sf0.01"


def slow_counts(text):
    """The n-grams of blank-framed letter runs as strings, one by one."""
    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    framed = " " + " ".join(kept.split()) + " "
    out = Counter()
    for n in language.ORDERS:
        for i in range(len(framed) - n + 1):
            gram = framed[i: i + n]
            if n > 1 or gram != " ":
                h = 0
                for c in gram:
                    h = (h * 1_000_003 + (0 if c == " " else ord(c))) % 2**64
                out[((h + n) * 0x9E3779B97F4A7C15 % 2**64) >> 51] += 1
    return out


def test_counts_are_those_of_single_ngrams(monkeypatch):
    for text in ("a", "Ab, c1d  e", "Öl über\x00É İx", "x y z " * 40, prose(3, 50), "न हीं 12 ठी"):
        want = slow_counts(text)
        for block in (1 << 20, 5, 1):
            monkeypatch.setattr(language, "BLOCK", block)
            got = language.counts(text)
            assert {i: int(got[i]) for i in np.flatnonzero(got)} == dict(want), (text, block)
    assert language.counts("") is None and language.counts("12 ³ !") is None


def test_clusters_are_found_and_outliers_are_none():
    r = np.random.default_rng(2)
    ends = np.eye(6)[:3]
    x = np.concatenate([e + r.normal(0, 0.02, (100, 6)) for e in ends] + [-np.eye(6)[:1]])
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    centroids, radius = language.cluster(x, 4)
    assert sorted((centroids @ ends.T).argmax(axis=1)[(centroids @ ends.T).max(axis=1) > 0.99].tolist()) == sorted(
        (centroids @ ends.T).argmax(axis=1).tolist())
    assert {0, 1, 2} <= set((centroids @ ends.T).argmax(axis=1).tolist()) and (radius < 0.1).all()


def test_prediction_equals_a_plain_loop(spark, frame):
    texts = {"de": "der und die ich über", "en": "the and of that thing", "fr": "le de la être où"}
    rows = [(i, " ".join(prose(i, 3).split() + texts[lang].split() * 3), lang) for i, lang in enumerate(["de", "en", "fr"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(docs, centroids=2)
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    per = {lang: [slow_counts(t) for _, t, l in learned if l == lang] for lang in texts}
    share = Counter()
    for lists in per.values():
        for gram in set().union(*lists):
            share[gram] += sum(gram in c for c in lists) / len(lists)
    for gram, s in share.items():
        assert math.isclose(model.weight[gram], max(0, 1 + math.log(3 / s)), abs_tol=1e-4)
    for r in language.identified(docs, model).collect():
        v = np.zeros(language.WIDTH)
        for gram, n in slow_counts(r["text"]).items():
            v[gram] = math.log1p(n) * model.weight[gram]
        cosine = model.centroids @ (v / np.linalg.norm(v))
        assert model.langs[cosine.argmax()] == r["language"]["lang"] == r["lang"] and abs(cosine.max() - r["language"]["score"]) < 1e-5


def test_held_out_accuracy_and_no_leak(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = language.op11_language(spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in got)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    # labels of the held-out fold change nothing
    fold = language.held_out(docs["doc_id"])
    from pyspark.sql import functions as F

    other = language.train(docs.withColumn("lang", F.when(fold, F.lit("zz")).otherwise(F.col("lang"))))
    assert other.langs == language.train(docs).langs and "zz" not in other.langs


def test_far_texts_are_rejected(spark, frame):
    lettered = str.maketrans("0123456789", "aeioumnrst")
    rows = [(i, prose(i, 60).translate(lettered), "w") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(docs)
    odd = spark.createDataFrame([(100, "жизнь и язык народа", "w"), (101, prose(999, 60).translate(lettered), "w")], docs.schema)
    got = {r["doc_id"]: r["language"] for r in language.identified(odd, model).collect()}
    assert got[100]["rejected"] and got[100]["lang"] == "w" and not got[101]["rejected"]
    assert [r["doc_id"] for r in language.kept(odd, model, ["w"]).collect()] == [101]
    assert language.kept(odd, model, ["w"], reject=False).count() == 2


def test_edges(spark, frame, edges):
    docs = frame(edges)
    model = language.train(docs)
    told = language.identified(docs, model, name="l").collect()
    assert len(told) == len(edges) and all(0 <= r["l"]["score"] <= 1 for r in told)
    for r in told:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert r["l"]["lang"] == ("en" if letters else "und") and (letters or (r["l"]["rejected"] and r["l"]["score"] == 0))
    none = language.train(frame([]))
    assert none.langs == [] and language.identified(frame([]), none).count() == 0
    assert {r["language"]["lang"] for r in language.identified(docs, none).collect()} == {"und"}
    clash = docs.withColumnRenamed("key", "language").withColumnRenamed("row", "h").withColumnRenamed("rank", "n_")
    assert language.kept(clash, language.train(clash), ["en"], reject=False).columns == clash.columns


def test_hot_row_and_bounded_sample(spark, frame):
    """A row that makes up half of the table is one of the sample; five rows make at most five clusters."""
    docs = frame([(i, prose(i, 10)) for i in range(300)] + [(7, prose(7, 10))] * 300)
    assert len(language.train(docs, sample_rows=5, centroids=50).langs) <= 5
    assert language.train(docs, sample_rows=1).langs == ["en"]
