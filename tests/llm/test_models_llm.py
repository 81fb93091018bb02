"""Language ID, toxicity and the URL filter: held-out accuracy, rules, and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from precis.llm import language, toxicity, urls
from precis.llm.common import id_remainder
from precis.llm.queries import QUERIES, URL_RULES

FOLDER = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op10_language"](spark, FOLDER)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = found.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert 200 < len(held) < 500
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def letters(alphabet, n, rng):
    return " ".join("".join(rng.choice(alphabet) for _ in range(5)) for _ in range(n))


def test_language_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, letters("abcde" if i % 2 else "vwxyz", 30, rng), "l1" if i % 2 else "l2") for i in range(40)]
    rows += [(50, None, "l1"), (51, "", "l1"), (52, "123 !?", "l2"), (None, "abc", None), (53, "abcde" * 400_000, "l1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("x"))
    filters = language.learn(docs, F.col("doc_id") < 30)
    assert filters.languages == ["l1", "l2"]
    got = {r["doc_id"]: r for r in language.identify(docs, filters, ("doc_id", "lang_pred", "lang")).collect()}
    assert all(got[i]["lang_pred"] == got[i]["lang"] for i in range(30, 40))
    assert [got[i]["lang_pred"] for i in (50, 51, 52)] == ["und"] * 3 and got[50]["lang_score"] == 0
    assert got[53]["lang_pred"] == got[None]["lang_pred"] == "l1"
    none = language.learn(docs, F.lit(False))
    assert {r["lang_pred"] for r in language.identify(docs, none, ()).collect()} == {"und"}
    assert language.identify(docs.limit(0), filters, ()).count() == 0


def test_more_languages_than_a_mask_word(spark):
    rng = random.Random(3)
    rows = [(i, letters([chr(0x4E00 + 40 * (i % 70) + k) for k in range(12)], 30, rng), f"l{i % 70:02}") for i in range(420)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language.learn(docs, F.col("doc_id") < 350)
    assert len(filters.languages) == 70 and filters.masks.shape[1] == 2
    got = language.identify(docs, filters, ("lang",)).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.98


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic")
    found = QUERIES["op2_toxicity"](spark, FOLDER)
    rows = found.join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    toxic = [r for r in held if r["toxic"]]
    assert found.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert sum(r["predicted"] != r["toxic"] for r in held) < 0.08 * len(held)
    assert sum(r["predicted"] for r in toxic) > 0.5 * len(toxic)
    assert sum(r["predicted"] for r in held if not r["toxic"]) <= 0.03 * len(held)


def test_toxicity_finds_the_sentence(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, labels = [], []
    for i in range(300):
        parts = [" ".join(word() for _ in range(6)) for _ in range(5)]
        if i % 4 == 0:
            parts[rng.randrange(5)] += " vileword"
        rows.append((i, ". ".join(parts) + "."))
        labels.append((i, int(i % 4 == 0)))
    rows += [(900, None), (901, ""), (902, "A vileword here. Nothing else."), (902, "A vileword here. Nothing else.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, known, F.col("doc_id") < 200)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model, ("doc_id", "text", "score")).collect()}
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in range(300))
    assert got[900]["score"] == got[901]["score"] == 0 and got[900]["offending"] == []
    (span,) = got[902]["offending"]
    assert "vileword" in got[902]["text"][span["start"]:span["end"]] and span["end"] <= 17
    clean = toxicity.learn(docs, known.withColumn("toxic", F.lit(0)), F.lit(True))
    assert {r["score"] for r in toxicity.score(docs, clean, ()).collect()} == {0.0}
    assert {r["score"] for r in toxicity.score(docs, toxicity.learn(docs, known, F.lit(False)), ()).collect()} == {0.0}


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("https://WWW.Example.com/en/a?q#f", "www.example.com", "/en/a", "www.example.com/en/", "allow"),
    ("http://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"),
    ("http://example.com/fr/1", "example.com", "/fr/1", "com/", "allow"),
    ("http://notcom/en", "notcom", "/en", None, None),
    ("http://a.net/es/x", "a.net", "/es/x", "net/es/", "block"),
    ("http://a.net/EN/x", "a.net", "/EN/x", None, None),
    ("http://example.com", "example.com", "", None, None),
    ("http://example.com?x=/en/", "example.com", "", None, None),
    ("a://b.com/c://d", "b.com", "/c://d", "com/", "allow"),
    ("mailto:x", "", "", None, None), (None, "", "", None, None), ("://", "", "", None, None),
    ("http://ÄB.com/é\n/x", "Äb.com", "/é\n/x", "com/", "allow"),
])
def test_url_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "h")], "page_id long, url string, host string")
    labelled = spark.createDataFrame([], "host string, path string, verdict string")
    got = urls.judge(pages, URL_RULES, ("page_id", "host"), labelled=labelled).first()
    assert (got["host"], got["path"], got["rule"]) == (host, path, rule)
    assert got["verdict"] == (verdict or "allow")


def test_url_model(spark):
    words = ["casino", "spam", "news", "school"]
    rows = [(i, f"http://{words[i % 4]}{i}.org/p/{i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labelled = pages.where("page_id < 200").select(
        urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"),
        F.when(F.col("page_id") % 4 < 2, "block").otherwise("allow").alias("verdict"))
    got = urls.judge(pages, (), ("page_id",), labelled=labelled).collect()
    assert all(r["verdict"] == ("block" if r["page_id"] % 4 < 2 else "allow") for r in got)
    assert urls.judge(pages.limit(0), URL_RULES, ()).count() == 0


def test_id_remainder(spark):
    import zlib

    rows = spark.range(50).select("id", id_remainder(F.col("id"), 5).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)
