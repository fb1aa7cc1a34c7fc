"""run() against the stages' brute-force versions, one after the other."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixframe.llm import langid
from tests.llm.test_ngram_join import brute
from tests.llm.test_operators import brute_lines, shingle_set


def sentences(rnd, letters, n):
    return " ".join("".join(rnd.choices(letters, k=rnd.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rnd = random.Random(11)
    alphabet = {"aa": "abcdefgh", "bb": "ijklmnop"}
    block = "\n".join(sentences(rnd, "abcdefgh", 12) for _ in range(4))
    items = [(i, sentences(rnd, "abcdefgh", 20)) for i in range(5)]
    rows = []
    for i in range(160):
        lang = rnd.choice(["aa", "bb"])
        text = "\n".join(sentences(rnd, alphabet[lang], rnd.randint(5, 25)) for _ in range(rnd.randint(1, 6)))
        if i % 8 == 0:
            text += "\n" + block
        if i % 13 == 0:
            text += "\n" + items[i % 5][1].upper()
        if i % 6 == 5:
            words = rows[-1][1].split(" ")
            words[0] = words[0] + "x" if i % 12 == 5 else words[0]
            text = " ".join(words)
        rows.append((i, text, lang, rnd.choice(["s1", "s2", "s3", None]), len(text)))
    rows += [(500, None, "aa", "s1", None), (501, "12 34", None, "s1", 5), (502, "", None, None, 0)]
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs, F.lit(True))
    kept = [(r["doc_id"], r["text"], r["source"]) for r in langid.identify(docs, model, docs.columns).where("not rejected").collect()]
    assert 140 <= len(kept) and not {500, 501, 502} & {k[0] for k in kept}
    cut = brute_lines([(d, t) for d, t, _ in kept])
    kept = [(d, cut[d, t][0], s) for d, t, s in kept if not cut[d, t][2] or cut[d, t][2] < cut[d, t][1]]
    groups = brute(kept, 5, 8, 10)
    kept = [k for k in kept if groups[k[0]][1] == k[0]]
    items = [shingle_set(r["text"], 5) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before = len(kept)
    kept = [k for k in kept if not any(10 * len(i & shingle_set(k[1], 5)) >= 8 * len(i) for i in items)]
    assert before > len(kept) > 80
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) <= {k[0] for k in kept} and all(got[d]["text"] == t and got[d]["n_chars"] == len(t) for d, t, _ in kept if d in got)
    size = {s: sum(len(t.split()) for _, t, x in kept if x == s) for s in {k[2] for k in kept}}
    for s, words in size.items():
        own = [r for r in got.values() if r["source"] == s]
        assert {r["source_size"] for r in own} == {words} and all(0 < r["taken"] <= 2 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(len(t.split()) for _, t, x in kept if x == s)
    assert abs(sum({r["source"]: r["target"] for r in got.values()}.values()) - 1.5 * sum(size.values())) < 1e-6


def test_stages_return_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({c: F.lit("x") for c in ("node", "size", "score", "rejected", "n_lines", "n_removed", "epochs", "bucket", "last", "key", "covered", "slot", "component_id", "item_id", "of")})
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "decontaminate", "mix"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.limit(1).count() == 1, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.where("epochs = 'x' and size > 0").count() == last.count() > 0
