"""Cases that the operators' docstrings define: collisions, clashing names, repeated ids, long values, and models against plain ones."""

import glob
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.llm import decontaminate, langid, lm_score, ngram_join, oracles, quality, queries, url_filter
from helixframe.llm import text as tx
from helixframe.llm.line_dedup import dedup_lines, drop_repeated_lines
from helixframe.llm.mixing import mix_sources
from helixframe.llm.suffix_dedup import remove_repeats

SF = "/root/testdata/sf0.001"


def thue_morse(n):
    word, other = "a", "b"
    for _ in range(n):
        word, other = word + other, other + word
    return word, other


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


# --- hashes


def test_words_of_one_sum_of_powers_differ(spark):
    a, b = thue_morse(10)
    hashes, _ = tx.word_hashes(*tx.bytes_of(pa.array([a, b, a[:256], b[:256], a[:255], "x" * 8, "x" * 9, ""])))
    assert len(set(hashes.tolist())) == len(hashes) == 7
    docs = documents(spark, [(1, f"{a} q r", "x", "s"), (2, f"{b} q r", "x", "s"), (3, f"{a} q r", "x", "s")])
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_jaccard_components(docs, 3, 90, 100).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    items = spark.createDataFrame([(7, f"{b} Q r")], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.find_leaks(docs, items).collect()] == [2]
    known = {r["doc_id"]: r["n_known"] for r in lm_score.score_texts(documents(spark, [(0, a, "x", "s"), (16, b, "x", "s")])).collect()}
    held = [i for i in (0, 16) if lm_score.score_texts(documents(spark, [(i, "", "x", "s")])).first()["held_out"]]
    assert all(n == 2 for i, n in known.items() if i not in held)


def test_repeats_of_one_sum_of_powers_stay(spark):
    a, b = thue_morse(11)
    rows = {r["doc_id"]: r["n_removed"] for r in remove_repeats(documents(spark, [(1, f"1{a}", "x", "s"), (2, f"2{b}", "x", "s")])).collect()}
    whole = [f"1{a}", f"2{b}"]
    seen = Counter(t[p : p + 200] for t in whole for p in range(len(t) - 199))
    want = {}
    for i, t in enumerate(whole):
        gone = set()
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone |= set(range(p, p + 200))
        want[i + 1] = len(gone)
    assert rows == want


# --- decontamination


def test_items_are_found_through_their_partition():
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(4000)]
    items = [" ".join(rnd.sample(words, n)) for n in (5, 8, 12, 30, 40, 100, 300)]
    table = decontaminate.Sketches(list(range(len(items))), items, 5, 8, 10)
    sizes = [len(x) for x in table.sets]
    assert sizes == [1, 4, 8, 26, 36, 96, 296] and [p.length for p in table.partitions] == [1, 1, 2, 6, 8, 20, 60] and [p.least for p in table.partitions] == [1, 4, 7, 21, 29, 77, 237]
    texts = [f"before it {x} and after" for x in items] + ["w1 w2"]
    found = {(r, i) for r, i, *_ in table.search(pa.array(texts))}
    assert found == {(i, i) for i in range(len(items))}
    gone = table.partitions.pop()
    assert {(r, i) for r, i, *_ in table.search(pa.array(texts))} == found - {(6, 6)}
    table.partitions.append(gone)
    gone.least = 400  # a document of fewer shingles doesn't ask a partition
    assert {(r, i) for r, i, *_ in table.search(pa.array(texts))} == found - {(6, 6)}


def test_rows_of_one_id_are_judged_by_their_text(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, "x", "s"), (5, long + " more", "x", "s"), (5, "another text of its own here", "x", "s"), (5, None, "x", "s"), (6, long, "x", "s"), (1, long, "x", "s"), (None, long, "x", "s")]
    left = ngram_join.drop_near_copies(documents(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in left), key=str) == sorted([(1, long), (1, long), (5, "another text of its own here"), (5, None), (None, long)], key=str)
    items = spark.createDataFrame([(1, long)], "item_id long, text string")
    left = decontaminate.drop_contaminated(documents(spark, rows), items).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in left), key=str) == sorted([(5, "another text of its own here"), (5, None), (None, long)], key=str)


# --- n-gram join


def test_trees_give_the_candidates(spark, monkeypatch):
    asked = []
    search = ngram_join.RTree.search
    monkeypatch.setattr(ngram_join.RTree, "search", lambda self, *a: asked.append(1) or search(self, *a))
    base = [f"w{i}" for i in range(50)]
    frame = [(5, 0, i, sum(1 for _ in base), ngram_join.count_vectors(np.unique(tx.mix(np.arange(i, 50 + i, dtype=np.uint64))))[0]) for i in (5, 6, 7, *range(40, 70))]
    pdf = pd.DataFrame(frame, columns=["pivot", "i", "node", "n", "point"])
    got = ngram_join._pivot_pairs(8, 10)(pdf)
    assert sorted(zip(got["a"], got["b"], strict=True)) == [(5, 6), (5, 7)] and asked


def test_large_cells_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL_BLOCK", 4)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:58], f"x{i}"]), "x", "s") for i in range(50)] + [(100 + i, " ".join(f"v{i}_{j}" for j in range(20)), "x", "s") for i in range(10)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_jaccard_components(documents(spark, rows), 3, 90, 100).collect()}
    assert got == {i: 0 for i in range(50)} | {100 + i: 100 + i for i in range(10)}


def test_vectors_keep_counts_and_bound_what_sets_share():
    for most in (1, 15, 16, 255, 256, 70_000):
        counts = np.zeros(64, np.int64)
        counts[3], counts[4] = most, 1
        assert ngram_join.point(ngram_join._packed(counts)).tolist() == counts.tolist()
    words = np.unique(tx.mix(np.arange(3000, dtype=np.uint64)))
    for n, m in ((2, 40), (90, 100), (500, 2900)):
        a, b = ngram_join.count_vectors(words[:n]), ngram_join.count_vectors(words[:m])
        assert [len(ngram_join.point(x)) for x in a] <= [64, 256, 4096]
        assert all(ngram_join.shared_at_most(x, y) == n for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize(("num", "den"), [(90, 100), (8, 10), (1, 2)])
def test_sizes_that_can_link_are_in_neighbouring_bands(spark, num, den):
    sizes = spark.range(1, 20_000).withColumnRenamed("id", "n")
    most = sizes.select(F.floor(F.col("n") * den / num).alias("n"), F.col("n").alias("least"))
    pairs = most.withColumn("high", ngram_join._band(num, den)).select("high", F.col("least").alias("n")).withColumn("low", ngram_join._band(num, den))
    assert pairs.where("high - low not in (0, 1)").count() == 0


def test_open_parts_have_what_may_link(spark):
    rows = [(1, 2, 2, 90), (1, 3, 3, 100), (1, 4, 4, 50), (5, 6, 6, 90), (5, 7, 6, 95), (8, 9, 9, 10)]
    (got,) = ngram_join._open_parts(spark.createDataFrame(rows, "pivot long, node long, root long, n long"), 90, 100).collect()
    assert (got["pivot"], got["every"]) == (1, 2) and len(got["parts"]) == 1


# --- names


@pytest.mark.parametrize("operator", ["lines", "fresh", "mix", "lang", "near", "leaks", "urls"])
def test_columns_of_any_name_stay(spark, operator):
    extra = ["__id", "__of", "__covered", "__size", "__key", "__bucket", "__source", "__target", "__text", "__lang_pred", "__url", "__rule", "a.dot", "c0", "t", "id", "key", "item", "w", "cut", "url_1", "rule_full", "short", "salt", "of", "node"]
    docs = documents(spark, [(1, "a b\nc d\ne f", "xx", "s"), (2, "a b\nc d\ne f\ng", "xx", "s"), (None, None, None, None)])
    docs = docs.select("*", *(F.lit(f"v-{c}").alias(c) for c in extra))
    model = langid.fit([("a b c", "xx"), ("y z", "yy")])
    model.thresholds[:] = 0
    run = {
        "lines": lambda: dedup_lines(docs),
        "fresh": lambda: drop_repeated_lines(docs),
        "mix": lambda: mix_sources(docs),
        "lang": lambda: langid.keep_recognised(docs, model),
        "near": lambda: ngram_join.drop_near_copies(docs),
        "leaks": lambda: decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, "a b c")], "item_id long, text string")),
        "urls": lambda: url_filter.judge_urls(docs.withColumnRenamed("text", "url"), url_filter.rule_table(spark, [("com", "/", "allow")])),
    }[operator]()
    rows = run.collect()
    assert rows and all(r[c] == f"v-{c}" for r in rows for c in extra)
    assert [c for c in run.columns if c in docs.columns and c != "text"] == [c for c in docs.columns if c != "text"]


# --- language identification


def test_sample_is_bounded_without_ids(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 40)
    seen = []
    fit = langid.fit
    monkeypatch.setattr(langid, "fit", lambda examples: seen.extend(examples) or fit(examples))
    docs = documents(spark, [(None, "same words here " + "z" * 9000, "xx", "s")] * 500 + [(i, f"other words {i}", "yy", "s") for i in range(30)])
    langid.train(docs, F.lit(True))
    counts = Counter(lang for _, lang in seen)
    assert counts["xx"] <= langid.WINDOWS * 20 and 0 < counts["yy"] <= langid.WINDOWS * 20 and max(len(t) for t, _ in seen) <= langid.WINDOW_BYTES


def test_predictions_equal_a_plain_forward_pass():
    rnd = random.Random(2)
    letters = {"aa": "abcdefgh", "bb": "éíjklm", "cc": "opqrst"}
    texts = [(" ".join("".join(rnd.choices(own, k=rnd.randint(1, 6))) for _ in range(rnd.randint(1, 30))), lang) for lang, own in letters.items() for _ in range(60)]
    model = langid.fit(texts)
    top = 1 << 64

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 % top
        x ^= x >> 27
        x = x * 0x94D049BB133111EB % top
        return x ^ x >> 31

    def logits(text):
        raw = text.encode()
        blank = [chr(b).isspace() and b < 128 for b in raw]
        rows = []
        for n in langid.SIZES:
            for i in range(len(raw) - n + 1):
                part = blank[i : i + n]
                if (part[0] and part[-1]) or any(part[1:-1]):
                    continue
                total = n
                for j in range(n):
                    b = 32 if part[j] else raw[i + j] + (32 if 65 <= raw[i + j] <= 90 else 0)
                    total += int(langid._BYTE[b]) * int(langid._STEP[j])
                rows.append(mixed(total % top) >> 48)
        return np.mean([model.table[r] for r in rows], axis=0) + model.bias if rows else model.bias

    names, score, _ = model.predict(pa.array([t for t, _ in texts]))
    for (text, _), name, s in zip(texts, names, score, strict=True):
        e = np.exp(logits(text) * model.temperature - (logits(text) * model.temperature).max())
        assert model.languages[int(e.argmax())] == name and abs(e.max() / e.sum() - s) < 1e-9


# --- quality


def test_verdict_equals_brute_force(spark):
    rnd = random.Random(12)
    vocab = {"xx": [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrstuvwxyz"], "yy": [f"é{a}{b}" for a in "mnopqr" for b in "abcdefghijklmnopqrstuvwxyz"]}
    rows = [(i, " ".join(rnd.choices(vocab[lang], weights=range(len(vocab[lang]), 0, -1), k=rnd.choice([12, 60, 300]))), lang, "s") for i in range(120) for lang in [rnd.choice(list(vocab))]]
    rows += [(500, " ".join(f"{i}#A{i}" for i in range(90)), "xx", "s"), (501, " ".join(f"Q{i}!" for i in range(90)), None, "s")]
    char_of = lambda c: ord(c) - 97 if "a" <= c <= "z" else 26 if "A" <= c <= "Z" else 27 if "0" <= c <= "9" else 29 if c in "#*$%&|<>+" else 33 if ord(c) > 127 else 28
    chars, words = {"xx": Counter(), "yy": Counter()}, {"xx": Counter(), "yy": Counter()}
    low = lambda t: t.encode().lower().decode().split()
    for _, t, lang, _ in rows:
        if lang:
            chars[lang].update(char_of(c) for c in t if c != " ")
            words[lang].update(low(t))

    def apart(p, q):
        sp, sq, out = sum(p.values()), sum(q.values()), 0.0
        for k in p.keys() | q.keys():
            x, y = p[k] / sp, q[k] / sq
            m = (x + y) / 2
            out += (x * np.log2(x / m) if x else 0) + (y * np.log2(y / m) if y else 0)
        return max(0.0, out / 2) ** 0.5

    got = {r["doc_id"]: r for r in quality.judge_quality(documents(spark, rows).repartition(3)).collect()}
    for i, t, *_ in rows:
        n = len(t.split())
        if n < quality.MIN_WORDS:
            continue
        near = []
        for lang in chars:
            common = dict(sorted(words[lang].items(), key=lambda x: (-x[1], x[0].encode()))[: quality.COMMON])
            fold = lambda c: Counter({k: c[k] for k in common} | {"": sum(c.values()) - sum(c[k] for k in common)})  # noqa: B023, E731
            near.append((apart(Counter(char_of(c) for c in t if c != " "), chars[lang]), apart(fold(Counter(low(t))), fold(words[lang]))))
        c, w = min(x for x, _ in near), min(x for _, x in near)
        assert abs(got[i]["char_distance"] - c) < 1e-9 and abs(got[i]["word_distance"] - w) < 1e-9
        assert got[i]["kept"] == (not got[i]["base_failed"] and c <= quality.CHAR_LIMIT + quality.CHAR_SLACK / n and w <= quality.WORD_LIMIT + quality.WORD_SLACK / n)
    assert not got[500]["kept"] and sum(r["kept"] for r in got.values()) > 60


# --- scores


def test_gridded_weights_are_near_plain_ones():
    rng = np.random.default_rng(5)
    n = 60_000
    bucket = rng.integers(1, 4, n)
    f2 = np.where(rng.random(n) < 0.3 + 0.15 * bucket, rng.random(n) ** 3, 0)
    f1, f0 = rng.random(n) ** 6 / 50 + 1e-6, 1e-5
    plain = lm_score.maximise(bucket, np.ones(n), f2, f1, f0)
    cell = (bucket * lm_score.LEVELS + lm_score._levels(f2)) * lm_score.LEVELS + lm_score._levels(f1)
    ids, at = np.unique(cell, return_inverse=True)
    c = np.bincount(at)
    grid = lm_score.maximise(ids // lm_score.LEVELS**2, c.astype(float), np.bincount(at, weights=f2) / c, np.bincount(at, weights=f1) / c, f0)
    assert np.abs(grid[1:4] - plain[1:4]).max() < 0.01
    like = lambda w: np.log((w[bucket] * np.stack([f2, f1, np.full(n, f0)], axis=1)).sum(axis=1)).mean()
    assert like(plain) - like(grid) < 1e-4


def test_bigrams_keep_whole_hashes():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64))
    assert (lm_score._risen(lm_score._rising(keys)) == keys).all()


# --- URLs


def test_long_hosts_and_hot_expressions(spark):
    host = "a." * 100_000 + "example.com"
    rows = [(1, f"http://{host}/en/x"), (2, "http://" + "b" * 1_000_000 + ".com/")] + [(10 + i, f"http://h{i}.com/{i}") for i in range(200)]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), url_filter.rule_table(spark, queries.URL_RULES), keep=["page_id"]).collect()}
    assert got == {1: ("example.com/en/", "block")} | {i: ("com/", "allow") for i, _ in rows[1:]}


# --- SQL


def _plain(x):
    return x if isinstance(x, (bool, str)) or x is None else round(float(x), 9)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(_plain(v) for v in r) for r in got.select(names).collect()), key=str) == sorted((tuple(map(_plain, r)) for r in want.fetchall()), key=str)


def test_checksum_in_sql():
    import zlib

    got = duckdb.sql(f"SELECT doc_id, {oracles._CRC} FROM (VALUES (0), (7), (123456)) t(doc_id)").fetchall()
    assert got == [(i, zlib.crc32(str(i).encode())) for i in (0, 7, 123456)]
