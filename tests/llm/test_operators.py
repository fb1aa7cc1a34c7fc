"""Each operator against a brute-force version, and the cases that its docstring defines."""

import hashlib
import io
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm import decontaminate, langid, lm_score, quality, url_filter, warc
from helixframe.llm.line_dedup import dedup_lines
from helixframe.llm.mixing import mix_sources

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n", T.LongType())])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def low(text):
    return (text or "").encode().lower()


def spaced(raw):
    return raw.split()


def corpus(seed=5, n=80):
    rnd = random.Random(seed)
    vocab = ["the", "of", "Und", "é", "x1", "##", "word", "ab<c", "lorem", "ipsum"] + [f"t{i}" for i in range(60)]
    lines = [" ".join(rnd.choices(vocab, k=rnd.randint(1, 9))) for _ in range(40)]
    out = []
    for i in range(n):
        text = rnd.choice([" ", "\n", "\n\n"]).join(rnd.choices(lines, k=rnd.choice([0, 1, 2, 5, 30])))
        out.append((i, text, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "B", "ü", None, "hot", "hot"]), i))
    block = "\n".join(lines[:5])
    out += [(500 + i, f"{rnd.choice(lines)}\n{block}\n {rnd.choice(lines)}", "en", "a", i) for i in range(12)]
    out += [(1000, None, None, None, None), (1001, "", "en", "a", 1), (1002, " \t\n", None, "b", 1), (1003, "z" * 200_000 + " the end", "en", "a", 1), (None, "the of word", "en", "a", 2), (1004, "a b c d e f", "en", "a", 2), (1004, "a b c d e f", "en", "a", 2)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


# --- decontamination


def shingle_set(text, k):
    w = spaced(low(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("block", [1 << 24, 600])
def test_leaks_equal_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rnd = random.Random(1)
    texts = [r[1] for r in corpus() if r[1] and 8 < len(r[1].split()) < 500]
    items = []
    for i in range(30):
        w = rnd.choice(texts).split()
        at = rnd.randrange(len(w))
        w = w[at : at + rnd.choice([3, 8, 25])]
        if i % 3 == 0:
            w[rnd.randrange(len(w))] = "other"
        items.append((i, " ".join(w).upper(), 1))
    items += [(50, None, 1), (51, "", 1), (52, "a b c", 1)]
    table = spark.createDataFrame(items, "item_id long, text string, source long")
    want = []
    for d, text, *_ in corpus():
        have = shingle_set(text, 5)
        for i, item, _ in items:
            own = shingle_set(item, 5)
            if own and 10 * len(own & have) >= 8 * len(own):
                want.append((d, i, len(own & have), len(own), len(own & have) / len(own)))
    assert len(want) > 5
    assert rows_of(decontaminate.find_leaks(docs, table)) == sorted(want, key=str)
    left = {r["doc_id"] for r in decontaminate.drop_contaminated(docs, table).collect()}
    assert left == {r[0] for r in corpus()} - {w[0] for w in want if w[0] is not None}


def test_leaks_of_empty_tables(spark, docs, none):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(docs, items).count() == 0
    assert decontaminate.find_leaks(none, items).count() == 0


# --- line dedup


def brute_lines(rows):
    seen, texts = {}, {}
    for d, text in sorted({(r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None}):
        lines = text.split("\n")
        worded = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        key = [lines[i].strip(" \t\n\x0b\x0c\r") for i in worded]
        gone = set()
        for j in range(len(key) - 2):
            w = tuple(key[j : j + 3])
            if seen.setdefault(w, (d, j)) != (d, j):
                gone |= {worded[j], worded[j + 1], worded[j + 2]}
        texts[d, text] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(worded), len(gone))
    return texts


def test_lines_equal_brute_force(docs):
    rows, want = corpus(), []
    done = brute_lines(rows)
    for d, text, *_ in rows:
        alone = sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in (text or "").split("\n"))
        want.append((d, *done.get((d, text), (text, alone, 0))))
    got = rows_of(dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed"))
    assert got == sorted(want, key=str)
    assert sum(w[3] for w in want) >= 50


def test_lines_keep_clashing_columns(spark, none):
    df = spark.createDataFrame([(1, "a\nb\nc", "x", 7), (2, "a\nb\nc\nd", "y", 8)], "doc_id long, text string, of string, n_lines long").withColumn("h", F.lit(1))
    got = {r["doc_id"]: r for r in dedup_lines(df).collect()}
    assert got[2]["text"] == "d" and got[2]["of"] == "y" and got[2]["n_lines"] == 4 and got[1]["n_removed"] == 0
    assert dedup_lines(none).count() == 0


# --- mixing


def test_mixing_targets_and_limits(docs):
    got = mix_sources(docs, keep=["doc_id", "source"]).collect()
    again = mix_sources(docs.repartition(5), keep=["doc_id", "source"])
    assert sorted(map(tuple, got), key=str) == rows_of(again)
    size = {id(r): r["size"] for r in got}
    words = Counter()
    for r in corpus():
        words[r[3]] += len(spaced((r[1] or "").encode()))
    order = sorted((s for s in words if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        left = 1.5 * sum(words.values()) - sum(target.values())
        over = {s for s in open_ if left * weight[s] / sum(weight[o] for o in open_) > 2 * words[s]}
        if not over:
            target |= {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
            break
        target |= {s: 2 * words[s] for s in over}
        open_ -= over
    taken, most = Counter(), defaultdict(int)
    for r in got:
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9) and r["source_size"] == words[r["source"]]
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 2 * size[id(r)]
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    for s in order:
        assert abs(taken[s] - target[s]) <= most[s] * 2


def test_mixing_follows_keys(spark):
    """Within a source the partial epoch is the documents with the smallest keys."""
    rows = [(i, " ".join(["word"] * (10 + i % 7)), "en", "a" if i % 3 else "b", 0) for i in range(300)]
    got = mix_sources(spark.createDataFrame(rows, DOC), keep=["doc_id", "source"]).collect()
    for s in ("a", "b"):
        own = [r for r in got if r["source"] == s]
        target, total = own[0]["target"], own[0]["source_size"]
        rest = target - target // total * total
        upto, picked = 0, set()
        for r in sorted(own, key=lambda r: -math.log((int(hashlib.md5(f"{r['doc_id']}mix".encode()).hexdigest()[:13], 16) + 0.5) / 2**52)):
            if upto + r["size"] / 2 <= rest:
                picked.add(r["doc_id"])
            upto += r["size"]
        assert {r["doc_id"] for r in own if r["taken"] > target // total * r["size"]} == picked


def test_mixing_empty(none):
    assert mix_sources(none).count() == 0


# --- quality


def test_base_rules_equal_brute_force(docs):
    want = []
    for d, text, *_ in corpus():
        text = text or ""
        w = spaced(text.encode())
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        want.append((d, len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)))
    judged = quality.judge_quality(docs)
    assert rows_of(judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == sorted(want, key=str)
    assert not judged.where("base_failed and kept").count()


def test_divergence_of_references(spark, monkeypatch, none):
    monkeypatch.setattr(quality, "HELD_WORDS", 30)
    rnd = random.Random(2)
    clean = [(i, " ".join(rnd.choices(["the", "cat", "sat", "on", "mats", "with", "dogs"] + [f"w{c}" for c in "abcdefghijk"], k=80)), "en", "a", 0) for i in range(400) if i not in (100, 101, 102)]
    junk = [(100, " ".join(f"{rnd.random()}" for _ in range(80)), "en", "a", 0), (101, " ".join(f"X{i}Q!!" for i in range(90)), "en", "a", 0), (102, "12 34 !! 56 78 90 11 22 33 44 55", "en", "a", 0)]
    got = {r["doc_id"]: r for r in quality.judge_quality(spark.createDataFrame(clean + junk, DOC).repartition(4)).collect()}
    assert all(got[i]["kept"] for i in range(60)) and not got[100]["kept"] and not got[101]["kept"]
    assert got[102]["kept"] and got[102]["char_distance"] == 0  # too short to tell
    assert quality.judge_quality(none).count() == 0
    refs = quality.learn_references(spark.createDataFrame(clean, DOC))
    counts = Counter(w for r in clean for w in low(r[1]).split())
    assert refs.shares[0].sum() == sum(counts.values()) and set(refs.words[0]) == set(counts)


def test_every_language_has_a_reference(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK_LANGUAGES", 50)
    rnd = random.Random(8)
    langs = {f"l{i:03}": ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for i in range(140)}
    rows = [(i, " ".join(rnd.choices(words, k=60)), lang, "a", 0) for i, (lang, words) in enumerate(langs.items())]
    docs = spark.createDataFrame(rows, DOC)
    refs = quality.learn_references(docs)
    assert sorted(refs.languages) == sorted(langs) and [len(x.languages) for x in refs.blocks()] == [50, 50, 40]
    junk = spark.createDataFrame([(900, " ".join(f"{i}#{i}" for i in range(60)), "l000", "a", 0), (901, " ".join(f"{i}#{i}" for i in range(60)), "none", "a", 0)], DOC)
    got = {r["doc_id"]: r["kept"] for r in quality.judge_quality(docs.union(junk), refs).collect()}
    assert all(got[i] for i in range(140)) and not got[900] and got[901]  # the last has a language without a reference


def test_distance():
    p, q = np.array([1.0, 0, 3]), np.array([0, 5.0, 0])
    assert quality.distance(p, q) == 1.0 and quality.distance(p, 2 * p) == 0 and quality.distance(p, 0 * p) == 0


# --- language identification


def test_langid_held_out_accuracy(spark, none):
    rnd = random.Random(4)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "éíóúabcd"}
    def text(lang, n):
        return " ".join("".join(rnd.choices(letters[lang], k=rnd.randint(2, 7))) for _ in range(n))
    rows = [(i, text(lang, rnd.choice([5, 30, 200])), lang, "s", 0) for i in range(600) for lang in [rnd.choice(list(letters))]]
    extra = [(9000, None, "aa", "s", 0), (9001, "12 34 ...", "aa", "s", 0), (9002, "", None, "s", 0), (None, text("bb", 40), None, "s", 0), (9003, text("cc", 20_000), None, "s", 0)]
    df = spark.createDataFrame(rows + extra, DOC).repartition(3)
    held = langid.fold("doc_id", 5) == 0
    model = langid.train(df, ~held)
    got = langid.identify(df, model, ["doc_id", "n"]).join(df.select("doc_id", "lang", held.alias("held")), "doc_id").collect()
    out = [r for r in got if r["held"] and r["doc_id"] < 9000]
    assert len(out) > 80 and sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out)
    by = {r["doc_id"]: r for r in langid.identify(df, model, ["doc_id"]).collect()}
    for i in (9000, 9001, 9002):
        assert by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["rejected"]
    assert by[None]["lang_pred"] == "bb" and by[9003]["lang_pred"] == "cc"
    assert all(0 <= r["score"] <= 1 for r in by.values()) and sum(r["rejected"] for r in by.values()) < 0.03 * len(by) + 3
    assert {zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in out} == {True}
    blank = langid.train(none, F.lit(True))
    assert [r["lang_pred"] for r in langid.identify(df.limit(2), blank, ["doc_id"]).collect()] == ["und"] * 2
    assert langid.identify(none, model, ["doc_id"]).count() == 0


@pytest.mark.parametrize("count", [2, 4])
def test_langid_rejects_an_unlearned_language(count):
    rnd = random.Random(6)
    letters = ["abcdef", "ghijkl", "mnopqr", "stuvwx"][:count]
    def text(own, n):
        return " ".join("".join(rnd.choices(own, k=rnd.randint(3, 7))) for _ in range(n))
    model = langid.fit([(text(own, 24), own) for own in letters for _ in range(300)])
    known = [text(own, n) for own in letters for n in (3, 24, 300) for _ in range(20)]
    other = [text("yz0123", n) for n in (8, 24, 300) for _ in range(20)]
    assert model.predict(pa.array(known))[2].sum() <= 0.05 * len(known)
    assert model.predict(pa.array(other))[2].mean() >= 0.95


def test_langid_learns_every_language(spark):
    rnd = random.Random(9)
    words = {f"l{i:03}": ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(6)] for i in range(210)}
    rows = [(4 * i + j, " ".join(rnd.choices(own, k=30)), lang, "s", 0) for i, (lang, own) in enumerate(words.items()) for j in range(4)]
    model = langid.train(spark.createDataFrame(rows, DOC), F.lit(True))
    assert model.languages == sorted(words)
    names, score, rejected = model.predict(pa.array([r[1] for r in rows]))
    assert len(names) == len(rows) and score.shape == rejected.shape == (len(rows),)


# --- language-model scores


@pytest.mark.parametrize("block,part", [(1 << 23, 2_000_000), (900, 200)])
def test_scores_equal_brute_force(docs, monkeypatch, block, part):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm_score, "PART", part)
    caught = {}
    learn = lm_score.maximise
    monkeypatch.setattr(lm_score, "maximise", lambda *a: caught.setdefault("w", learn(*a)))
    got = {(r["doc_id"], r["n_tokens"]): r for r in lm_score.score_texts(docs).collect()}
    texts = [(r[0], zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 7, [*spaced(low(r[1])), None]) for r in corpus()]
    one = Counter(t for _, m, ts in texts if m != 2 for t in ts)
    two = Counter(p for _, m, ts in texts if m != 2 for p in zip([None, *ts], ts, strict=False))
    total, words = sum(one.values()), len(one)
    for d, m, ts in texts:
        r = got[d, len(ts)]
        base = sum(math.log10((one[t] + 1) / (total + words + 1)) for t in ts)
        score = 0.0
        for h, t in zip([None, *ts], ts, strict=False):
            w = caught["w"][min(int(math.log2(one[h])) + 1 if one[h] else 0, lm_score.BUCKETS - 1)]
            score += math.log10(w[0] * (two[h, t] / one[h] if one[h] else 0) + w[1] * one[t] / total + w[2] / (words + 1))
        assert (r["held_out"], r["n_known"], r["train_tokens"]) == (m == 2, sum(one[t] > 0 for t in ts), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-6)
    held = [r for r in got.values() if r["held_out"] and r["doc_id"] != 1003]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_weights_raise_the_likelihood():
    f2, f1, n = np.array([0.5, 0.0, 0.2]), np.array([0.01, 0.02, 0.001]), np.array([5.0, 3.0, 1.0])
    w = lm_score.maximise(np.array([3, 3, 3]), n, f2, f1, 1e-4)[3]
    even = (n * np.log((f2 + f1 + 1e-4) / 3)).sum()
    assert (n * np.log(w[0] * f2 + w[1] * f1 + w[2] * 1e-4)).sum() > even and math.isclose(w.sum(), 1)


def test_scores_empty(none):
    assert lm_score.score_texts(none).count() == 0


# --- WARC


def page_rows():
    return [(i, f"http://x/{i}", ["<p>a</p>", "<p>é</p>", "", None, "x" * 5000][i % 5] if i % 3 else f"<b>{i}</b>", "k") for i in range(40)] + [(7, "http://again", f"own {7}", "k"), (None, None, "only null", "k"), (None, "u\r\nv", "<p>a</p>", None), (39, "http://x/39", "<b>39</b>", "k"), (39, "http://x/39", "<b>39</b>", "k")]


@pytest.mark.parametrize("limit,cut", [(0, 64 << 20), (6, 300)])
def test_round_trip(spark, monkeypatch, limit, cut):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", cut)
    rows = page_rows()
    top = {}
    for i, _, html, _ in rows:
        p = (html or "").encode()
        top[p] = max(top.get(p, -1), -1 if i is None else i)
    want = []
    for i, _, html, _ in rows:
        p = (html or "").encode()
        again = len(p) >= limit and top[p] >= 0 and top[p] != i
        want.append((i, len(p), warc.digest_of(p), "revisit" if again else "response", top[p] if again else None))
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, sha string").repartition(2), limit)
    assert rows_of(got) == sorted(want, key=str)


def test_archive_ranges_and_zip64(monkeypatch):
    import zipfile

    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    w = warc.ArchiveWriter(out)
    for i in range(5):
        w.add(warc.pack_record(i, None, b"payload %d" % i, 9 if i == 2 else None, i == 2))
    assert w.close() == 5
    raw = out.getvalue()
    assert b"PK\x06\x06" in raw and b"PK\x06\x07" in raw
    reader = warc.ArchiveReader(io.BytesIO(raw), len(raw))
    got = list(reader.records(1, 3))
    assert [(r.page_id, r.kind, r.payload, r.payload_bytes, r.refers_to) for r in got] == [(1, "response", b"payload 1", 9, None), (2, "revisit", b"", 9, 9), (3, "response", b"payload 3", 9, None)]
    assert not list(reader.records(5, 10))
    with pytest.raises(ValueError):
        warc.ArchiveReader(io.BytesIO(raw[:-30]), len(raw) - 30)


def test_round_trip_of_nothing(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- URL filter


def test_urls_equal_brute_force(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.net", "", "allow"), ("net", "/es", "allow"), ("org", "/x", "block"), ("org", "/x", "allow"), (None, "/", "block")]
    rnd = random.Random(3)
    hosts = ["example.com", "www.example.com", "WWW.Example.COM", "xexample.com", "a.net", "b.a.net", "net", "org", "u.org", "", "com.", "h:80", "x.com:80"]
    urls = [f"{rnd.choice(['http', 'ftp', ''])}://{rnd.choice(hosts)}{rnd.choice(['', '/', '/en/', '/en', '/es/q', '/x', '/EN/', '/xy/z'])}{rnd.choice(['', '?q=/en/', '#://z'])}" for _ in range(300)]
    rows = [(i, u, "h", "v") for i, u in enumerate(urls)] + [(900, None, "h", "v"), (901, "no scheme", "h", "v"), (None, urls[0], "h", "v"), (902, "http://" + "a." * 500 + "com/" + "p" * 5000, "h", "v"), (0, urls[0], "h", "v")]
    want = []
    for i, url, *_ in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
        fit = [(len(h + p), len(p), a == "block", h, p, a) for h, p, a in rules if h and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        want.append((i, host, path, best and best[3] + best[4], best[5] if best else "allow"))
    table = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    got = url_filter.judge_urls(table, spark.createDataFrame(rules, "host string, path string, action string"), keep=["page_id"])
    assert rows_of(got) == sorted(want, key=str)
    assert url_filter.judge_urls(table.limit(0), url_filter.rule_table(spark, rules[:2])).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(table, url_filter.rule_table(spark, []), default="block").collect()} == {"block"}


# --- text helpers


def test_words_and_shingles():
    from helixframe.llm import text as tx

    texts = [r[1] for r in corpus()]
    hashes, at = tx.word_hashes(*tx.bytes_of(pa.array(texts)))
    known = {}
    for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
        words = spaced(low(t))
        assert len(words) == b - a
        for w, h in zip(words, hashes[a:b], strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    assert [len(s) for s in tx.shingle_sets(pa.array(texts), 3)] == [len(shingle_set(t, 3)) for t in texts]
