"""Brute-force checks of the corpus operators on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphsieve.llm import chunking, decontaminate, kernels, langid, lines, mil, minhash, packing, quality, sharding, warc
from graphsieve.llm.components import components
from graphsieve.llm.common import Work

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghéß") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    texts = []
    for _ in range(n):
        t = " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 90)))
        texts.append("\n".join(t[i : i + 60] for i in range(0, len(t), 60)) if rng.random() < 0.4 else t)
    for k in range(12):  # near and exact copies
        t = texts[k].split(" ")
        if len(t) > 3 and k % 2:
            t[len(t) // 2] = "changed"
        texts.append(" ".join(t))
    texts += [None, "", " \t\n ", "one", "ONE", "É é", "x " * 3000 + "end", "same line\nsame line\nother\n\n", "Boiler Plate \nA", "boiler plate\nB"]
    texts += ["boiler plate\nrow %d" % k for k in range(12)]
    return [(i, t, "en", f"s{i % 3}", None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    rows.append(rows[3])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_kernel_words_and_windows():
    texts = ["a  b\tc", "", "É b a b\x0bc", None, "z"]
    data, offs = kernels.buffers(pa.array(texts))
    w = kernels.Words(data, offs)
    got = [[data[a:b].tobytes().decode() for a, b, r in zip(w.starts, w.ends, w.rows) if r == k] for k in range(len(texts))]
    assert got == [words(t) for t in texts]
    flat = [x for t in texts for x in words(t)]
    by = {}
    for x, h in zip(flat, w.hashes.tolist()):
        assert by.setdefault(x, h) == h
    assert len(set(by.values())) == len(by)
    pairs = kernels.windows(w.hashes, 2)
    assert pairs[1] != pairs[3] and len(pairs) == len(flat) - 1


def test_sharding(spark, docs):
    out = sharding.external_shuffle(docs.withColumn("shard", F.lit("x")), 7, bucket_bytes=4000)
    rows = out.collect()
    assert sorted(map(str, (r[:5] for r in rows))) == sorted(map(str, (tuple(r) for r in docs.collect())))
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by.get(k, [])) for k in range(7)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    again = sharding.external_shuffle(docs.repartition(3), 7, bucket_bytes=4000).select("doc_id", "shard", "slot").collect()
    assert sorted(again) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows)
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["slot"], r["shard"]))]
    assert order != sorted(order)
    assert sharding.external_shuffle(empty(spark), 3).count() == 0


def test_sharding_repeated_rows_are_split(spark):
    same = spark.range(0, 400, 1, 8).select(F.lit(1).cast("long").alias("doc_id"), F.repeat(F.lit("y"), 200).alias("text"))
    rows = sharding.external_shuffle(same, 4, bucket_bytes=8000).collect()
    assert len(rows) == 400 and len({(r["shard"], r["slot"]) for r in rows}) == 400


def test_lines(spark, docs):
    out = {}
    for r in lines.drop_frequent_lines(docs.withColumn("n_lines", F.lit(1)).withColumn("_row", F.lit(2))).collect():
        out.setdefault(r["doc_id"], []).append((r["kept_text"], r["n_lines"], r["n_dropped"]))
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UP)
    rows = docs.collect()
    found = {}
    for k, r in enumerate(rows):
        for x in (r["text"] or "").split("\n"):
            found.setdefault(key(x), set()).add(k)
    hot = {x for x, s in found.items() if x and len(s) >= 10}
    assert "boiler plate" in hot
    for r in rows:
        all_ = (r["text"] or "").split("\n")
        keep = [x for x in all_ if key(x) not in hot]
        assert ("\n".join(keep), len(all_), len(all_) - len(keep)) in out[r["doc_id"]]
    assert sum(map(len, out.values())) == len(rows)
    assert lines.drop_frequent_lines(empty(spark)).count() == 0


def test_line_runs_levels(spark):
    runs = lines.LineRuns(spark, fanout=2)
    batch = lambda *k: spark.createDataFrame([(bytes([x]), 1) for x in k], "h binary, n long")
    for k in range(5):
        runs.add(batch(k, k + 1))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {r["h"][0]: r["n"] for r in runs.counts().collect()} == {0: 1, 1: 2, 2: 2, 3: 2, 4: 2, 5: 1}
    assert sorted(r["h"][0] for r in runs.unseen(batch(4, 9, 7)).collect()) == [7, 9]


def shingles(text):
    w = words((text or "").translate(UP))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash_against_all_pairs(spark, docs, percent):
    rows = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(rows)
    for a in ids:
        for b in ids:
            u = len(rows[a] | rows[b])
            if a < b and u and 100 * len(rows[a] & rows[b]) >= percent * u:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = minhash.near_duplicates(docs, percent).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(rows[r["id"]]), find(r["id"]), find(r["id"]) == r["id"])


def test_minhash_unsettled_bucket_and_nulls(spark):
    base = [f"w{k}" for k in range(200)]
    chain = []
    for k in range(12):  # each links with the next, the ends don't link
        chain.append(" ".join(base))
        base[10 + 7 * k] = f"new{k}"
    rows = [(i, t) for i, t in enumerate(chain)] + [(None, chain[0]), (50, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert {r["component_id"] for r in got if r["id"] is not None and r["id"] < 12} == {0}
    assert next(r for r in got if r["id"] is None)["component_id"] is None
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_bit_estimate_is_close():
    rng = np.random.default_rng(0)
    s = minhash.Scheme().longer()
    a, b = s.hashes()
    x = rng.integers(0, 2**64, 900, dtype=np.uint64)
    y = np.concatenate((x[:800], rng.integers(0, 2**64, 100, dtype=np.uint64)))
    got = minhash.estimate(minhash.pack(minhash.minima(x, a, b)), minhash.pack(minhash.minima(y, a, b)), s.size)
    assert abs(got - 0.8) < 0.08


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (30, 30), (21, 20)], "a long, b long")
    got = {r["v"]: r["comp"] for r in components(links, Work(spark, "t"), "c").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20, 30: 30}
    assert components(links.limit(0), Work(spark, "t"), "c").count() == 0


def test_quality_statistics(docs):
    rows = docs.collect()
    for r in rows:
        t = r["text"] or ""
        w = words(t)
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        hit = {i + j for i, x in enumerate(win) if win.count(x) > 1 for j in range(5)} if len(w) < 500 else set(range(len(w) - 1))
        ls = [x for x in t.split("\n") if words(x)]
        want = [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(ls) - len(set(ls)), len(hit)]
        data, offs = kernels.buffers(pa.array([t]))
        assert quality.statistics(data, offs)[0][0].tolist() == want, t[:80]


def test_quality_rules(spark, docs):
    rng = np.random.default_rng(3)
    x = rng.random((600, 3))
    y = (x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=600) > 0).astype(float)
    model = quality.boost(x, y, np.array([1, -1, 0]), trees=30)
    assert ((model.score(x) > 0.5) == y).mean() > 0.93
    line = np.linspace(0, 1, 50)
    up = model.score(np.column_stack([line, np.full(50, 0.5), np.full(50, 0.5)]))
    down = model.score(np.column_stack([np.full(50, 0.5), line, np.full(50, 0.5)]))
    assert (np.diff(up) >= -1e-12).all() and (np.diff(down) <= 1e-12).all()
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    out = quality.apply_rules(docs.withColumn("score", F.lit("x")), quality.train_rules(docs, labels)).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert all(not r["kept"] for r in out if r["n_words"] < 10)
    none = quality.train_rules(docs, labels.limit(0))
    assert quality.apply_rules(empty(spark), none).count() == 0


def test_language(spark):
    rng = random.Random(5)
    make = {"aa": "abcde ", "bb": "defgh ", "cc": "xyzéß "}
    rows = [(i, "".join(rng.choice(make[k]) for _ in range(200)), k) for i in range(90) for k in [list(make)[i % 3]]]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 !", "bb"), (902, "", None), (903, "a", None)], "doc_id long, text string, lang string")
    langs, logs = langid.train(docs.filter("doc_id % 2 = 0"))
    assert langs == ["aa", "bb", "cc"]
    got = {r["doc_id"]: r for r in langid.predict(docs.withColumn("score", F.lit(1)), langs, logs).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] == "aa"
    assert langid.train(docs.limit(0)) [0] == []
    assert {r["lang_pred"] for r in langid.predict(docs, [], np.zeros((0, langid.DIMS + 1))).collect()} == {"und"}


def test_attention_quality(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(150))
    bad = lambda: " ".join(rng.choice(["###", "|", "spam!!", "$$$"]) for _ in range(150))
    rows = [(i, good() if i % 2 else good() + " " + bad()) for i in range(120)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    out = {r["doc_id"]: r["score"] for r in mil.score(docs, mil.train(docs, labels)).collect()}
    assert sum((out[i] > 0.5) == bool(i % 2) for i in range(80, 120)) >= 38
    assert out[200] == out[201] and all(0 <= x <= 1 for x in out.values())
    assert mil.score(empty(spark), mil.train(docs, labels.limit(0))).count() == 0


def test_attention_gradient_sums():
    rng = np.random.default_rng(1)
    w = [rng.normal(size=s) for s in ((4, 3), (3, 2), (3, 2), (2,), (4,))]
    x, first = rng.normal(size=(7, 4)), np.array([0, 3, 4])
    _, _, _, of, a, z, p = mil._forward(x, first, w)
    assert np.allclose(np.bincount(of, a), 1) and z.shape == (3, 3) and ((p > 0) & (p < 1)).all()


def test_chunks_resist_insertions():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 123, 4000).astype(np.uint8).tobytes().decode()
    def cuts(t):
        data, offs = kernels.buffers(pa.array([t]))
        a, b, _ = chunking.cut(data, offs)
        assert a[0] == 0 and b[-1] == len(t.encode()) and (a[1:] == b[:-1]).all() and (b - a).max() <= chunking.MOST
        return {t.encode()[i:j] for i, j in zip(a, b)}
    one, two = cuts(text), cuts(text[:100] + "inserted é" + text[100:])
    assert len(one & two) >= len(one) - 4
    data, offs = kernels.buffers(pa.array(["é" * 500, "", "b" * 500]))
    a, b, rows = chunking.cut(data, offs)
    for i, j in zip(a, b):
        data[i:j].tobytes().decode()
    assert set(rows.tolist()) == {0, 2}


def test_substring_dedup(spark):
    rng = random.Random(4)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    passage = fresh(60)
    rows = [(5, fresh(30) + " " + passage + " " + fresh(20)), (2, fresh(10) + " " + passage), (9, fresh(80)), (7, None), (8, ""), (11, passage + " é " + fresh(5)), (9, None)]
    rows += [rows[0]]
    got = chunking.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").withColumn("owners", F.lit(0))).collect()
    by = {(r["doc_id"], r["text"]): r for r in got}
    assert len(got) == len(rows)
    assert by[rows[2]]["n_shared"] == 0 and by[rows[1]]["n_dropped"] == 0 and by[rows[1]]["n_shared"] > 0
    for row in (rows[0], rows[5]):
        r = by[row]
        assert r["owners"] == [2] and r["dropped_bytes"] > 150
        raw = row[1].encode()
        assert all(raw[a:b].decode() in passage for a, b in r["dropped"])
        assert len(r["kept_text"].encode()) == len(raw) - r["dropped_bytes"]
    assert by[(7, None)]["n_chunks"] == 0 and by[(8, "")]["kept_text"] == ""
    assert chunking.drop_repeats(empty(spark)).count() == 0


def test_substring_dedup_misses_no_passage_of_51_words(spark):
    rng = random.Random(8)
    rows, passages = [], {}
    for k in range(900):
        longest = (1, 4, 9)[k % 3]
        some = lambda n, m=longest: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, m))) for _ in range(n))
        passages[2 * k + 1] = some(51)
        rows += [(2 * k + x, f"{some(rng.randint(0, 40))} {passages[2 * k + 1]} {some(rng.randint(0, 40))}") for x in (0, 1)]
    got = {r["doc_id"]: r for r in chunking.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    texts = dict(rows)
    for d in passages:
        raw = texts[d].encode()
        lost = max((b - a, raw[a:b].decode()) for a, b in got[d]["dropped"])[1]
        assert d - 1 in got[d]["owners"] and len(lost.split()) >= chunking.SURE_WORDS
    assert all(got[d - 1]["n_shared"] > 0 for d in passages)


def test_best_fit_against_a_plain_search():
    rng = random.Random(6)
    items = sorted(((rng.randint(1, 50), rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([None, *range(40)])) for _ in range(300)), key=lambda x: -x[0])
    got = packing.best_fit([x[0] for x in items], [x[1] for x in items], [x[2] for x in items], 100)
    bins = []
    for (size, source, cluster), (k, start) in zip(items, got):
        fits = [(100 - sum(x[0] for x in b), i) for i, b in enumerate(bins) if sum(x[0] for x in b) + size <= 100 and all((source is None or x[1] != source) and (cluster is None or x[2] != cluster) for x in b)]
        assert k == (min(fits)[1] if fits else len(bins))
        if k == len(bins):
            bins.append([])
        assert start == sum(x[0] for x in bins[k])
        bins[k].append((size, source, cluster))


def test_packing(spark, docs):
    out = packing.pack(packing.measure(docs), docs.count(), capacity=100, group=20).collect()
    size = {r["doc_id"]: len(words(r["text"])) + 1 for r in docs.collect()}
    total, bins = {}, {}
    for r in out:
        total[r["id"]] = total.get(r["id"], 0) + r["size"]
        bins.setdefault(r["bin"], []).append((r["start"], r["size"]))
    assert {k: v for k, v in total.items() if k != 3} == {k: v for k, v in size.items() if k != 3} and total[3] == 2 * size[3]
    for b in bins.values():
        at = 0
        for start, n in sorted(b):
            assert start == at
            at += n
        assert at <= 100
    assert packing.pack(packing.measure(empty(spark)), 0).count() == 0


def test_decontamination(spark):
    rng = random.Random(9)
    vocab = [f"w{k}é" if k % 7 == 0 else f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 13, 30])))) for k in range(12)] + [(20, None), (21, "?!"), (3, "solo-word pair")]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(60))) for i in range(30)]
    rows += [(100 + k, " ".join(rng.choice(vocab) for _ in range(20)) + ", " + t.upper().replace("É", "é") + "! " + " ".join(rng.choice(vocab) for _ in range(9))) for k, t in items[:12]]
    rows += [(200, None), (201, ""), (202, items[2][1] + " " + items[2][1]), (203, "Solo word, PAIR"), (203, "Solo word, PAIR")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_hit", F.lit(1)).withColumn("doc", F.lit(2))
    got = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    tok = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(UP))
    assert len(got) == len(rows)
    for r in got:
        w, hit, names = tok(r["text"]), set(), set()
        for k, t in items:
            q = tok(t)
            n = min(13, len(q))
            for s in range(len(q) - n + 1) if n else ():
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == q[s : s + n]:
                        hit |= set(range(i, i + n))
                        names.add(str(k))
        assert (r["n_words"], r["n_hit"], r["n_items"], r["item_ids"], r["contaminated"]) == (len(w), len(hit), len(names), sorted(names), bool(hit) and 20 * len(hit) >= len(w))
    assert sum(r["n_hit"] > 0 for r in got) >= 14
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).filter("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_items_without_id_are_hit(spark):
    words = [" ".join(f"{c}{k}" for k in range(15)) for c in "abc"]
    items = spark.createDataFrame([(None, words[0]), (None, words[1]), (7, words[1]), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"x {t} y") for k, t in enumerate([words[0], words[1], words[2], " ".join(words[:2])])], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["item_ids"], r["contaminated"]) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {0: (15, 1, [], True), 1: (15, 2, ["7"], True), 2: (0, 0, [], False), 3: (30, 2, ["7"], True)}


def test_proximity(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefghij") * 2 for _ in range(40))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc long, text string").withColumn("doc2", F.lit(0))
    index = decontaminate.PositionalIndex(Work(spark, "near"), docs, "text")
    items = spark.createDataFrame([(1, ["aa", "bb", "cc"]), (2, ["jj", "zz"]), (3, ["dd", "ee", "ff", "gg"])], "item long, words array<string>")
    got = {(r["doc"], r["item"]) for r in index.near(items, 6).collect()}
    want = set()
    for i, t in rows:
        w = t.split()
        for k, q in ((1, "aa bb cc"), (2, "jj zz"), (3, "dd ee ff gg")):
            if any(set(q.split()) <= set(w[s : s + 6]) for s in range(len(w))):
                want.add((i, k))
    assert got == want and want


def test_warc(spark):
    html = ["<p>é</p>", "<p>é</p>", "", None, "<b>", "<p>é</p>", "x" * 50000, "<b>"]
    urls = ["http://A.example.com/x?y=1#z", None, "not a url", "https://b.example.com:8080/", "http://a.example.com/x?y=1", "http://[bad", "ftp://x/", "http://a.example.com/x?y=1"]
    rows = [(10 * k + 3, u, h) for k, (u, h) in enumerate(zip(urls, html))] + [(3, urls[0], html[0]), (None, "http://q/", "q"), (None, "http://q/", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.CaptureIndex(pages, shards=3)
    got = index.lookup(warc.capture_keys(pages)).collect()
    assert len(got) == len(rows)
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    seen = set()
    for r in got:
        payload = (r["payload"] or b"").decode()
        if r["record_type"] == "response":
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()
            assert r["payload_bytes"] == len(payload.encode()) and payload not in seen
            seen.add(payload)
            assert r["refers_to"] is None and (r["page_id"] is None or first[payload] == r["page_id"])
    assert seen == {h or "" for _, _, h in rows}
    by = {(p, base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()): (len((h or "").encode()), first.get(h or "")) for p, _, h in rows}
    for r in got:
        size, ref = by[(r["page_id"], r["payload_digest"])]
        assert r["payload_bytes"] == size and (r["record_type"] == "response" or r["refers_to"] == ref)
    assert index.lookup(spark.createDataFrame([("none",), ("com,example,a)/x?y=1 00000000000000000003",)], "key string")).count() == 2
    short = warc.CaptureIndex(pages, min_bytes=1000)
    assert {r["record_type"] for r in short.lookup(warc.capture_keys(pages)).collect()} == {"response"}
    assert warc.CaptureIndex(pages.limit(0)).lookup(warc.capture_keys(pages.limit(0))).count() == 0


def test_held_out_is_crc32(spark):
    from graphsieve.llm.common import held_out

    got = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", held_out(5, 0).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
