"""Ranked search, packing along the curve and spelling variants against plain Python, on edge tables and in every branch."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphsieve.llm import common, curve, search, variants
from graphsieve.llm import kernels as K

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {k: k + 32 for k in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain_search(docs, items, k=10):
    """docs: (doc_id, text), items: (item_id, text) -> sorted (item, rank, doc_id, score)."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, words in asked.items():
        scored = []
        for i, c, length in counted:
            m = 100 - 90 + (90 * length * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in words if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def ranked(df, item="item"):
    return sorted(((r[item], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def corpus(seed, n=400, vocabulary=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé7") for _ in range(rng.randint(1, 4))) for _ in range(vocabulary)]
    weights = [1 / (k + 1) for k in range(vocabulary)]
    text = lambda: " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 3, 8, 40]))).upper() if rng.random() < 0.2 else ", ".join(rng.choices(words, weights, k=rng.choice([1, 5, 20, 60])))
    docs = [(k, text()) for k in range(n)]
    docs += [(7, docs[3][1]), (900, docs[3][1]), (901, docs[3][1]), (902, None), (903, " ,;"), (None, docs[5][1]), (904, "zz " * 5000)]
    rng.shuffle(docs)
    items = [(k, ", ".join(rng.choices(words, k=rng.randint(1, 12)))) for k in range(25)] + [(3, words[0]), (30, docs[0][1]), (31, None), (32, "unheard"), (None, words[2] + " " + words[9])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_search_is_the_plain_ranking(spark, seed):
    docs, items = corpus(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    want = plain_search(docs, items)
    for size, block in ((1 << 24, 256), (300, 4)):
        index = search.RankedIndex(d, segment_bytes=size)
        assert ranked(index.search(i, block=block)) == want
    assert ranked(index.search(i, k=3)) == [x for x in want if x[1] <= 3]
    other = [(1, items[4][1]), (2, "zz")]
    assert ranked(index.search(spark.createDataFrame(other, "item_id long, text string"))) == plain_search(docs, other)


def test_search_shuffles_where_sides_are_large(spark, monkeypatch):
    docs, items = corpus(4)
    monkeypatch.setattr(common, "MAX_BROADCAST", -1)
    got = search.RankedIndex(spark.createDataFrame(docs, "doc_id long, text string")).search(spark.createDataFrame(items, "item_id long, text string"))
    assert ranked(got) == plain_search(docs, items)


def test_search_of_empty_tables_and_other_names(spark):
    docs, items = corpus(5, 40)
    d = spark.createDataFrame([(*x, 1, 2.0) for x in docs], "id long, body string, item int, block double")
    i = spark.createDataFrame([(f"q{k}", t, 1) for k, t in items[:5]], "tid string, seg string, doc_id int")
    index = search.RankedIndex(d, "id", "body")
    assert ranked(index.search(i, id_col="tid", text_col="seg")) == plain_search(docs, [(f"q{k}", t) for k, t in items[:5]])
    assert index.search(i.limit(0), id_col="tid", text_col="seg").count() == 0
    assert search.RankedIndex(d.limit(0), "id", "body").search(i, id_col="tid", text_col="seg").count() == 0


def test_pruned_merge_keeps_ties():
    rng = random.Random(9)
    for _ in range(300):
        lists = []
        for _ in range(rng.randint(1, 7)):
            numbers = sorted(rng.sample(range(60), rng.randint(1, 40)))
            shares = [rng.choice([1, 1, 2, 9]) * rng.choice([1, 50]) for _ in numbers]
            lists.append((max(shares), numbers, shares))
        heap, ids, k = [], list(range(60)), rng.randint(1, 12)
        search._best(lists, heap, k, ids)
        total = Counter()
        for _, numbers, shares in lists:
            total.update(dict(zip(numbers, shares, strict=True)))
        assert sorted(((s, -d) for s, d in heap), key=lambda x: (-x[0], x[1])) == sorted(((s, d) for d, s in total.items()), key=lambda x: (-x[0], x[1]))[:k]


def test_varints():
    rng = np.random.default_rng(3)
    values = np.concatenate((np.arange(300), rng.integers(0, 1 << 62, 500), [0, 127, 128, (1 << 63) - 1]))
    data, ends = search.varints(values)
    assert (search.unvarints(data.tobytes()) == values).all() and ends[-1] == len(data) and len(search.unvarints(b"")) == 0


# ---- packing along the curve


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def odd_texts(n, seed):
    rng = random.Random(seed)
    parts = ["a", "word", " ", "  ", "\n", "\n ", "\n\n", "é", "ß", "日", "　", " ", "'s", " 's", "<|endoftext|>", "1", "23", ".", ",", "\t", "\x1c", "\x85", "😀", "Ab", "ȿ", "ɐ", "×", "÷", "ø", "!", '"', ")", ":", "it'll"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_encoder_gives_the_tokenizers_ids(tokenizer, monkeypatch):
    texts = odd_texts(4000, 1) + ["x" * 100_000, "", " ", "\n"]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for limit in (1_000_000, 50):
        monkeypatch.setattr(curve, "REMEMBERED", limit)
        known = curve.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
        for i, j, data, offs in K.chunks(pa.array(texts), 2000):
            ids, sizes = known.encode(data, offs)
            ends = np.cumsum(sizes)
            assert [ids[e - s : e].tolist() for s, e in zip(sizes, ends, strict=True)] == want[i:j]


def test_encoder_survives_equal_digests(tokenizer, monkeypatch):
    monkeypatch.setattr(K, "digests", lambda data, starts, ends: ((ends - starts).astype(np.uint64), np.add.reduceat(data.astype(np.uint64), starts)))
    texts = [" foo bar", " bar foo", "x y"]
    known = curve.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    (_, _, data, offs), *_ = K.chunks(pa.array(texts))
    ids, sizes = known.encode(data, offs)
    assert ids.tolist() == [x for t in texts for x in tokenizer.encode(t, add_special_tokens=False).ids] and len(sizes) == 3


def test_hilbert_curve_visits_every_cell_by_unit_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = curve.hilbert(cells, bits)
        order = cells[np.argsort(keys)]
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def check_pieces(rows, docs, tokenizer, capacity, with_ids):
    """Every id in exactly one piece, sequences without gaps, digests of the true ids."""
    full = {}
    for doc, text in docs:
        full.setdefault(doc, []).append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0])
    assert all(len(x) == 1 for x in full.values())
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert by_doc.keys() == full.keys()
    for doc, pieces in by_doc.items():
        ids, at = full[doc][0], 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] == len(part) > 0 and zlib.crc32(part.tobytes()) == r["ids_crc32"]
            if with_ids:
                assert np.frombuffer(r["ids"], "<u2").tolist() == part.tolist()
            at += r["length"]
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, parts in by_sequence.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == capacity or k == len(by_sequence) - 1 and 0 < at <= capacity


@pytest.mark.parametrize("limit", [8 << 20, -1])
def test_packing_along_the_curve(spark, tokenizer, monkeypatch, limit):
    monkeypatch.setattr(common, "MAX_BROADCAST", limit)
    texts = odd_texts(120, 2) + [None, "", "long " * 3000, "x" * 20_000] + ["the same words again and again"] * 60
    docs = list(enumerate(texts)) + [(None, "no id")]
    rows = [(d, t, "c", 1) for d, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, part int").repartition(3)
    got = curve.pack_along_curve(df, capacity=64)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    found = got.collect()
    check_pieces(found, docs, tokenizer, 64, True)
    # copies lie side by side
    copies = {r["sequence_id"] for r in found if r["doc_id"] is not None and 124 <= r["doc_id"] < 184}
    assert max(copies) - min(copies) + 1 == len(copies)
    assert curve.pack_along_curve(df.limit(0)).count() == 0


def test_repeated_rows_are_packed_each(spark):
    df = spark.createDataFrame([(1, "a b c")] * 50 + [(2, "d")], "doc_id long, text string").repartition(4)
    got = curve.pack_along_curve(df, capacity=16, with_ids=False).collect()
    tokens = {r["doc_id"]: r["doc_tokens"] for r in got}
    assert sum(r["length"] for r in got) == 50 * tokens[1] + tokens[2]
    places = sorted(r["sequence_id"] * 16 + r["offset"] + k for r in got for k in range(r["length"]))
    assert places == list(range(len(places)))


# ---- spelling variants


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(counts, factor=10):
    near = {w: [x for x in counts if distance_one(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        good = sorted((-counts[x], x.encode()) for x in near[w] if counts[x] >= factor * n)
        form[w] = good[0][1].decode() if good else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("long", [128, 5])
@pytest.mark.parametrize("limit", [8 << 20, -1])
def test_spelling_forms(spark, monkeypatch, long, limit):
    monkeypatch.setattr(common, "MAX_BROADCAST", limit)
    rng = random.Random(long)
    counts = {}
    for _ in range(350):
        counts["".join(rng.choice("aabÿ") for _ in range(rng.randint(2, 8)))] = rng.choice([2, 3, 25, 30, 300, 3000, 40_000])
    counts |= {"": 2, "x" * 3000: 5, "x" * 2999: 50, "x" * 2998: 500, "abc" * 400: 2, "abc" * 400 + "c": 20}
    words = spark.createDataFrame([*counts.items(), (None, 4)], "word string, n int")
    got = variants.spelling_forms(words, long=long)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(counts) and set(rows) == plain_forms(counts)
    assert variants.spelling_forms(words.limit(0)).count() == 0


def test_deletions_are_distinct(spark):
    words = ["", "a", "aab", "abab", "ééé", "aabbcca"]
    got = variants.deletions(spark.createDataFrame([(w,) for w in words], "word string"), ["word"]).collect()
    want = sorted((w, k) for w in words for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))})
    assert sorted((r["word"], r["key"]) for r in got) == want


def test_words_of_documents(spark):
    docs = [(1, "Straße, façade2FAÇADE don't ÀÖÿ×÷"), (2, None), (None, "Nothing nothing"), (3, ""), (4, "ab" * 40_000)]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, doc int")
    want = []
    for d, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(UPPER)
            if len(w) >= 2:
                h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
                want.append(w[: h % len(w)] + w[h % len(w) + 1 :] if h % 3 == 0 else w)
    got = [r["word"] for r in variants.damaged(variants.runs(df, 2), 3).collect()]
    assert sorted(got) == sorted(want)


def test_statements_on_edge_tables(spark, tmp_path):
    """Queries and their SQL over nulls, empty and long texts and repeated rows."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abc") for _ in range(rng.randint(6, 9))) for _ in range(40)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 80))) for _ in range(80)] + [None, "", "Ünïcode ünïcode", "word " * 20_000]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(3, texts[3])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(texts[:12])] + [(90, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for query, sql in ((search.op11, search.OP11_SQL), (variants.op13, variants.OP13_SQL)):
        df = query(spark, str(tmp_path))
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in df.select(*names).collect())
    pieces = curve.op12(spark, str(tmp_path)).agg(F.sum("length"), F.count_distinct("doc_id")).first()
    assert pieces[1] == len(texts) and pieces[0] > 0
