"""Registered queries and pipeline stages on edge tables, clashing columns, repeated ids, and layouts."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphsieve.llm import chunking, common, decontaminate, langid, lines, mil, minhash, packing, quality, registry, sharding, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folders of tables with nulls, empty and very long texts, ties and repeats, and of empty tables."""
    rng, out = random.Random(5), {}
    good = [prose(rng, 60) for _ in range(24)]
    texts = [*good, None, "", " \n\t", "short", good[0], good[1] + " more", good[2].upper(), prose(rng, 30_000), "x" * 100_000]
    docs = [(k, t, "en" if k % 3 else "de", f"s{k % 4}", k) for k, t in enumerate(texts)] + [(4, good[4], "en", "s1", 7), (5, prose(rng, 50), None, None, None), (None, good[6], "en", "s2", 1), (None, None, None, None, None)]
    item = " ".join(good[8].split()[5:30])
    rows = {
        "documents": (docs, DOCS), "labels": ([(k, k % 2, 0) for k in range(20)] + [(3, 0, 0), (None, 1, None), (4, None, None)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(1, item), (2, item), (3, None), (None, "")], "item_id long, text string"),
        "pages": ([(1, "http://a.b/c", "<p>x"), (2, "http://a.b/c", "<p>x"), (2, "http://a.b/d", "<p>x"), (1, "http://z", "<p>x"), (1, "http://a.b/c", "<p>x"), (3, None, None), (4, "", ""), (None, "http://q", "<p>x"), (5, "http://long", "y" * 300_000)], "page_id long, url string, html string"),
    }
    for name, keep in (("edge", True), ("none", False)):
        out[name] = str(tmp_path_factory.mktemp(name))
        for table, (values, schema) in rows.items():
            spark.createDataFrame(values if keep else [], schema).write.parquet(f"{out[name]}/{table}.parquet")
    return out


COLUMNS = {
    "op1_sharding": "doc_id size text_crc32 law shard slot grown_shard", "op2_minhash": "doc_id n_shingles component_id kept", "op3_attention_quality": "doc_id held_out score predicted",
    "op4_substring_dedup": "doc_id n_chunks n_shared n_dropped dropped_bytes owners kept_sha256", "op5_line_dedup": "doc_id n_lines n_dropped kept_sha256", "op6_language_id": "doc_id held_out lang_pred score",
    "op8_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed score kept", "op9_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op10_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_queries_on_edge_tables(spark, tables, name):
    got = registry.QUERIES[name](spark, tables["edge"]).collect()
    source = "pages" if name == "op9_warc" else "documents"
    key = "page_id" if name == "op9_warc" else "doc_id"
    rows = spark.read.parquet(f"{tables['edge']}/{source}.parquet").collect()
    assert sorted(map(str, (r[key] for r in got))) == sorted(map(str, (r[key] for r in rows)))
    none = registry.QUERIES[name](spark, tables["none"])
    assert none.columns == COLUMNS[name].split() and none.count() == 0
    by = {}
    for r in got:
        by.setdefault(r[key], []).append(r)
    if name == "op1_sharding":
        assert sorted((r["shard"], r["slot"]) for r in got) == sorted((k % 40, k // 40) for k in range(len(rows)))
    if name == "op2_minhash":
        assert {k: by[k][0]["component_id"] for k in (0, 28, 1, 29, 2, 30, 24, 25)} == {0: 0, 28: 0, 1: 1, 29: 1, 2: 2, 30: 2, 24: 24, 25: 25}
    if name == "op3_attention_quality":
        assert by[24][0]["score"] == by[25][0]["score"] and by[0][0]["score"] == by[28][0]["score"] and by[4][0]["score"] == by[4][1]["score"]
        assert all(r["predicted"] == (r["score"] >= 0.3) for r in got)
    if name == "op6_language_id":
        assert {r["lang_pred"] for r in got} <= {"en", "de", "und"} and all(by[k][0]["lang_pred"] == "und" for k in (24, 25, 26))
    if name == "op9_warc":
        kinds = [(r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"] == 4]
        assert sorted(kinds, key=str) == sorted([(1, "response", None), *[(1, "revisit", 1)] * 2, *[(2, "revisit", 1)] * 2, (None, "revisit", 1)], key=str)
        assert (by[3][0]["record_type"], by[4][0]["record_type"], by[4][0]["refers_to"]) == ("response", "revisit", 3)
    if name == "op10_decontamination":
        assert by[8][0]["contaminated"] and by[8][0]["n_items"] == 2 and by[8][0]["n_hit"] == 25
        assert by[8][0]["items_sha256"] == hashlib.sha256(b"1,2").hexdigest() and not by[9][0]["contaminated"]


def test_packing_of_edge_tables(spark, tables):
    for name, n in (("edge", 37), ("none", 0)):
        assert registry.QUERIES["op7_packing"](spark, tables[name]).select("doc_id", "piece").filter("piece = 0").count() == n


def test_pipeline_stages(spark, tables):
    """Every stage against plain Python on its own input."""
    docs = spark.read.parquet(f"{tables['edge']}/documents.parquet")
    columns = docs.columns
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicate", "decontaminate", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, docs, tables["edge"])
    assert kept.columns == columns
    verdict = {(r["doc_id"], r["n_words"]): r["kept"] for r in registry.QUERIES["op8_quality_rules"](spark, tables["edge"]).collect()}
    n = lambda t: len(WORD.findall(t or ""))
    assert sorted((str(r["doc_id"]), n(r["text"])) for r in kept.collect()) == sorted((str(r["doc_id"]), n(r["text"])) for r in docs.collect() if verdict[(r["doc_id"], n(r["text"]))])
    out = stages["lines"](spark, docs, tables["edge"])
    assert out.columns == columns and sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))
    near = stages["near_duplicate"](spark, docs, tables["edge"])
    assert near.columns == columns
    left = [r["doc_id"] for r in near.collect()]
    # 28 to 30 copy 0 to 2, one of the two equal rows of id 4 goes, 5 has two texts, rows without id stay
    assert sorted(left, key=str) == sorted([k for k in range(33) if k not in (28, 29, 30)] + [5, None, None], key=str)
    clean = stages["decontaminate"](spark, docs, tables["edge"])
    assert clean.columns == columns and sorted((r["doc_id"] for r in clean.collect()), key=str) == sorted((r["doc_id"] for r in docs.collect() if r["doc_id"] != 8), key=str)
    packed = stages["packing"](spark, docs, tables["edge"]).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in packed}[31] == 30_001
    whole = corpus_pipeline.run(spark, tables["edge"]).collect()
    ids = {r["doc_id"] for r in whole}
    assert ids <= {r["doc_id"] for r in kept.collect()} and 8 not in ids and not ids & {24, 25, 26, 27, 28, 29, 30}
    assert corpus_pipeline.run(spark, tables["none"]).count() == 0


ODD = {"a.b": 1, "_hit": 2, "_items": 3, "_row": 4, "hashed": 5, "bucket": 6, "text`": 7, "_text": 8, "c0": 9}


def test_columns_of_any_name(spark):
    rng = random.Random(1)
    rows = [(k, prose(rng, 40)) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(v) for c, v in ODD.items()})
    items = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, quality int")
    outs = [
        sharding.external_shuffle(docs, 3), chunking.drop_repeats(docs), lines.drop_frequent_lines(docs), decontaminate.contamination(docs, items), quality.apply_rules(docs, quality.train_rules(docs, labels)),
        mil.score(docs, mil.train(docs, labels)), langid.predict(docs, *langid.train(docs.withColumn("lang", F.lit("x")))),
    ]
    for out in outs:
        got = out.collect()
        assert out.columns[: len(docs.columns)] == docs.columns and len(got) == 6
        assert all([r[c] for c in ODD] == list(ODD.values()) for r in got) and {r["doc_id"]: r["text"] for r in got} == dict(rows)
    assert minhash.near_duplicates(docs).count() == 6 and packing.packed(docs.withColumn("source", F.lit("s"))).count() == 6


def test_rows_of_one_id_are_linked_by_their_own_text(spark):
    rng = random.Random(2)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(5, a), (5, b), (6, a + " z"), (7, b + " z"), (8, c), (5, c + " q"), (5, c + " q")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r["id"], r["component_id"]) for r in got} == {(5, 5), (6, 5), (7, 5), (8, 5)} and sum(r["kept"] for r in got) == 4
    stay = [r["row"] for r in got if r["stays"]]
    assert len(stay) == 4 and len(set(stay)) == 3 and all(r["id"] == 5 for r in got if r["stays"])


def test_bins_depend_on_rows_only(spark):
    rng = random.Random(3)
    rows = [(k, prose(rng, rng.randint(1, 60)), f"s{k % 9}") for k in range(150)] + [(7, "same row", "s1")] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    run = lambda d: sorted(map(tuple, packing.pack(packing.measure(d), len(rows), capacity=100, group=40).collect()))
    assert run(docs.repartition(1)) == run(docs.repartition(5).orderBy(F.rand(4)))
    same = spark.createDataFrame([(k, k % 5) for k in range(150)], "doc_id long, cluster long")
    bins = {}
    for r in packing.packed(docs.filter("doc_id <> 7"), same).collect():
        bins.setdefault(r["bin"], []).append(r["doc_id"])
    for ids in bins.values():
        assert len({k % 5 for k in ids}) == len(ids) and len({k % 9 for k in ids}) == len(ids)


def test_sample_of_any_share(spark):
    n = spark.range(4_000_000).filter(common.sampled(2, 4_000_000, "id")).count()
    assert 0 < n < 20 and spark.range(50).filter(common.sampled(50, 50, "id")).count() == 50
    assert spark.range(50).filter(common.sampled(1, 0, "id")).count() == 50


def test_scores_of_a_batch_are_those_of_its_rows():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(langid.DIMS + 1, 3)).astype(np.float32)
    sizes = [0, 5, 0, 0, 9, 1, 0]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    buckets = rng.integers(0, langid.DIMS, bounds[-1]).astype(np.int32)
    want = [weights[buckets[a:b]].sum(axis=0, dtype=float) + weights[-1] for a, b in zip(bounds, bounds[1:])]
    assert langid.scores(weights, buckets, bounds) == pytest.approx(np.array(want))
    block, langid.BLOCK = langid.BLOCK, 12
    try:
        assert langid.scores(weights, buckets, bounds) == pytest.approx(np.array(want))
    finally:
        langid.BLOCK = block


def test_runs_are_not_shuffled(spark):
    runs = lines.LineRuns(spark, min_docs=3)
    batch = lambda *k: spark.createDataFrame([(bytes([x]), n) for x, n in k], "h binary, n long")
    runs.add(batch((1, 3), (2, 1), (3, 2)))
    left = runs.unsettled(batch((1, 5), (2, 1), (4, 1)))
    assert sorted(r["h"][0] for r in left.collect()) == [2, 4]
    runs.add(batch((1, 5), (2, 1), (4, 1)))
    runs.add(batch((2, 1), (5, 1)))
    names = [x for level in runs.levels for x in level]
    for df, shuffles in ((runs.unsettled(batch((9, 1))), 1), (runs.merged(spark.table(names[0]), spark.table(names[1])), 0)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == shuffles and "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert {r["h"][0]: r["n"] for r in runs.counts().collect()} == {1: 3, 2: 3, 3: 2, 4: 1, 5: 1}
    assert sorted(r["h"][0] for r in runs.frequent().collect()) == [1, 2]
    runs.drop()
    assert not [t for t in spark.catalog.listTables() if t.name in names]


def test_index_of_many_blocks(spark):
    rows = [(k, f"http://h{k % 7}.org/{k % 50}", f"<p>{k % 90}") for k in range(3000)]
    index = warc.CaptureIndex(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    assert len(index.tops) == 2
    got = index.lookup(warc.capture_keys(spark.createDataFrame(rows[::50], "page_id long, url string, html string"))).collect()
    assert sorted(r["page_id"] for r in got) == list(range(0, 3000, 50))
    assert all((r["payload"] or b"").decode() in ("", rows[r["page_id"]][2]) for r in got)
