"""The whole study on a small made-up network, through the command line."""

import gzip
import json
import random

from graphsieve.plans import cli


def test_study(spark, tmp_path, capsys):
    rng = random.Random(2)
    genes = [f"G{k}" for k in range(60)]
    pairs = {(f"9606.{a}", f"9606.{b}", rng.choice([650, 720, 950])) for a in genes for b in rng.sample(genes, 5)}
    put = lambda name, text: (tmp_path / name).write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode()) and str(tmp_path / name)
    bits = [("t", None, [1, 2, 3]), ("r", "vMost-DILI-concern", [1, 2, 3, 4]), ("q", "vNo-DILI-concern", [9]), ("z", "Ambiguous DILI-concern", [1])]
    spark.createDataFrame(bits, "name string, category string, bits array<int>").write.parquet(str(tmp_path / "bits"))
    config = {
        "links": put("links.txt.gz", "protein1 protein2 combined_score\n" + "".join(f"{a} {b} {s}\n" for a, b, s in sorted(pairs))),
        "info": put("info.txt.gz", "#string_protein_id\tpreferred_name\tsize\n" + "".join(f"9606.{g}\t{g}\t1\n" for g in genes)),
        "expression": put("x.gct", "#1.2\n1\t1\nName\tDescription\tLiver\n" + "".join(f"E{g}\t{g}\t{0.5 if k % 9 == 0 else 1 + k}\n" for k, g in enumerate(genes))),
        "targets": put("targets.csv", "compound,protein_id,source\n" + "".join(f"A,P{k},s\n" for k in range(1, 6)) + "".join(f"B,P{k},s\n" for k in range(3, 40)) + "B,X1,s\n"),
        "mapping": put("map.csv", "# ids\n" + "".join(f"P{k},G{k}\n" for k in range(60))),
        "disease": put("disease.tsv", "geneSymbol\tgeneId\tscore\tdiseaseName\tdiseaseId\n" + "".join(f"G{k}\t{k}\t0.3\tIll\tD1\n" for k in range(40, 60)) + "G1\t1\t0.9\tWell\tD2\n"),
        "fingerprints": str(tmp_path / "bits"), "out": str(tmp_path / "out"), "disease_name": "Ill", "compounds": ["A", "B"], "permutations": 20, "iterations": 15,
    }
    path = put("study.json", json.dumps(config))
    assert cli.main(["run", "--config", path, "--list"], spark) == 0
    code = cli.main(["run", "--config", path], spark)
    said = capsys.readouterr().out
    assert code == 0, said
    read = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}")
    p = {(r["network_threshold"], r["compound"]): r for r in read("permutation").collect()}
    assert set(p) == {(t, c) for t in (700, 900) for c in "AB"}
    assert all(0 < r["p_value"] <= 1 and r["p_value"] <= r["p_fdr"] and r["observed_influence"] > 0 for r in p.values())
    assert read("weighted_permutation").filter("mean_target_tpm > 1").count() == 4
    assert read("path_permutation").filter("observed_dc >= 0").count() == 4
    b = read("bootstrap").first()
    assert b["n_bootstrap"] == 15 and b["ci_lower"] <= b["mean"] <= b["ci_upper"]
    assert read("consolidated").count() == 12 and read("similarity").first()["analog"]
    assert "No mapping" in spark.read.text(f"{tmp_path}/out/data_flow", wholetext=True).first()[0]
    assert cli.main(["run", "--config", path, "--validate"], spark) == 0
    assert cli.main(["extract", "--links", config["links"], "--info", config["info"], "--threshold", "900", "--output", f"{tmp_path}/n900"], spark) == 0
    assert cli.main(["filter", "--input", f"{tmp_path}/n900", "--output", f"{tmp_path}/f900", "--expression", config["expression"]], spark) == 0
    assert 0 < spark.read.parquet(f"{tmp_path}/f900").count() <= spark.read.parquet(f"{tmp_path}/n900").count()
