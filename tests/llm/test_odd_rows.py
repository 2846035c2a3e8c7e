"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from patchloom.llm import decontaminate, langid, license_scan, linededup, mixing, quality, secrets, sharding, simhash, toxicity

N = 12


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(f"long7x{j}" for j in range(12)), "x"), (2, None, "x"), (3, "", "x"), (4, "too short", "x"), (None, " ".join(f"long9x{j}" for j in range(12)), "x")], "item_id long, text string, h string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def every(spark, docs, labels, benchmark):
    return {
        "license": (license_scan.license_scan(docs), None),
        "mix": (mixing.mix_sources(docs), None),
        "shard": (sharding.shard_documents(docs), None),
        "quality": (quality.quality_scores(docs, labels), None),
        "leaks": (decontaminate.leaks(docs, benchmark), 2),
        "secrets": (secrets.scan([docs])[0], None),
        "lines": (linededup.dedup_lines(docs), None),
        "simhash": (simhash.simhash_components(docs), None),
        "lang": (langid.identify(docs), None),
        "toxic": (toxicity.score_toxicity(docs, labels), None),
    }


def test_row_counts(spark, odd, labels, benchmark):
    for name, (df, n) in every(spark, odd, labels, benchmark).items():
        assert df.count() == (N if n is None else n), name


def test_empty_tables(spark, empty, labels, benchmark):
    for name, (df, _) in every(spark, empty, labels, benchmark).items():
        assert df.count() == 0, name
    for df in (quality.quality_filter(empty, labels), simhash.fingerprint_dedup(empty), decontaminate.decontaminate(empty, benchmark), mixing.mix_corpus(empty), sharding.shard_corpus(empty)):
        assert df.count() == 0


def test_no_labels_and_no_benchmark(spark, odd, labels, benchmark):
    none = labels.limit(0)
    assert quality.quality_scores(odd, none).where("kept = base_failed").count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(odd, none).collect()} == {0.0}
    assert decontaminate.leaks(odd, benchmark.limit(0)).count() == 0
    unlabelled = odd.drop("lang").selectExpr("*", "cast(null as string) lang")
    assert langid.identify(unlabelled).where("lang_pred <> 'und'").count() == 0


def test_mix_of_odd_rows(odd):
    found = mixing.mix_sources(odd).collect()
    assert {r["size"] for r in found if r["doc_id"] in (3, 4, 5)} == {0} and all(r["taken"] <= 2 * r["size"] for r in found)
    assert sum(r["target"] for r in {r["src"]: r for r in found}.values()) == pytest.approx(1.5 * sum(r["size"] for r in found))
    assert rows(mixing.mix_sources(odd)) == rows(mixing.mix_sources(odd.repartition(3)))


def test_shards_of_odd_rows(odd):
    found = sharding.shard_documents(odd).collect()
    assert {r["size"] for r in found if r["doc_id"] in (3, 4)} == {1}
    by: dict = {}
    for r in found:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(16))
    kept = sharding.shard_corpus(odd)
    assert kept.count() == N and {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot", "path"} <= set(kept.columns)
    assert sorted((r["shard"], r["slot"]) for r in kept.collect()) == sorted((r["shard"], r["slot"]) for r in found)


def test_quality_of_odd_rows(odd, labels):
    found = {r["doc_id"]: r for r in quality.quality_scores(odd, labels).collect()}
    assert found[3]["n_words"] == found[4]["n_words"] == found[5]["n_words"] == 0 and found[5]["base_failed"]
    assert found[6]["n_words"] == 48_000 and not found[6]["base_failed"] and found[7]["n_symbols"] == 0
    assert quality.quality_filter(odd, labels).columns == odd.columns


def test_leaks_of_odd_rows(odd, benchmark):
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(odd, benchmark).collect()}
    assert set(found) == {(6, 1), (6, None)} and found[6, 1]["doc_start"] == 84
    kept = decontaminate.decontaminate(odd, benchmark)
    assert kept.count() == N - 1 and kept.columns == odd.columns


def test_secrets_of_odd_rows(odd):
    found = {r["path"]: r for r in secrets.scan([odd])[0].collect()}
    assert found[3]["spans"] == "" and found[8]["n_assign"] == found[8]["n_access"] == found[8]["n_hex"] == 1


def test_lines_of_odd_rows(odd):
    found = linededup.dedup_lines(odd)
    by = {(r["doc_id"], r["source"]): r for r in found.collect()}
    assert by[(2, None)]["text"] == "" and by[(None, "a")]["removed"] is None  # the null id sorts first
    assert by[(3, "b")]["text"] is None and by[(6, "c")]["removed"] is None
    assert linededup.dedup_report(odd).where("n_lines < n_removed").count() == 0


def test_simhash_of_odd_rows(odd):
    found = simhash.simhash_components(odd).collect()
    blank = {r["component_id"] for r in found if r["fingerprint"] == 0}
    assert blank == {3} and sum(r["fingerprint"] == 0 for r in found) == 4
    kept = simhash.fingerprint_dedup(odd)
    assert kept.columns == odd.columns and kept.count() == len({r["root"] for r in found})


def test_licences_of_odd_rows(odd):
    found = license_scan.license_scan(odd.withColumn("path", F.when(F.col("doc_id") < 4, F.concat_ws("/", F.lit("p"), "source", F.col("doc_id").cast("string")))))
    assert found.count() == N and found.where("license is not null").count() == 0
    ties = odd.where("doc_id = 8").select(F.lit("q/LICENSE").alias("path"), F.lit("SPDX-License-Identifier: MIT\nSPDX-License-Identifier: ISC").alias("text"))
    assert license_scan.license_scan(ties.union(ties)).collect()[1]["own_license"] == "isc"  # the smaller template


def test_toxicity_of_odd_rows(odd, labels):
    found = toxicity.score_toxicity(odd, labels).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    assert {r["held_out"] for r in found if r["doc_id"] is None} == {True}
    assert len({r["score"] for r in found if r["doc_id"] in (3, 4)}) == 1


def test_equal_cosines_go_to_the_smaller_code(documents):
    docs = documents([(i, "ab cd ef", lang, "a") for i, lang in enumerate(["xx", "aa"] * 20)])
    assert {r["lang_pred"] for r in langid.identify(docs).collect()} == {"aa"}


def test_languages_of_odd_rows(odd):
    found = {r["doc_id"]: r for r in langid.identify(odd).collect()}
    assert {found[i]["lang_pred"] for i in (3, 4, 5)} == {"und"} and found[None]["held_out"]


def test_pipeline_stages_keep_columns(spark, odd, labels, benchmark, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, str(tmp_path)).columns == odd.columns
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns)
