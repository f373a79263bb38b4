"""The registered corpus queries: contract columns, SQL where there is some, the pipeline against plain stages, very long texts."""

import random
import sys

import brute
import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontamination, encoder, entry_points, kernels, line_crf, near_dedup, quality_rules, substring_dedup, suffix_dedup

SF = "/root/testdata/sf0.001"
CONTRACT = {
    "op1_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op2_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op3_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op4_token_store": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op5_line_crf": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op7_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op8_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op9_license_scan": "doc_id bigint, paragraph int, family string, probability double, confirmed boolean",
    "op10_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
}


@pytest.mark.parametrize("name", list(CONTRACT))
def test_contract_columns(spark, name):
    df = entry_points.queries()[name](spark, SF)
    types = dict(df.dtypes)
    for column in CONTRACT[name].split(", "):
        c, t = column.split()
        assert types[c] == t
    if name not in ("op3_url_filter", "op8_packing", "op9_license_scan"):
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        assert df.count() == docs.count()


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    ok, said = compare.same(spark, compare.connect(SF), SF, entry_points.queries()[name], entry_points.oracle_sql()[name])
    assert ok, said


def test_quality_scores_of_documents_that_were_not_learnt(spark):
    """Held-out accuracy against the labels."""
    found = entry_points.queries()["op5_line_crf"](spark, "/root/testdata/sf0.01").where("held_out").select("doc_id", "score", "predicted")
    rows = found.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == k] for k in (1, 0))
    assert good and bad and np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9


@pytest.fixture(scope="module")
def corpus():
    """Prose in two languages, junk, copies, shared passages, benchmark passages; some documents change language or are very short."""
    rng = random.Random(21)
    common = quality_rules.COMMON
    made = {k: ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(3, 9))) for _ in range(400)] for k in ("en", "fr")}

    def prose(lang, n):
        return " ".join(rng.choice(common[lang]) if rng.random() < 0.45 else rng.choice(made[lang]) for _ in range(n))

    passage, item = prose("en", 70), prose("en", 30)
    out = []
    for i in range(70):
        lang = rng.choice(["en", "en", "fr"])
        t = prose(lang, rng.randint(40, 160))
        kind = i % 10
        if kind == 1:
            t = t[: len(t) // 2] + " " + passage + " " + t[len(t) // 2 :]
        if kind == 2 and i > 10:
            w = out[i - 10][1].split()
            w[len(w) // 2 : len(w) // 2 + 1] = ["changed"]
            t, lang = " ".join(w), out[i - 10][2]
        if kind == 3:
            t = " ".join(rng.choice(["$$$", "buy", "###", "now!!!", "|"]) for _ in range(100 + i)) + f" {i}"
        if kind == 4:
            t = t + " " + item
        if kind == 5:
            t, lang = prose("en", 60) + "\n" + prose("fr", 60), "en"
        out.append((i, t, lang, f"s{i % 3}", len(t)))
    return out, [(1, item), (2, prose("fr", 12))]


def test_quality_verdicts_equal_plain_ones(spark, corpus):
    docs, _ = corpus
    table = quality_rules._class_table()
    want = brute.verdicts([(d, t, lang) for d, t, lang, *_ in docs], quality_rules.LIMITS, quality_rules.COMMON, lambda c: int(table[c]))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules.judge(df).collect()}
    assert [got[i][1] for i in range(len(docs))] == want
    assert any(not b and not k for b, k in got.values()) and sum(k for _, k in got.values()) > 40  # distances reject some


def test_pipeline_equals_plain_stages(spark, corpus, tmp_path):
    import json

    import public_tokenizers

    sys.path.insert(0, entry_points.__file__.rsplit("/tidemark/", 1)[0])
    import corpus_pipeline

    docs, items = corpus
    spark.createDataFrame(
        docs, "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = [name for name, _ in corpus_pipeline.STAGES]
    assert stages == ["quality_rules", "near_dedup", "substring_dedup", "decontamination", "packing"]
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()

    table = quality_rules._class_table()
    kept = brute.verdicts([(d, t, lang) for d, t, lang, *_ in docs], quality_rules.LIMITS, quality_rules.COMMON, lambda c: int(table[c]))
    left = [d[:2] for d, k in zip(docs, kept, strict=True) if k]
    one = brute.keep_one(left)
    left = brute.strip_words([d for d in left if d[0] in one])
    clean = {r[0] for r in brute.contaminated(left, items) if not r[-1]}
    left = [d for d in left if d[0] in clean]
    assert 0 < len(left) < len(one) < sum(kept) < len(docs)
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    assert json.loads(spec)["model"]["type"] == "BPE"
    ids = {d: x + b"\0\0\0\0" for (d, _), x in zip(left, encoder.Encoder(spec).encode([t for _, t in left]), strict=True)}
    assert {r["doc_id"] for r in rows} == set(ids)
    import zlib

    for d, x in ids.items():
        own = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == len(x) // 4 and {r["doc_tokens"] for r in own} == {len(x) // 4}
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own[:-1])]).tolist()
        assert all(r["ids_crc32"] == zlib.crc32(x[4 * r["start"] : 4 * (r["start"] + r["length"])]) for r in own)


def test_very_long_texts(spark):
    """A text of many chunks beside short ones; the memory of a kernel stays within some times its bytes."""
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(5000)]
    long = " ".join(rng.choices(words, k=400_000))  # 2.6 MB
    docs = [(1, long), (2, "short text"), (3, long[1_000_000:1_004_000]), (4, "x" * 700_000), (5, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    n = F.aggregate(F.zip_with("removed_ends", "removed_starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    got = {r["doc_id"]: (r["n_bytes"], r["n"]) for r in suffix_dedup.strip(df).select("doc_id", "n_bytes", n.alias("n")).collect()}
    assert got[1] == (len(long), 4000) and got[3] == (4000, 4000) and got[4] == (700_000, 700_000) and got[5] == (0, 0)
    one = {r["doc_id"]: r["n_removed"] for r in substring_dedup.digest(substring_dedup.strip(df)).collect()}
    assert one[1] == 0 and one[3] == len(
        long[1_000_000:1_004_000].split()
    ) - (not long[999_999].isspace()) - (not long[1_004_000].isspace())
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.groups(df).df.collect()}
    assert found[1] == 1 and found[3] == 3
    assert {r["doc_id"]: r["n_words"] for r in quality_rules.judge(df.selectExpr("doc_id", "text", "'en' as lang")).collect()}[1] == 400_000
    hit = decontamination.digest(
        decontamination.hits(df, spark.createDataFrame([(9, " ".join(long.split()[200_000:200_020]))], "item_id long, text string"))
    ).where("contaminated").collect()
    assert [(r["doc_id"], r["n_hit"]) for r in hit] == [(1, 20)]
    assert len(line_crf.measure(kernels.Batch.of([long.encode()]))[0]) == 1
