"""The pipeline's stages on a small corpus whose right decisions are known."""

import random

import corpus_pipeline

SYLLABLES = {"aa": "ba be bi bo bu da de di do du", "bb": "xul xol kral krel vorn varn zeck zick"}


def speech(lang, seed, n=120):
    rng = random.Random(f"{lang}{seed}")
    words = ["".join(rng.choices(SYLLABLES[lang].split(), k=rng.randrange(1, 4))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) for i in range(0, n, 12))


def test_stages(spark, tmp_path):
    clean = [(i, speech(lang, i), lang) for i in range(40) for lang in ["aa" if i % 2 else "bb"]]
    flat = speech("aa", 900, 90).replace("\n", " ")
    edited = flat.split(" ")
    edited[40] = "changed"
    item = speech("bb", 950, 24).replace("\n", " ")
    odd = [
        (100, clean[3][1], "aa"),  # a copy: all its lines stand in document 3
        (101, flat, "aa"), (102, " ".join(edited), "aa"),  # near copies, one line each
        (103, f"{speech('bb', 960, 30)} {item}", "bb"),  # holds a benchmark item
        (104, None, None), (105, "", "aa"), (106, "12 34 !!", "bb"),  # no letters
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, lang, "s", len(t or "")) for i, t, lang in clean + odd]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")

    kept, docs = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert name == "packing" or docs.columns == columns
    every = {r[0] for r in rows}
    assert kept["language_id"] == every - {104, 105, 106}
    assert kept["line_dedup"] == kept["language_id"] - {100}
    assert kept["near_dedup"] == kept["line_dedup"] - {102}
    assert kept["decontamination"] == kept["near_dedup"] - {103}
    assert kept["packing"] == kept["decontamination"] == {i for i, _, _ in clean} | {101}
