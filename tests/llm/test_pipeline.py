"""The pipeline: its stages follow one another, and each takes effect."""

import random

from tests.llm.test_operators import docs, prose

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    leak = prose(rng, 25)
    base = prose(rng, 80).split()
    copies = []
    for _ in range(3):
        own = list(base)
        own[rng.randrange(80)] = "changed" + rng.choice("xyz")
        copies.append("\n".join(" ".join(own[i : i + 8]) for i in range(0, 80, 8)))
    rows = [(i, prose(rng, 60)) for i in range(40)] + [(100, prose(rng, 20) + " idiot moron idiot scum"), (101, prose(rng, 30) + "\n" + leak + "\n" + prose(rng, 30))]
    rows += [(200 + i, c) for i, c in enumerate([*copies, copies[0].upper()])] + [(300, None), (301, "")]
    d = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == d.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"]: r for r in now.collect()}
    plain = set(range(40)) | {101, 300, 301}
    assert 100 not in kept["toxicity"] and plain <= set(kept["toxicity"])
    left = [kept["near_dedup"][i]["text"].split("\n") for i in range(200, 204) if i in kept["near_dedup"]]
    assert len(left[0]) == 10 and sum(map(len, left)) <= 10 + 2 * 2 and 203 not in kept["line_dedup"]  # of the copies, lines that aren't alike
    assert plain <= set(kept["sentencepiece"])
    assert leak in kept["near_dedup"][101]["text"] and leak not in kept["decontamination"][101]["text"]
    assert kept["decontamination"][101]["n_chars"] == len(kept["decontamination"][101]["text"])
    whole = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == set(kept["sentencepiece"])
