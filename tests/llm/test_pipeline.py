"""The corpus pipeline, stage by stage: each stage's rows are what its operator and plain forms of its decisions say of its own input."""

import re
from collections import Counter

import corpus_pipeline
import sentencepiece
from test_text_operators import brute_weighted, slow_measure

from rasterloom.llm import mixing, quality_rules, sentencepiece_fst

SF = "/root/testdata/sf0.01"
#: The base rules of secrets, as plain patterns.
SECRETS = (("assign", "((?i:password|passwd|secret|token|api_?key))[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2), ("access", "AKIA[A-Z0-9]+", 20, 0), ("hex", "[0-9a-f]+", 24, 0))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = {r.doc_id for r in labels.where("quality = 1 AND toxic = 0").collect()}
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "secret_scans", "source_mixing", "sentencepiece"]
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        before, after = docs.collect(), out.collect()
        there = {r.doc_id: r for r in before}
        if name != "sentencepiece":
            assert out.columns == columns
        if name == "quality_rules":
            counts = {r.doc_id: slow_measure(r.text) for r in before}
            good = {i for i, c in counts.items() if c[0] >= 50 and 100 * c[4] <= 50 * c[0]}
            cutoffs = quality_rules.calibrate(quality_rules.measures(docs), labels)
            rejected = {i for i in good if any(100 * dict(zip(quality_rules.COUNTS, quality_rules.measure(there[i].text)))[quality_rules.RULES[r][0]] > x * dict(zip(quality_rules.COUNTS, quality_rules.measure(there[i].text)))[quality_rules.RULES[r][1]] for r, x in cutoffs.get(there[i].lang or "", {}).items())}
            assert {r.doc_id for r in after} == good - rejected
            assert len(clean & good - rejected) >= 0.95 * len(clean & good)
        elif name == "minhash_near_dedup":
            order = sorted(there)
            classes = brute_weighted([there[i].text for i in order])
            assert sorted(r.doc_id for r in after) == sorted({order[c] for c in classes.values()})
        elif name == "secret_scans":
            assert len(after) == len(before) and all(r.n_chars == len(r.text) for r in after)
            for r in after:
                masks = {m for _, p, n, g in SECRETS for m in re.finditer(p, there[r.doc_id].text) if len(m[g]) >= n}
                assert masks or r.text == there[r.doc_id].text or re.search(r"\[(pem|jwt|github|slack)\]", r.text)
                for m in masks:
                    assert m[0] not in r.text or r.text.count(m[0]) < there[r.doc_id].text.count(m[0])
        elif name == "source_mixing":
            rates = {r.doc_id: r for r in mixing.rates(docs, labels, corpus_pipeline.MIX).collect()}
            assert all(r.targets_met for r in rates.values())
            assert Counter(r.doc_id for r in after) == Counter({i: r.copies for i, r in rates.items() if r.copies})
            kept = {r.doc_id for r in after}
            assert len(clean & kept) >= 0.95 * len(clean & set(there))
        else:
            assert len(after) == len(before) and all(r.round_trip for r in after)
            assert all(list(r.ids) == lib.encode(r.text) for r in after)
        docs = spark.createDataFrame(after, out.schema)


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.where("round_trip").count() == out.count() > 0
