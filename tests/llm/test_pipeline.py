import hashlib
from collections import Counter

import numpy as np

from tessera.llm import bpe, minhash, mixing, quality, secrets

from . import brute
from .test_minhash import brute_classes
from .test_operators import SF, docs, empty, empty_dir, sf_dir  # noqa: F401


def test_stages_match_brute_force(spark):
    """Every stage on what its predecessor kept, against a plain version of it."""
    import corpus_pipeline

    sf = SF.replace("sf0.001", "sf0.01")
    start = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5
    good = corpus_pipeline.written(stages["quality"](spark, start, sf))
    scores = {r.doc_id: r.score for r in quality.op4_quality(spark, sf).collect()}
    assert {r.doc_id for r in good.collect()} == {d for d, s in scores.items() if s >= 0.3} and good.columns == start.columns
    once = corpus_pipeline.written(stages["near_dedup"](spark, good, sf))
    rows = [(r.doc_id, r.text) for r in good.collect()]
    # near-duplicates in frequent shingles may link a little more than plain similarity does
    assert {r.doc_id for r in once.collect()} <= {c for _, c in brute_classes(rows)}
    labels = {r.doc_id: r.class_id for r in minhash.classes(good).collect()}
    assert {r.doc_id for r in once.collect()} == set(labels.values())
    clean = corpus_pipeline.written(stages["secrets"](spark, once, sf))
    before = {r.doc_id: r.text for r in once.collect()}
    for r in clean.collect():
        assert (r.text != before[r.doc_id]) == bool(brute.secrets(before[r.doc_id])[4]) and r.n_chars == len(r.text)
    mixed = corpus_pipeline.written(stages["mixing"](spark, clean, sf))
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.repeats for r in mixing.mix_takes(mixing.materialize(mixing.size_documents(clean), "t"), whole_documents=True).collect() if r.repeats})
    last = stages["bpe"](spark, mixed, sf)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_tokenizer())
    want = Counter()
    for r in mixed.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in last.collect()) == want


def test_hard_cases(spark, sf_dir, empty_dir):  # noqa: F811
    import corpus_pipeline

    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_secret_redaction_is_complete(spark, docs):  # noqa: F811
    from tessera.llm.common import scratch_path

    out = secrets.redact_documents(docs, scratch_path(spark, "ledger"))
    assert all(brute.secrets(r.text)[4] == "" for r in out.collect())
