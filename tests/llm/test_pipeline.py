"""run() against a brute-force version of its stages."""

import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from rollbook.llm import toxicity
from rollbook.llm.common import table

from . import test_decontaminate, test_lines, test_simhash


@pytest.mark.parametrize("size", ["sf0.001"])
def test_against_brute_force(spark, size):
    sf = f"/root/testdata/{size}"
    docs = table(spark, sf, "documents")
    scorer = toxicity.Scorer(toxicity.learn(docs, table(spark, sf, "labels")))
    left = {r.doc_id: r.text for r in docs.collect() if scorer.score(r.text or "") < 0.7}
    gone = test_lines.brute(list(left.items()))
    left = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in set(gone[d])) for d, t in left.items()}
    label = test_simhash.brute_components({d: test_simhash.brute_fingerprint(t, 5) for d, t in left.items()})
    left = {d: t for d, t in left.items() if label[d] == d}
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    left = {d: t for d, t in left.items() if not test_decontaminate.brute(t, items)[4]}
    library = Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    want = {d: hashlib.sha256(np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for d, t in left.items()}
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def test_stages_keep_the_columns(spark, clashing):
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, sf)
        assert out.columns == clashing.columns, name
        assert 0 < out.count() <= clashing.count()
        assert stage(spark, clashing.limit(0), sf).collect() == []
