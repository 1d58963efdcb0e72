"""Every training document counts when states are trained."""

import numpy as np

from neuritic.llm import hmm_lm


def test_each_document_takes_part_once_in_the_sweep_and_once_a_round(spark, monkeypatch):
    seqs = [np.append(np.full(3 + k % 5, 1 + k % 7), 0).astype("<u2") for k in range(300)] + [np.zeros((1 << 16) + 9, dtype="<u2")]
    known = spark.createDataFrame([(k, len(s), bytearray(hmm_lm._pack(s))) for k, s in enumerate(seqs)], "doc_id long, n_tokens long, classes binary")
    seen, plain = [], hmm_lm.expected
    monkeypatch.setattr(hmm_lm, "expected", lambda docs, m: (seen.append(sorted(r.doc_id for r in docs.select("doc_id").collect())), plain(docs, m))[1])
    model = hmm_lm.train(known, rounds=2, slices=4)
    assert len(seen) == 6 and sorted(i for part in seen[:4] for i in part) == seen[4] == seen[5] == list(range(301))
    assert np.allclose(model.e.sum(axis=0), 1) and np.allclose(model.pi.sum(), 1)


def test_slices_take_few_tasks_and_tasks_give_a_row_for_each_class(spark, monkeypatch):
    seqs = [np.append(np.full(3 + k % 5, 1 + k % 7), 0).astype("<u2") for k in range(300)]
    known = spark.createDataFrame([(k, len(s), bytearray(hmm_lm._pack(s))) for k, s in enumerate(seqs)], "doc_id long, n_tokens long, classes binary").repartition(8)
    tasks, plain = [], hmm_lm.expected
    monkeypatch.setattr(hmm_lm, "expected", lambda docs, m: (tasks.append(docs.rdd.getNumPartitions()), plain(docs, m))[1])
    hmm_lm.train(known, rounds=1, slices=4)
    assert tasks == [2] * 4 + [8]
    m = hmm_lm.Model.random()
    first, step, emit = plain(known, m)
    sums = [sum(x) for x in zip(*(hmm_lm.Lanes([s]).expected(m) for s in seqs), strict=True)]
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip((first, step, emit), sums, strict=True))
    assert np.isclose(first.sum(), 300) and np.isclose(emit.sum(), sum(map(len, seqs)))
