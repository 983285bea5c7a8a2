"""Rows that share an id, or have none, are judged each by its own text."""

from __future__ import annotations

import corpus_pipeline


def test_decontamination_tells_rows_of_one_id_apart(spark, frame, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    frame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    w = item.split()
    clean = [(None, "a clean text that has no identifier at all"), (None, " ".join(w[:9])), (None, " ".join(w[5:])), (7, "clean words under a shared identifier"), (8, ""), (None, None)]
    docs = clean + [(None, f"before {item} after"), (7, item.upper()), (9, item)]
    got = corpus_pipeline.drop_contaminated(spark, frame(docs, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, clean))
