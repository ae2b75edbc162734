"""Queries read all rows of their tables."""

import numpy as np
import pytest

from peakloom.functions import models as M
from peakloom.plans import rescore
from peakloom.plans.kernel_queries import q52_digest_and_decoys


def test_digest_covers_long_documents_and_peptides(spark, tmp_path):
    rows = [(i, ("ACDEFGHIKL" + "A" * i + "K" + "MNQSTVWYACDEFGHILMNQR") * (1 if i < 2 else 200)) for i in range(4)]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.peptide: (r.proteins, r.decoy) for r in q52_digest_and_decoys(spark, str(tmp_path)).collect()}
    assert got["MNQSTVWYACDEFGHILMNQR"][0] == 4 and got["ACDEFGHIK"][0] == 4
    assert all(sorted(d) == sorted(p) for p, (_, d) in got.items())


def test_counts_stand_for_equal_scores():
    rng = np.random.default_rng(3)
    x, y, z = (np.round(rng.normal(m, 1, k), 1) for m, k in ((2, 900), (0, 700), (4, 200)))
    whole, packed = M.posterior_table(x, y, z), [np.unique(v, return_counts=True) for v in (x, y, z)]
    got = M.posterior_table(*(v for v, _ in packed), counts=tuple(n.astype(float) for _, n in packed))
    for k in whole:
        assert got[k] == pytest.approx(whole[k], abs=1e-6)


def test_posteriors_are_of_all_hits(spark):
    rng = np.random.default_rng(5)
    roles = [("target", 1.0, 2400), ("target", 4.0, 600), ("decoy", 1.0, 2000), ("identified", 4.5, 500)]
    hits = [(r, float(v)) for r, m, k in roles for v in np.round(rng.normal(m, 0.7, k), 1)]
    df = spark.createDataFrame([(i, r, v) for i, (r, v) in enumerate(hits)], "doc_id long, role string, p double")
    whole = {r.doc_id: r.global_p for r in rescore.rescored(df, ["p"]).collect()}
    part = {r.doc_id: r.global_p for r in rescore.rescored(df, ["p"], sample=100).collect()}
    assert len(whole) == len(part) == len(hits)
    assert np.mean([abs(whole[i] - part[i]) for i in whole]) < 0.02
