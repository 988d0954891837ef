"""Site models and variant features on files and rows made here."""

import numpy as np
import pytest

from gaugeframe.operators import features, sites


def model_bytes(rng, target="ACD", alphabet="-ACDE", index=(2, 3, 5)):
    n, q = len(target), len(alphabet)
    f = rng.dirichlet(np.ones(q), n).astype("<f4")
    parts = [np.array([n, q, 2, 1, 7], "<i4"), np.array([0.2, 0.01, 0.5, 0.0, 40.0], "<f4"), alphabet.encode(), np.ones(3, "<f4"), target.encode(), np.array(index, "<i4"), f, np.zeros((n, q), "<f4"), np.zeros(n * (n - 1) * q * q, "<f4")]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts), f


def test_models_and_scores(spark, tmp_path):
    raw, f = model_bytes(np.random.default_rng(3))
    (tmp_path / "m1").write_bytes(raw)
    s = sites.read_models(spark, str(tmp_path))
    fields = sites.site_fields(s)
    h = {(r["position"], r["symbol"]): r["h"] for r in fields.collect()}
    for i, p in enumerate((2, 3, 5)):
        x = np.array([h[(p, c)] for c in "-ACDE"])
        e = np.exp(x) / np.exp(x).sum()
        assert np.abs(40 * (e - f[i]) + 0.02 * x).max() < 1e-6
    rows = [("a", "m1", "A2C:C3D"), ("b", "m1", "E4A"), ("c", "m1", "A2W"), ("d", "m2", "A2C"), ("e", "m1", "A2C:bad"), ("f", "m1", "A2W:E4A")]
    v = spark.createDataFrame([(*r, "EACED") for r in rows], "id string, model string, mutant string, wild_type_sequence string")
    got = {r["id"]: (r["score"], r["reason"]) for r in sites.score_substitutions(v, fields).collect()}
    assert got["a"] == (pytest.approx(h[(2, "C")] - h[(2, "A")] + h[(3, "D")] - h[(3, "C")]), None)
    assert {k: x[1] for k, x in got.items() if k != "a"} == {"b": sites.NO_POSITION, "c": sites.NO_RESIDUE, "d": sites.NO_MODEL, "e": sites.MALFORMED, "f": sites.NO_RESIDUE}
    for bad in (raw[:-1], raw + b"x", raw[:10]):
        with pytest.raises(ValueError):
            sites.parse_model(bad)
    with pytest.raises(ValueError):
        sites.parse_model(raw, "<f8")


def test_variant_features(spark):
    row = {"rel_position": "12", "rel_position_scaled": "0.5", "intron1_len": "10", "exon_len": "5", "intron2_len": "8", "phylop_score": "NA", "mean_phastCons_score": "0.25", "region": "exon", "ref_allele": "C", "alt_allele": "T", "mutant_sequence": "acgtacgtacgtNacgtacgtacg"}
    df = spark.createDataFrame([row, {**row, "rel_position": "99"}])
    a, b = (r["features"] for r in features.variant_features(df).collect())
    assert b is None and len(a) == 85
    assert a[:10] == [12, 0.5, 2, -3, 2, 5, 10, 8, None, 0.25] and a[10:21] == [1, 0, 0, 0, 1, 0, 0, 0, 0, 0, 1]
    window = row["mutant_sequence"].upper()[1:22]
    words = [window[i : i + 3] for i in range(len(window) - 2)]
    words = [w for w in words if set(w) <= set("ACGT")]
    vocabulary = [x + y + z for x in "ACGT" for y in "ACGT" for z in "ACGT"]
    assert a[21:] == pytest.approx([words.count(w) / len(words) for w in vocabulary])
