"""Independent-site models: binary model files, their fields refit per site, and scores of substitutions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import substitutions, substitutions_fit

#: Reasons of variants without a score (fixed values of this library).
NO_MODEL, NO_POSITION, NO_RESIDUE, MALFORMED = "no_model", "position_not_in_model", "residue_not_in_model", "malformed_mutant"


def parse_model(raw: bytes, precision: str = "<f4") -> dict:
    """Parts of a couplings model file (version 2), whose length must be exactly what its header says."""
    head = np.dtype([("sites", "<i4"), ("symbols", "<i4"), ("valid", "<i4"), ("invalid", "<i4"), ("rounds", "<i4"), ("theta", precision), ("lambda_h", precision), ("lambda_j", precision), ("lambda_group", precision), ("n_eff", precision)])
    if len(raw) < head.itemsize:
        raise ValueError("too short for a model")
    h = np.frombuffer(raw, head, 1)[0]
    n, q = int(h["sites"]), int(h["symbols"])
    if n < 1 or q < 2 or min(h["valid"], h["invalid"], h["rounds"]) < 0:
        raise ValueError("the header's sizes are not valid")
    couplings = n * (n - 1) // 2 * q * q
    body = np.dtype([("alphabet", f"S{q}"), ("weights", precision, (int(h["valid"]) + int(h["invalid"]),)), ("target", f"S{n}"), ("index", "<i4", (n,)), ("f", precision, (n, q)), ("h", precision, (n, q)), ("pairs", precision, (2 * couplings,))])
    if len(raw) != head.itemsize + body.itemsize:
        raise ValueError("the length does not fit the header: another version, precision, or a cut file")
    b = np.frombuffer(raw, body, 1, head.itemsize)[0]
    alphabet, target = b["alphabet"].decode("ascii"), b["target"].decode("ascii")
    numbers = np.concatenate([np.ravel(b[k]) for k in ("weights", "f", "h", "pairs")])
    if len(set(alphabet)) != q or set(target) - (set(alphabet) - set("-.")) or len(target) != n or not (np.diff(b["index"]) > 0).all():
        raise ValueError("alphabet, target or positions are not valid")
    if not np.isfinite(numbers).all() or not h["lambda_h"] > 0 or not h["n_eff"] > 0 or (b["f"] < 0).any() or (np.abs(b["f"].sum(axis=1) - 1) > 1e-3).any():
        raise ValueError("parameters are not valid")
    return {"alphabet": alphabet, "target": target, "index": b["index"], "f": b["f"].astype(float), "lambda_h": float(h["lambda_h"]), "n_eff": float(h["n_eff"])}


def read_models(spark: SparkSession, paths: str, precision: str = "<f4") -> DataFrame:
    """``model, position, residue, alphabet, f, lambda_h, n_eff``: a row per site of every model file, each file read by one task."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, raw in zip(b["path"], b["content"], strict=True):
                m = parse_model(raw, precision)
                yield pd.DataFrame({"model": path.rsplit("/", 1)[-1], "position": m["index"].astype(int), "residue": list(m["target"]), "alphabet": m["alphabet"], "f": list(m["f"]), "lambda_h": m["lambda_h"], "n_eff": m["n_eff"]})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "model string, position int, residue string, alphabet string, f array<double>, lambda_h double, n_eff double")


def fit_fields(f: np.ndarray, lambda_h: np.ndarray, n_eff: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Fields that maximise the penalised likelihood of each site's frequencies, all sites at once, by damped Newton steps.

    The objective n (log sum exp x - f x) + lambda x x is strictly convex, so
    the fields are unique; a site that does not settle is an error.
    """
    x = np.zeros_like(f)
    n, lam = n_eff[:, None], lambda_h[:, None]

    def value(x: np.ndarray) -> np.ndarray:
        top = x.max(axis=1, keepdims=True)
        return (n * (np.log(np.exp(x - top).sum(axis=1, keepdims=True)) + top - (f * x).sum(axis=1, keepdims=True)) + lam * (x**2).sum(axis=1, keepdims=True))[:, 0]

    for _ in range(rounds):
        e = np.exp(x - x.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        g = n * (p - f) + 2 * lam * x
        if (np.abs(g) <= 1e-9 * (n + 1)).all():
            return x
        hessian = n[:, :, None] * (np.eye(f.shape[1]) * p[:, None, :] - p[:, :, None] * p[:, None, :]) + 2 * lam[:, :, None] * np.eye(f.shape[1])
        step = np.linalg.solve(hessian, g[:, :, None])[:, :, 0]
        size, now = np.ones(len(x)), value(x)
        for _ in range(40):
            worse = value(x - size[:, None] * step) > now + 1e-12 * np.abs(now)
            if not worse.any():
                break
            size[worse] /= 2
        x = x - size[:, None] * step
    raise ValueError("fields did not settle")


def site_fields(sites: DataFrame, offset: int = 0) -> DataFrame:
    """``model, position, symbol, h`` from the sites of models; sites are fit together in batches, whatever model they are of."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, same in b.groupby(b["f"].map(len)):
                h = fit_fields(np.stack(same["f"].to_numpy()), same["lambda_h"].to_numpy(), same["n_eff"].to_numpy())
                yield pd.DataFrame({"model": same["model"], "position": same["position"] + offset, "alphabet": same["alphabet"], "h": list(h)})

    fitted = sites.select("model", "position", "alphabet", "f", "lambda_h", "n_eff").mapInPandas(run, "model string, position int, alphabet string, h array<double>")
    return fitted.select("model", "position", F.posexplode("h").alias("_i", "h"), "alphabet").select("model", "position", F.substring("alphabet", F.col("_i") + 1, F.lit(1)).alias("symbol"), "h")


def score_substitutions(variants: DataFrame, fields: DataFrame, key: str = "id", model: str = "model") -> DataFrame:
    """``key, score, reason``: the sum of the fields of new residues less those of old ones.

    A variant with any site or residue that its model lacks is unscored, with
    the reason of the first such substitution.  ``variants`` has the model's
    name, ``mutant`` and ``wild_type_sequence``.
    """
    v = variants.select(key, model, "wild_type_sequence", substitutions(F.col("mutant")).alias("s"))
    v = v.withColumn("ok", F.col("s").isNotNull() & F.coalesce(substitutions_fit(F.col("s"), F.col("wild_type_sequence")), F.lit(False)))
    parts = v.filter("ok").select(key, model, F.posexplode("s").alias("k", "x")).select(key, model, "k", F.col("x.position").alias("position"), F.col("x.from").alias("old"), F.col("x.to").alias("new"))
    h = fields.groupBy(model, "position").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "h"))).alias("h"))  # one alphabet a site
    known = fields.select(model).distinct().withColumn("known", F.lit(True))
    j = parts.join(h, [model, "position"], "left").join(known, model, "left")
    problem = F.when(F.col("known").isNull(), NO_MODEL).when(F.col("h").isNull(), NO_POSITION).when(F.col("h")[F.col("new")].isNull() | F.col("h")[F.col("old")].isNull(), NO_RESIDUE)
    sums = j.withColumns({"problem": problem, "d": F.col("h")[F.col("new")] - F.col("h")[F.col("old")]}).groupBy(key).agg(F.sum("d").alias("sum"), F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("k"))).alias("first"))
    out = v.select(key, "ok").join(sums, key, "left")
    reason = F.when(~F.col("ok"), MALFORMED).otherwise(F.col("first"))
    return out.select(key, F.when(reason.isNull(), F.col("sum")).alias("score"), reason.alias("reason"))
