"""Queries that cover all that their operators do by default, against plain restatements."""

import numpy as np

from spectrafold.functions import kernels
from spectrafold.operators import calibration
from spectrafold.plans import registry
from spectrafold.sources import synthetic


def test_gammachirp_bank_has_all_bands(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=900)
    spark.createDataFrame([(k, "a", float(v)) for k, v in enumerate(x)], "event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.scale, r.frame): r.value for r in registry.QUERIES["gammachirp_bank"](spark, f"{tmp_path}").collect()}
    _, bank = kernels.gammachirp_bank()
    want = {(s, t): v for s, h in enumerate(bank) for t, v in enumerate((np.abs(np.convolve(x, h, "valid")) ** 2)[::5])}
    assert len(bank) == 100 and set(got) == set(want)
    assert all(np.isclose(got[k], v, rtol=1e-6, atol=2e-6) for k, v in want.items())


def test_structure_features_have_all_textures(spark, tmp_path):
    v = np.random.default_rng(2).normal(size=(64, 150))
    spark.createDataFrame([(t, v[:, t].tolist()) for t in range(v.shape[1])], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.feature, r.scale, r.frame): r.value for r in registry.QUERIES["structure_features"](spark, f"{tmp_path}").collect()}
    model, areas = (df.collect() for df in calibration.calibrate(synthetic.noise_plane(spark, 64, 2000)))

    def at(plane, s, t):
        return plane[s, t] if 0 <= s < plane.shape[0] and 0 <= t < plane.shape[1] else np.nan

    want = {}
    for x in ("f", "u", "s", "d"):
        p, b = np.full(v.shape, np.nan), np.full(v.shape, np.nan)
        for s in range(64):
            sides = [r for r in model if (r.texture, r.axis, r.scale) == (x, "principal", s) and r.found]
            if len(sides) == 2:
                taps = [q for r in sides for q in ((s + r.super_scale, r.super_frame, 0.5 * (1 - r.delta)), (s + r.sub_scale, r.sub_frame, 0.5 * r.delta))]
                p[s] = [v[s, t] - sum(w * at(v, a, t + k) for a, k, w in taps) for t in range(v.shape[1])]
        for s in range(64):
            area = [(r.runscale, k) for r in areas if (r.texture, r.scale) == (x, s) for k in range(r.start_frame, r.end_frame + 1)]
            if area:
                b[s] = [np.mean([at(p, r, t + k) ** 2 for r, k in area]) for t in range(v.shape[1])]
        # both are cropped to where the tract is valid for every scale that is left
        used = [s for s in range(64) if not np.isnan(b[s]).all()]
        frames = [t for t in range(v.shape[1]) if not np.isnan(b[used, t]).any()]
        outside = np.ones(v.shape, bool)
        outside[used[0] : used[-1] + 1, frames[0] : frames[-1] + 1] = False
        p[outside] = b[outside] = np.nan
        want |= {(f"{x}_{kind}", s, t): z[s, t] for kind, z in (("pattern", p), ("tract", b)) for s, t in zip(*np.nonzero(~np.isnan(z)))}
    assert {k[0] for k in want} == {f"{x}_{kind}" for x in "fusd" for kind in ("pattern", "tract")}
    assert set(got) == set(want) and all(np.isclose(got[k], z, atol=2e-6) for k, z in want.items())
