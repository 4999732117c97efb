"""The logistic ranker against a plain fit, and the figures against the history against a loop."""

from __future__ import annotations

import numpy as np
import pytest

from brambleflow.operators import ltr


def plain_logistic(x, y, w):
    """Newton's method on the weighted loss with half the squared coefficients; the intercept is free."""
    x1 = np.column_stack([x, np.ones(len(x))])
    b, free = np.zeros(x1.shape[1]), np.append(np.ones(x.shape[1]), 0.0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x1 @ b))
        gradient = x1.T @ (w * (p - y)) + free * b
        step = np.linalg.solve((x1 * (w * p * (1 - p))[:, None]).T @ x1 + np.diag(free), gradient)
        b -= step
        if np.abs(step).max() < 1e-12:
            break
    return b


@pytest.mark.parametrize("weighted", [False, True])
def test_logistic_ranker_equals_a_plain_fit(spark, weighted):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)) * [1.0, 5.0, 0.2]
    y = (x @ [1.0, -0.3, 2.0] + rng.logistic(size=300) > 0).astype(float)
    w = rng.choice([0.8, 1.0, 2.5], 300) if weighted else np.ones(300)
    rows = [(f"u{i % 20}", f"i{i}", *map(float, x[i]), float(y[i]), float(w[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "user_id string, item_id string, a double, b double, c double, label double, w double")
    model = ltr.trained_ranker(df, ["a", "b", "c"], weight="w" if weighted else None)
    b = plain_logistic(x, y, w)
    assert np.allclose(model.stages[-1].coefficients.toArray(), b[:3], atol=2e-3) and abs(model.stages[-1].intercept - b[3]) < 2e-3
    got = {(r.user_id, r["rank"]): r.item_id for r in ltr.reranked(model, df, 5).collect()}
    score = x @ b[:3]
    for u in range(20):
        own = [i for i in range(300) if i % 20 == u]
        best = sorted(own, key=lambda i: -score[i])
        gaps = np.diff([score[i] for i in best[:6]])
        for k in range(5):
            if (k == 0 or gaps[k - 1] < -0.02) and gaps[k] < -0.02:
                assert got[f"u{u}", k + 1] == f"i{best[k]}"


def test_figures_against_the_history_by_a_loop(spark):
    rng = np.random.default_rng(2)
    sizes = {"text": 3, "image": 2, "multi": 5}
    vec = lambda n: rng.normal(size=n).tolist()
    items = {f"i{k}": {m: None if (k, m) in {(1, "text"), (2, "image"), (3, "multi")} else [0.0] * n if k == 4 else vec(n) for m, n in sizes.items()} for k in range(12)}
    features = spark.createDataFrame([(i, *(v[m] for m in sizes)) for i, v in items.items()], "item_id string, text_vec array<double>, image_vec array<double>, multi_vec array<double>")
    history = [("u", f"i{k}", k) for k in (0, 1, 2, 3, 4, 5)] + [("v", "i6", 1), ("gone", "nothing", 1)]
    pairs = [("u", "i7"), ("u", "i1"), ("u", "i4"), ("u", "unknown"), ("v", "i6"), ("v", "i3"), ("gone", "i7"), ("new", "i7")]
    got = {(r.user_id, r.item_id): r for r in ltr.history_similarities(spark.createDataFrame(pairs, "user_id string, item_id string"), spark.createDataFrame(history, "user_id string, item_id string, ts long"), features, sizes).collect()}
    assert set(got) == {p for p in pairs if p[0] in "uv"}
    unit = lambda v: None if v is None else np.array(v) / (np.linalg.norm(v) or 1)
    cos = lambda a, b: 0.0 if a is None or b is None or not np.linalg.norm(a) * np.linalg.norm(b) else float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    for (u, i), r in got.items():
        for m in sizes:
            seen = [unit(items[j][m]) for x, j, _ in history if x == u and items.get(j, {}).get(m) is not None]
            raw = items.get(i, {}).get(m)
            c = unit(raw)
            near = [max(float(np.dot(h, c)), 0.0) if c is not None else 0.0 for h in seen]
            sims = [float(np.dot(h, c)) if c is not None else 0.0 for h in seen] if m == "multi" else [float(np.dot(h, raw)) for h in seen] if raw is not None else []
            for name, f in (("max", np.max), ("mean", np.mean), ("min", np.min), ("std", np.std)):
                value = r[f"{m}_{name}"]
                assert value is None if not sims else value == pytest.approx(float(f(sims)), abs=1e-9)
            pooled = None if not seen else np.sum([w * h for w, h in zip(near, seen, strict=True)], 0) if sum(near) > 0 else np.mean(seen, 0)
            assert r[f"{m}_attention"] == pytest.approx(cos(pooled, c), abs=1e-9)
            if m == "multi":
                assert r.user_avg_sim == pytest.approx(cos(np.mean(seen, 0) if seen else None, c), abs=1e-9)
                assert r.attention_std == pytest.approx(np.std(near) / sum(near) if sum(near) else 0.0, abs=1e-9)
                assert r.attention_max == pytest.approx(max(near) / sum(near) if sum(near) else 1 / len(seen), abs=1e-9)
