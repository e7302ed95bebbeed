"""What learned models answer, against plain versions of the same models."""

import math

import numpy as np

from lotespark.llm import langid, quality

SF = "/root/testdata/sf0.001"


def test_language_scores_are_a_plain_convolution():
    rng = np.random.default_rng(3)
    sizes = [(w, langid.CLASSES, langid.FILTERS) for w in langid.WIDTHS]
    hidden = len(sizes) * langid.FILTERS
    m = langid.Model(("a", "b", "c"), tuple(rng.normal(size=s).astype(np.float32) for s in sizes), rng.normal(size=hidden).astype(np.float32), rng.normal(size=(hidden, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32))
    x = rng.integers(0, langid.CLASSES, (5, langid.WINDOW)).astype(np.uint8)
    x[4, 20:] = langid.PAD
    got = langid.window_probs(m, x, step=2)
    for row, probs in zip(x, got):
        one_hot = np.eye(langid.CLASSES)[row]
        pools = []
        for f in m.filters:
            width = len(f)
            places = [sum(one_hot[p + k] @ f[k] for k in range(width)) for p in range(langid.WINDOW - width + 1)]
            pools.append(np.max(places, axis=0))
        z = np.maximum(np.concatenate(pools) + m.bias, 0) @ m.out + m.out_bias
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.allclose(probs, want, atol=1e-4)


def test_kept_is_the_learned_list_read_in_order(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rules = quality.learn_rules(docs, labels)
    got = quality.quality_rules(docs, labels).collect()
    seen = 0
    for r in got:
        x = {k: np.array([eval(e, {"greatest": max}, r.asDict())], dtype=float) for k, e in quality.FEATURES.items()}
        bad = any(all(bool(t.holds(x)[0]) for t in rule) for rule in rules)
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert (r.base_failed, r.kept) == (failed, not failed and not bad) and all(math.isfinite(v[0]) for v in x.values())
        seen += bad
    assert len(got) == docs.count() and (not rules or seen)
