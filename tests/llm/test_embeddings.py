"""Operator 10: groups of tiles, products of some components, and what is shuffled."""
import os

import numpy as np
import pytest

from glare.llm import embeddings


def copies(n, d, seed):
    """Ids and vectors: strangers, near copies on both sides of the threshold, a large group."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    k = n // 5
    x[:k] = x[k:2 * k] + rng.normal(size=(k, d)) * rng.uniform(0.05, 0.6, size=(k, 1))
    x[2 * k:3 * k] = x[0] + rng.normal(size=(k, d)) * 0.22
    return rng.permutation(n).tolist(), x[rng.permutation(n)].astype(np.float32)


def brute(ids, x, threshold):
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    least = np.array(ids)
    while True:
        less = np.minimum(least, np.where(near, least[None, :], 1 << 40).min(axis=1))
        if (less == least).all():
            return sorted(zip(ids, near.sum(axis=1).tolist(), least.tolist()))
        least = less


@pytest.mark.parametrize("kind, d, tile, threshold", [("float", 64, 16, 0.95), ("double", 40, 7, 0.8), ("float", 3, 64, 0.99)])
def test_groups_of_tiles_by_brute_force(spark, kind, d, tile, threshold):
    ids, x = copies(700, d, d)
    df = spark.createDataFrame([(i, v) for i, v in zip(ids, x.tolist())], f"vec_id long, embedding array<{kind}>").repartition(3)
    out = embeddings.near_vectors(df, threshold=threshold, tile=tile).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == brute(ids, x, threshold)


def test_vectors_are_not_shuffled_to_every_tile(spark):
    def shuffled():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {f: os.path.getsize(f"{d}/{f}") for top in blocks.localDirsString() for d, _, names in os.walk(top)
                for f in names if f.startswith("shuffle_") and f.endswith(".data")}

    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(2000, 32)).tolist())], "vec_id long, embedding array<double>")
    before = shuffled()
    assert embeddings.near_vectors(df, tile=32).count() == 2000  # 63 tiles
    assert sum(v for k, v in shuffled().items() if k not in before) < 2000 * 32 * 8


def test_first_products_are_never_too_low(tmp_path):
    from pyarrow.fs import LocalFileSystem

    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 48)) * rng.uniform(0.01, 3, size=48)
    x[100:150] = x[:50] + rng.normal(size=(50, 48)) * 0.01
    b = embeddings.tile_bytes(x, np.arange(300), np.arange(300), "<f8")
    (tmp_path / "t").write_bytes(b + b)
    g = embeddings.Group(LocalFileSystem(), str(tmp_path), 48, [{"file": "t", "at": k * len(b), "n": 300} for k in (0, 1)], "<f8")
    assert (g.vectors(np.array([0, 7, 299, 300, 599])) == embeddings.unit(x)[[0, 7, 299, 0, 299]]).all()
    u, v = embeddings._first_products(g, g)
    cos = embeddings.unit(x) @ embeddings.unit(x).T
    assert u.shape[1] < 48 and ((u @ v.T)[:300, :300] >= cos - 1e-5).all()
