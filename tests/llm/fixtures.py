import numpy as np


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def groups(sizes, dim=64, noise=0.03, seed=0):
    """Rows of like vectors: one group per size, and the group of each row."""
    rng = np.random.default_rng(seed)
    centres = unit(rng.standard_normal((len(sizes), dim)))
    label = np.repeat(np.arange(len(sizes)), sizes)
    return unit(centres[label] + noise * rng.standard_normal((len(label), dim))), label


def table(spark, m, path, ids=None):
    """``(id, v, cell)`` as a written table; the extra column has a name that operators use inside."""
    ids = ids or [f"s{i:05d}" for i in range(len(m))]
    df = spark.createDataFrame([(i, [float(x) for x in v], 7) for i, v in zip(ids, m)], "id string, v array<float>, cell int")
    df.repartition(3).write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))
