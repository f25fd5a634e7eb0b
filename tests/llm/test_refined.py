"""Recall of the vector search with refined cells."""

import numpy as np

from remitlens.llm.ann import nearest


def test_recall_with_refined_cells(spark):
    """5000 vectors at one a cell (32 axes more), neighbours as near as among some millions of random vectors."""
    rng = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centre = np.repeat(unit(rng.standard_normal((200, 64))), 25, axis=0)
    x = unit(np.sqrt(0.52) * centre + np.sqrt(0.48) * unit(rng.standard_normal((5000, 64)))).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = nearest(table, table.filter("vec_id % 40 = 0"), k=20, occupancy=1).collect()
    found: dict = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    scores = x.astype(float) @ x.T.astype(float)
    np.fill_diagonal(scores, -2)
    recall = np.mean([len(found.get(q, set()) & set(np.argsort(-scores[q], kind="stable")[:20].tolist())) / 20 for q in range(0, 5000, 40)])
    assert recall >= 0.9
