import numpy as np
import pytest
from pyspark.sql import functions as F

from heatloom.llm import nearest
from heatloom.llm.common import save

VECTORS = "vec_id long, embedding array<float>, label int, rank int, score string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 0, "x") for i, v in rows], VECTORS)


def brute(rows, every, k=10):
    rows = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows]
    out = {}
    for q, v in rows:
        if q % every == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in rows if i != q)[:k]
            out[q] = [(i, d) for d, i in near]
    return out


def test_recall_and_scores(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute(rows, 100)
    found = {}
    for r in nearest.op8_nearest(spark, sf_dir).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(want)
    hits = sum(len({v for _, v, _ in found[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = {q: dict(w) for q, w in want.items()}
    for q, got in found.items():
        assert [r for r, _, _ in got] == list(range(1, len(got) + 1))
        assert [(s, v) for _, v, s in got] == sorted((s, v) for _, v, s in got)
        assert all(s == pytest.approx(exact[q][v], abs=1e-12) for _, v, s in got if v in exact[q])


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=7) * (1 + i % 3)) for i in range(1, 60)] + [(i, np.ones(7)) for i in range(100, 160)] + [(200, np.ones(7))]
    bad = [(300, None), (400, []), (500, [0.0] * 7), (600, [float("nan")] * 7), (700, [1.0, None, 1, 1, 1, 1, 1]), (800, [float("inf")] + [1.0] * 6), (900, [1.0, 2.0]), (None, [1.0] * 7)]
    got = nearest.nearest(vectors(spark, [*rows, *bad, rows[3]]), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    want = brute(rows, 100)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["vec_id"], pytest.approx(r["score"], abs=1e-9)))
    assert found == want


def doubles(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")


def brute_doubles(rows, every, k=10):
    out = {}
    with np.errstate(over="ignore"):
        for q, v in rows:
            if q % every == 0:
                out[q] = [i for _, i in sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in rows if i != q)[:k]]
    return out


def test_double_vectors_are_ranked_as_doubles(spark):
    """Vectors that float32 can't tell apart, and vectors whose squares overflow."""
    rng = np.random.default_rng(6)
    close = [(i, np.arange(8) + 1e-9 * rng.normal(size=8)) for i in range(1, 401)]
    huge = [(i, np.array([1e200 if j == 0 and i in (3, 6) else rng.normal() for j in range(4)])) for i in range(1, 10)]
    for rows, every in ((close, 100), (huge, 3)):
        found = {}
        for r in nearest.nearest(doubles(spark, rows), F.col("vec_id") % every == 0).orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append(r["vec_id"])
        assert found == brute_doubles(rows, every)


def test_a_dense_group_of_near_copies(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=64)
    rows = [(i, centre + 0.05 * rng.normal(size=64) if i < 4000 else rng.normal(size=64)) for i in range(9000)]
    found = {}
    for r in nearest.nearest(vectors(spark, rows), F.col("vec_id") % 1000 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], pytest.approx(r["score"], abs=1e-9)))
    assert found == brute(rows, 1000)


def test_few_and_no_candidates(spark):
    found = nearest.nearest(vectors(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.5]), (2, [3.0, 1.0])]), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["rank"]) for r in found] == [(1, 1), (2, 2)]
    assert nearest.nearest(vectors(spark, [(0, [1.0, 2.0])]), F.col("vec_id") == 0).count() == 0
    assert nearest.nearest(vectors(spark, []), F.col("vec_id") == 0).count() == 0


def test_parallel_errors_weigh_more():
    """The anisotropic codes have a smaller error along the vector than plain nearest centroids."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 64))
    q = nearest.Quantizer(64).fit(x)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    decoded = lambda c: np.concatenate([q.centroids[p][c[:, p]] for p in range(q.parts)], axis=1)
    plain = ((q.split(x)[:, :, None, :] - q.centroids[None]) ** 2).sum(axis=3).argmin(axis=2)
    along = lambda c: float((((x - decoded(c)) * unit).sum(axis=1) ** 2).mean())
    assert along(q.encode(x)) < 0.7 * along(plain)


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in p.STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0
    pieces = save(p.STAGES[-1][1](spark, docs, sf_dir), "pieces")
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").distinct().collect()}
    assert save(p.run(spark, sf_dir), "run").count() > 0


def test_pipeline_of_odd_rows(spark, sf_dir):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, copies string, score string"
    rows = [(1, None, None, None, None, "a", "b", "c"), (None, "some words here", "en", "s", 1, "a", "b", "c"), (2, "", "en", "s", 0, "a", "b", "c"), (3, "x y z", "en", None, 5, "a", "b", "c"), (3, "x y z", "en", None, 5, "a", "b", "c")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in p.STAGES[:-1]:
            out = save(stage(spark, docs, sf_dir), name)
            assert out.columns == docs.columns
        p.pack_sequences(spark, docs, sf_dir).count()


def test_mixing_order_reaches_packing(spark, sf_dir):
    """Sequences follow the order of the mixed files, not of doc_id."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = save(p.mix_sources(spark, docs, sf_dir), "mixed")
    order = [r["doc_id"] for r in mixed.select("doc_id", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect()]
    pieces = p.pack_sequences(spark, mixed, sf_dir).where("start = 0").orderBy("sequence_id", "offset").collect()
    assert [r["doc_id"] for r in pieces] == order
