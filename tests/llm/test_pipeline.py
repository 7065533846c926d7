"""The whole pipeline against plain loops over the documents."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatloom.llm import quality, toxicity
from heatloom.llm.common import save


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def without_toxic(docs, labels):
    known = sorted((i, y) for i, (_, y) in labels.items() if y in (0, 1) and i in docs and fold(i, 5) != 0)
    model = toxicity.train([docs[i][0] or "" for i, _ in known], [y for _, y in known])
    return {i: d for i, d in docs.items() if toxicity.text_score(d[0], *model) < 0.5}


def without_poor(docs, labels):
    x = {i: np.array(quality.statistics(t)) for i, (t, _) in docs.items()}
    sides, rows = {}, {y: np.array([x[i] for i, (q, _) in labels.items() if q == y and i in x and fold(i, 4) != 2]) for y in (0, 1)}
    n = sum(map(len, rows.values()))
    pooled = sum(len(r) * np.cov(r.T, bias=True) for r in rows.values()) / n
    for y, r in rows.items():
        c = 0.85 * np.cov(r.T, bias=True) + 0.15 * np.diag(np.maximum(np.diag(pooled), 1e-4))
        inverse, log_det = np.linalg.inv(c), np.linalg.slogdet(c)[1]
        sides[y] = {i: np.log(len(r) / n) - 0.5 * log_det - 0.5 * (v - r.mean(axis=0)) @ inverse @ (v - r.mean(axis=0)) for i, v in x.items()}
    return {i: d for i, d in docs.items() if 1 / (1 + np.exp(sides[0][i] - sides[1][i])) >= 0.7}


def words(text):
    return "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ")


def first_of_each_group(docs):
    sets = {}
    for i, (t, _) in docs.items():
        w = [x for x in words((t or "").lower()) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: docs[i] for i in ids if find(i) == i}


def time_of(share, levels):
    """When a curve has asked for a share of its integral, by halving."""
    asked = lambda t: np.trapezoid(np.interp(np.array([0, min(t, 0.5), t]), [0, 0.5, 1], levels), [0, min(t, 0.5), t])
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if asked(mid) <= share * asked(1.0) else (low, mid)
    return low


def in_mixed_order(docs):
    """(time, doc_id) of every copy that is kept, in order."""
    size = {i: sum(1 for w in words(t) if w) for i, (t, _) in docs.items()}
    sources = sorted({s for _, s in docs.values()}, key=lambda s: (s is None, s or ""))
    whole = {s: sum(size[i] for i, (_, x) in docs.items() if x == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, free = {}, set(sources)
    while free:
        left = sum(whole.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * whole[s]}
        target |= {s: 3 * whole[s] for s in over} if over else share
        free -= over or free
    out = []
    for k, s in enumerate(sources):
        stream = sorted((i for i, (_, x) in docs.items() if x == s), key=lambda i: (hashlib.md5(f"{i}:{size[i]}".encode()).hexdigest(), size[i]))
        at, end = 0, round(target[s])
        while at < end and whole[s]:
            for i in stream:
                took = min(size[i], end - at)
                if took > 0 and took * 2 >= size[i]:
                    out.append((time_of(at / target[s], ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))[k % 3]), i))
                at += max(0, took)
    return sorted(out)


def test_stages_against_loops(spark, sf_dir):
    import corpus_pipeline as p

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = {r["doc_id"]: (r["text"], r["source"]) for r in table.collect()}
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    steps = (lambda d: without_toxic(d, labels), lambda d: without_poor(d, labels), first_of_each_group)
    for (name, stage), step in zip(p.STAGES, steps, strict=False):
        table, before, docs = save(stage(spark, table, sf_dir), name), len(docs), step(docs)
        assert sorted(r["doc_id"] for r in table.collect()) == sorted(docs) and len(docs) < before, name
    mixed = save(p.mix_sources(spark, table, sf_dir), "mixed")
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    found = [r["doc_id"] for r in mixed.select("doc_id", part.alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect()]
    want = in_mixed_order(docs)
    assert len(found) == len(want)
    time = defaultdict(list)
    for t, i in want:
        time[i].append(t)
    got = [time[i].pop(0) for i in found]
    assert all(b >= a - 1e-9 for a, b in zip(got, got[1:], strict=False))
    pieces = p.pack_sequences(spark, mixed, sf_dir).where("start = 0").orderBy("sequence_id", "offset").collect()
    assert [r["doc_id"] for r in pieces] == found


def test_near_copies_at_the_threshold_are_found(spark):
    """Of 2,000 near copies at a similarity of 0.80 to 0.82 with their originals, practically all go (0.9995 each by formula)."""
    from heatloom.llm import simhash

    rng = np.random.default_rng(7)
    rows = []
    for g in range(2000):
        n = int(rng.integers(40, 90))
        base = [f"w{rng.integers(10**9)}" for _ in range(n)]
        more = int((n - 4) / rng.uniform(0.80, 0.82)) - (n - 4)
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join([*base, *[f"x{rng.integers(10**9)}" for _ in range(more)]]))]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert kept <= 2000 + 5


@pytest.mark.parametrize("name", ["target", "source_size", "taken", "copies", "row", "order", "bucket", "before", "levels", "of"])
def test_mixing_with_clashing_columns(spark, name):
    from heatloom.llm import mixing

    rows = [(i, f"s{i % 3}" if i % 7 else None, 1 + i % 9, "own") for i in range(60)]
    found = mixing.mixed(spark.createDataFrame(rows, f"doc_id long, source string, size long, `{name}` string"))
    assert found.columns.count(name) == 1 and found.count() == 60
    if name not in ("target", "source_size", "taken", "copies"):
        assert {r[name] for r in found.collect()} == {"own"}
