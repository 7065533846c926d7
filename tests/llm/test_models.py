import zlib

import numpy as np
import pytest

from heatloom.llm import quality, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, statistics string"
LABEL = "doc_id long, quality int, toxic int, y string"


def auc(scores, labels):
    ranks = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1.0
    for v in np.unique(scores):
        ranks[scores == v] = ranks[scores == v].mean()
    n1 = labels.sum()
    return (ranks[labels == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(labels) - n1))


def clean_text(rng, n):
    return " ".join("".join(rng.choice(list("aeioulnrst"), rng.integers(2, 9))) for _ in range(n))


def toxic_text(rng, n):
    words = clean_text(rng, n).split()
    for i in rng.choice(n, max(1, n // 40), replace=False):
        words[i] = str(rng.choice(["blockhead", "numskull", "dimwitted"]))
    return " ".join(words)


def write(tmp_path, spark, docs, labels):
    spark.createDataFrame([(i, t, "en", "s", None, "x", "y") for i, t in docs], DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, LABEL).write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


@pytest.fixture(scope="module")
def toxic_folder(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    docs, labels = [], []
    for i in range(600):
        toxic = int(i % 4 == 0)
        docs.append((i, (toxic_text if toxic else clean_text)(rng, int(rng.integers(20, 300)))))
        labels.append((i, 1, toxic, "z"))
    docs += [(1000, "what a blokhead numskul"), (1001, None), (1002, ""), (None, "a clean text without an id"), (1003, clean_text(rng, 40_000) + " blockhead numskull dimwitted"), (1004, "x" * 600_000)]
    labels += [(1001, None, None, "z"), (None, 1, 1, "z"), (7777, 0, 1, "z")]
    return write(tmp_path_factory.mktemp("toxic"), spark, docs, labels)


def test_toxicity(spark, toxic_folder):
    rows = {r["doc_id"]: r for r in toxicity.op1_toxicity(spark, toxic_folder).collect()}
    assert len(rows) == 606
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items() if i is not None)
    held = [i for i in range(600) if rows[i]["held_out"]]
    scores, labels = np.array([rows[i]["score"] for i in held]), np.array([int(i % 4 == 0) for i in held])
    assert auc(scores, labels) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    assert rows[1000]["predicted"] == 1, "misspellings share n-grams"
    assert rows[1003]["predicted"] == 1, "three words at the end of a very long text"
    assert rows[1001]["score"] == rows[1002]["score"] < 0.5


def test_training_ignores_the_held_out_fold(spark, toxic_folder):
    docs, labels = (spark.read.parquet(f"{toxic_folder}/{t}.parquet") for t in ("documents", "labels"))
    texts, y = toxicity.training_rows(docs, labels, "toxic", 5, 0, 1500, 1 << 25)
    held = {r["text"] for r in docs.collect() if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    assert not held & set(texts) and len(texts) == len(y) > 400
    few, _ = toxicity.training_rows(docs, labels, "toxic", 5, 0, 10, 1 << 25)
    assert len(few) == 20 and set(few) <= set(texts)
    small, _ = toxicity.training_rows(docs, labels, "toxic", 5, 0, 1500, 20_000)
    assert 10 < len(small) < len(texts) and sum(map(len, small)) < 50_000, "a class ends with the row that reaches its bytes"


def test_subwords_by_hand():
    """Every n-gram of the framed words once, by a plain loop."""
    for raw in (b"ab", b"Hi, a bcd! 12", b"", b"  ", "né à".encode(), b"abcdefghij"):
        buckets, owners, n = toxicity.subwords(raw)
        words = bytes(toxicity._CLASS[b] or 32 for b in raw).split(b" ")
        words = [w for w in words if w]
        assert n == len(words) and len(buckets) == len(owners)
        assert np.bincount(owners, minlength=n).tolist() == [sum(max(0, len(w) + 2 - k + 1) for k in toxicity.SIZES) for w in words] if n else len(owners) == 0
    a, _, _ = toxicity.subwords(b"xx idiot yy")
    b, _, _ = toxicity.subwords(b"IDIOT")
    assert set(b.tolist()) <= set(a.tolist())


def test_parts_have_the_passages_of_the_whole(monkeypatch):
    """Wherever a border falls, a text scores as in one part: no word is torn, no passage lost or added."""
    whole = np.random.default_rng(3).normal(size=toxicity.BUCKETS)
    texts = ["", None, "word " * 20, "x" * 100, "a\n" * 33, " ".join(f"w{i * i}" for i in range(90)), "y" * 70 + " b " + "z" * 200 + " c d", "  , " * 40 + "e"]
    texts += ["fill " * 10 + " " * n + "zukunftsweg und zuk ende " + "fill " * 10 for n in range(70)]
    scores = [toxicity.worst_passage(t, whole) for t in texts]
    monkeypatch.setattr(toxicity, "CHUNK", 64)
    for text, score in zip(texts, scores, strict=True):
        parts = list(toxicity.chunks(text))
        words = [toxicity.subwords(p)[2] for p in parts]
        assert sum(words) - max(0, len(parts) - 1) * (toxicity.PASSAGE - 1) == toxicity.subwords((text or "").encode())[2]
        assert all(len(p) <= 64 + 300 for p in parts) and (len(parts) > 1 or len((text or "").encode()) < 400)
        assert toxicity.worst_passage(text, whole) == pytest.approx(score, abs=1e-9)


def test_a_word_in_front_moves_nothing():
    """Passages overlap, so what stands before a text leaves its worst passage as it is."""
    margin = np.random.default_rng(4).normal(size=toxicity.BUCKETS)
    text = "some quite plain words and a numskull among them"
    alone = toxicity.worst_passage(text, margin)
    for front in ("x", "a b", "three more words"):
        assert toxicity.worst_passage(f"{front} {text}", margin) >= alone - 1e-12
    means = [toxicity.passage_means(margin, *toxicity.subwords(p.encode()))[0] for p in zip_words(text, toxicity.PASSAGE)]
    assert alone == pytest.approx(max(means))


def zip_words(text, n):
    words = text.split()
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def test_models_without_labels(spark, tmp_path):
    folder = write(tmp_path, spark, [(1, "a b"), (2, None)], [])
    assert [r["predicted"] for r in toxicity.op1_toxicity(spark, folder).collect()] == [0, 0]
    assert quality.op10_quality(spark, folder).count() == 2
    empty = write(tmp_path / "e", spark, [], [])
    assert toxicity.op1_toxicity(spark, empty).count() == quality.op10_quality(spark, empty).count() == 0


def poor_text(rng, n, kind):
    words = clean_text(rng, n).split()
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 1:
        return " ".join(w + "###" for w in words)
    return " ".join([words[0]] * n)


def test_quality(spark, tmp_path):
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(600):
        good = int(i % 4 != 0)
        docs.append((i, clean_text(rng, int(rng.integers(20, 300))) if good else poor_text(rng, int(rng.integers(20, 300)), int(rng.integers(3)))))
        labels.append((i, good, 0, "z"))
    docs += [(1001, None), (1002, ""), (None, "a text without an id"), (1003, clean_text(rng, 60_000))]
    rows = {r["doc_id"]: r for r in quality.op10_quality(spark, write(tmp_path, spark, docs, labels)).collect()}
    assert len(rows) == 604
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items() if i is not None)
    held = [i for i in range(600) if rows[i]["held_out"]]
    scores, truth = np.array([rows[i]["score"] for i in held]), np.array([int(i % 4 != 0) for i in held])
    assert auc(scores, truth) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows.values())


def test_moments_and_discriminant_by_hand(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(300, len(quality.STATISTICS))), np.arange(300) % 3 == 0
    x[y] += 1.5
    model = quality.fit(spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y, strict=True)], "y int, statistics array<double>"), shrinkage=0.2)
    pooled = sum(np.cov(x[y == k].T, bias=True) * (y == k).sum() for k in (False, True)) / len(x)
    density = []
    for k in (False, True):
        own = x[y == k]
        c = 0.8 * np.cov(own.T, bias=True) + 0.2 * np.diag(np.diag(pooled))
        d = x - own.mean(axis=0)
        density.append(np.log(len(own) / len(x)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    assert np.allclose(quality.discriminant(x, model), density[1] - density[0])
