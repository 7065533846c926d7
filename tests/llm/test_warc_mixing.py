import base64
import hashlib
import io
import re
import uuid
from collections import Counter, defaultdict

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

from heatloom.llm import catalog, mixing, warc
from heatloom.llm.common import save

PAGES = "page_id long, url string, html string, payload string, digest string"


@pytest.mark.parametrize("name", ["op2_warc", "op3_mixing"])
def test_same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    ours = catalog.queries()[name](spark, sf_dir)
    columns = sorted(ours.columns)
    plain = lambda rows: sorted(repr([None if v is None or v != v else v for v in r]) for r in rows)
    theirs = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert plain(map(tuple, ours.select(columns).collect())) == plain(theirs)


def pages(spark):
    rows = [(i, f"http://h/{i}", None if i % 50 == 7 else "" if i % 50 == 8 else "same" if i % 3 == 0 else f"<p>é {i}</p>" * (i + 1), "x", "y") for i in range(300)]
    return spark.createDataFrame([*rows, (None, None, "same", None, None), (5, "again", "again", None, None), (5, "again", "again", None, None)], PAGES)


def test_records_round_trip(spark, tmp_path):
    source = pages(spark)
    bundles = save(warc.write_bundles(source), "b")
    found = warc.read_bundles(bundles).collect()
    assert len(found) == 303
    html = defaultdict(set)
    for r in source.collect():
        html[r["page_id"]].add((r["html"] or "").encode())
    last = {}
    for i, payloads in html.items():
        for p in payloads:
            last[p] = max(last.get(p, -1), -1 if i is None else i)
    for r in found:
        payload = next(p for p in html[r["page_id"]] if len(p) == r["payload_bytes"])
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        revisit = r["page_id"] != last[payload]
        assert (r["record_type"], r["refers_to"]) == (("revisit", last[payload]) if revisit else ("response", None))


def test_bundles_are_seekable_files(spark, tmp_path, monkeypatch):
    bundles = save(warc.write_bundles(pages(spark)), "b")
    warc.save_bundles(bundles, str(tmp_path))
    index = warc.record_index(bundles).collect()
    assert len(index) == 303
    for r in index[::17]:
        data = (tmp_path / f"{r['bundle_id']}.warc.zst").read_bytes()
        record = warc.read_record(data, r["frame"], r["offset"], r["length"])
        fields, http, payload = warc.parse_record(record)
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["warc-date"]) and fields["content-type"] == "application/http; msgtype=response"
        assert http["content-type"].startswith("text/html") and (len(payload) == int(http["content-length"]) or fields["warc-type"] == "revisit")
        assert record.startswith(b"WARC/1.1\r\n") and fields["warc-record-id"] == r["record_id"]
        # An ordinary reader sees one stream; the seek table is a skippable frame.
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        assert whole.count(b"WARC/1.1\r\n") == sum(x["bundle_id"] == r["bundle_id"] for x in index)


def test_minimum_size_of_revisits(spark):
    rows = spark.createDataFrame([(1, "u", "ab", "", ""), (2, "u", "ab", "", ""), (3, "u", "abc", "", ""), (4, "u", "abc", "", "")], PAGES)
    found = {r["page_id"]: r["record_type"] for r in warc.read_bundles(save(warc.write_bundles(rows, min_bytes=3), "b")).collect()}
    assert found == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_frames_and_damage():
    bundle = warc._Bundle()
    for i in range(40):
        bundle.add(warc.record_name(i), warc.warc_record(i, None, bytes([i]) * 20_000, 20_000, "d", None, "2024-05-01T00:00:00Z"))
    row = bundle.row("x").iloc[0]
    assert len(warc.frame_starts(row["data"])) > 2
    assert warc.parse_record(warc.read_record(row["data"], *[row["index"][33][k] for k in ("frame", "offset", "length")]))[2] == bytes([33]) * 20_000
    with pytest.raises(ValueError):
        warc.frame_starts(b"no bundle at all")


def test_names_and_urls():
    for page_id in (None, 0, 1, -1, 2**63 - 1, -(2**63), 1 << 62):
        name = warc.record_name(page_id)
        assert warc.page_of(name) == page_id and uuid.UUID(name[len("<urn:uuid:") : -1]).version == 8
    record = warc.warc_record(5, "http://a.example/a b\r\nc?x=é", b"p", 1, "d", 9, "2024-05-01T00:00:00Z")
    fields, _, payload = warc.parse_record(record)
    assert fields["warc-target-uri"] == "http://a.example/a%20b%0D%0Ac?x=é" and fields["warc-type"] == "revisit"
    assert fields["warc-refers-to"] == warc.record_name(9) and payload == b"p"


def test_empty_pages(spark):
    assert warc.read_bundles(save(warc.write_bundles(spark.createDataFrame([], PAGES)), "b")).count() == 0


SIZES = "doc_id long, source string, size long, copies string"


def stopped_targets():
    """The water level by simple repetition of the rule."""
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 7, "e": 0, None: 300}
    weights = dict(zip(sizes, (5, 2, 1, 5, 2, 1), strict=True))
    total, target = sum(sizes.values()), {}
    free = set(sizes)
    while True:
        left = total - sum(target.values())
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * sizes[s] for s in over}
        free -= over
    return sizes, target


def test_mix(spark):
    sizes, target = stopped_targets()
    rows = [(100 * i + j, s, n // 10 + (j < n % 10), "x") for i, (s, n) in enumerate(sizes.items()) for j in range(10)]
    docs = spark.createDataFrame(rows, SIZES)
    found = mixing.mixed(docs.drop("copies")).collect()
    assert len(found) == len(rows)
    taken = Counter()
    for r in found:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and sum(c["words"] for c in r["copies"]) == r["taken"]
        assert all(0 <= c["time"] <= 1 for c in r["copies"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)


def test_due_time_inverts_the_integral(spark):
    """At the time found, the integral of the curve up to there is the share asked for."""
    import numpy as np

    for curve in ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.0, 2.0, 0.0, 1.0)):
        shares = [i / 20 for i in range(21)]
        df = spark.createDataFrame([(s,) for s in shares], "s double")
        times = [r["t"] for r in df.select("s", mixing.due_time(F.col("s"), F.array(*[F.lit(float(c)) for c in curve])).alias("t")).collect()]
        grid = np.linspace(0, 1, 200_001)
        area = np.cumsum(np.interp(grid, np.linspace(0, 1, len(curve)), curve))
        area /= area[-1]
        for s, t in zip(shares, times, strict=True):
            assert np.interp(t, grid, area) == pytest.approx(s, abs=1e-3)


def test_early_sources_come_early(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.length("text").cast("long").alias("size"))
    place = {r["source"]: i % 3 for i, r in enumerate(docs.select("source").distinct().orderBy("source").collect())}
    times = defaultdict(list)
    for r in mixing.mixed(docs).select("source", F.explode("copies").alias("c")).collect():
        times[place[r["source"]]].append(r["c"]["time"])
    mean = {k: sum(v) / len(v) for k, v in times.items()}
    assert mean[0] < mean[1] < mean[2]


def test_many_buckets_and_empty(spark, monkeypatch):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 7).alias("size"))
    a = {r["doc_id"]: r["taken"] for r in mixing.mixed(docs).collect()}
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 13)
    assert {r["doc_id"]: r["taken"] for r in mixing.mixed(docs).collect()} == a
    assert mixing.mixed(docs.limit(0)).count() == 0
