import hashlib
import random
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from heatloom.functions import names
from heatloom.jobs import importing, rendering, store
from heatloom.operators import maintenance, render, tiles, tracks
from heatloom.sources import files, gpx, tcx
from heatloom.streaming import imports

TRACK = '<trk><name>{name}</name><trkseg>{points}</trkseg></trk>'


def track(name, *places, time=True):
    pts = "".join(f'<trkpt lat="{a}" lon="{b}">' + (f"<time>2024-05-01T10:00:{i:02d}Z</time>" if time else "") + "</trkpt>" for i, (a, b) in enumerate(places))
    return TRACK.format(name=name, points=pts)


def gpx_file(*parts, end="</gpx>"):
    return '<?xml version="1.0"?>\n<gpx xmlns="http://www.topografix.com/GPX/1/1" xmlns:gpxdata="x">\n' + "\n".join(parts) + "\n" + end


TCX = '<TrainingCenterDatabase{ns}><Activities><Activity Sport="Biking"><Lap><Track>{points}</Track></Lap></Activity></Activities></TrainingCenterDatabase>'
TCX_POINT = "<Trackpoint><Time>{t}</Time><Position><LatitudeDegrees>{a}</LatitudeDegrees><LongitudeDegrees>{b}</LongitudeDegrees></Position></Trackpoint>"


def sequential(batch, stored):
    """One row after another, as an import loop would."""
    files_known, contents = {s[0] for s in stored}, {s[1] for s in stored}
    out = {}
    for path, effective, content, n, error in sorted(batch):
        if effective in files_known:
            status = "duplicate"
        elif error:
            status = "error"
        elif n <= 0:
            status = "no_gps_data"
        elif content in contents:
            status = "content_duplicate"
        else:
            status = "imported"
            files_known.add(effective)
            contents.add(content)
        out[path] = status
    return out


@pytest.mark.parametrize("seed", range(4))
def test_dedup_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    content_of = {}
    batch, stored = [], []
    for i in range(120):
        h = f"h{rng.randrange(60)}"
        content_of.setdefault(h, (f"c{rng.randrange(30)}", rng.choice([0, 5, 5, 5]), rng.choice([None, None, None, "bad"])))
        batch.append((f"p{i:03d}", h, *content_of[h]))
    for i in range(10):
        stored.append((f"h{rng.randrange(80)}", f"c{rng.randrange(40)}"))
    rows = spark.createDataFrame(batch, "path string, effective_hash string, content_hash string, num_points long, error string").withColumn("track_index", F.lit(None).cast("int"))
    known = spark.createDataFrame(stored, "file_hash string, content_hash string")
    assert {r["path"]: r["status"] for r in tracks.dedup_import(rows, known).collect()} == sequential(batch, stored)


def test_sanitizer(spark):
    cases = {"<name>R&R</name>": "<name>R&amp;R</name>", "<cmt>A &amp; B &lt;x</cmt>": "<cmt>A &amp; B &lt;x</cmt>", "<g:desc><sigh></g:desc><time>a&b</time>": "<g:desc>&lt;sigh&gt;</g:desc><time>a&b</time>", "": "", "plain": "plain"}
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", names.sanitized_gpx(F.col("x")).alias("y"))
    assert {r["x"]: r["y"] for r in rows.collect()} == cases


def test_route_files(spark):
    results = spark.createDataFrame([("in/a/x.gpx", "imported"), ("in/b/x.gpx", "imported"), ("in/c/x.gpx", "error"), ("in/c/x.gpx", "imported"), ("in/y.fit", "duplicate")], "path string, status string")
    there = spark.createDataFrame([("done", "x.gpx"), ("done", "x_1.gpx")], "folder string, name string")
    found = {r["path"]: r["target"] for r in tracks.route_files(results, there).collect()}
    assert found == {"in/a/x.gpx": "done/x_2.gpx", "in/b/x.gpx": "done/x_3.gpx", "in/c/x.gpx": "errors/x.gpx", "in/y.fit": "done/y.fit"}


@pytest.fixture
def folder(tmp_path):
    inbox = tmp_path / "in"
    (inbox / "done").mkdir(parents=True)
    (inbox / "a.gpx").write_text(gpx_file(track("R&R <sigh>", (46.5, -87.5), (46.501, -87.5)), "<trk><name>broken</trk>", track("indoor"), track("second", (46.6, -87.4), (46.6, -87.401), ("x", 1), (91, 2), (46.6, -181))))
    (inbox / "b.GPX").write_text(gpx_file(track("same ride", (46.5, -87.5), (46.501, -87.5), time=False)))
    (inbox / "c.gpx").write_text(gpx_file(track("one", (1, 1), (1, 1.001)) + track("two", (2, 2), (2, 2.001)), track("cut", (3, 3), (3, 3.001))[: -len("</trk>")], end=""))
    (inbox / "d.gpx").write_text(gpx_file('<g:trk><g:name>p</g:name><g:trkseg><g:trkpt lat="5" lon="5"/><g:trkpt lat="5" lon="5.001"/></g:trkseg></g:trk>', '<g:trk><g:name>q</g:name><g:trkseg><g:trkpt lat="6" lon="5"/><g:trkpt lat="6" lon="5.001"/></g:trkseg></g:trk>'))
    (inbox / "e.tcx").write_text(TCX.format(ns=' xmlns="http://www.garmin.com/xmlschemas/TrainingCenterDatabase/v2"', points=TCX_POINT.format(t="t1", a=7, b=7) + "<Trackpoint><Time>t2</Time></Trackpoint>" + TCX_POINT.format(t="t3", a=7, b="7.001")))
    (inbox / "f.tcx").write_text("<TrainingCenterDatabase/>")
    (inbox / "g.kml").write_text("<kml/>")
    (inbox / "sub").mkdir()
    (inbox / "sub" / "h 1+.FIT").write_bytes(b"fit 1")
    (inbox / "i.fit").write_bytes(b"fit 2")
    (inbox / "j.fit").write_bytes(b"fit 3")
    (inbox / "done" / "old.gpx").write_text(gpx_file(track("old", (9, 9), (9, 9.001))))
    return tmp_path


def test_scan(spark, folder):
    found = [unquote(r["path"].rsplit("/", 1)[1]) for r in files.scan_activity_files(spark, str(folder / "in")).collect()]
    assert found == ["a.gpx", "b.GPX", "c.gpx", "d.gpx", "e.tcx", "f.tcx", "i.fit", "j.fit", "h 1+.FIT"]


def statuses(log):
    return sorted((r["path"].rsplit("/", 1)[1], r["track_index"], r["filename"], r["status"]) for r in log.collect())


WANT = [
    ("a.gpx", 0, "a [R&R <sigh>].gpx", "imported"),
    ("a.gpx", 1, "a [second].gpx", "imported"),
    ("b.GPX", 0, "b [same ride].GPX", "content_duplicate"),
    ("c.gpx", 0, "c [one].gpx", "imported"),
    ("c.gpx", 1, "c [two].gpx", "imported"),
    ("c.gpx", 2, "c [cut].gpx", "imported"),
    ("d.gpx", 0, "d [p].gpx", "imported"),
    ("d.gpx", 1, "d [q].gpx", "imported"),
    ("e.tcx", None, "e.tcx", "imported"),
    ("f.tcx", None, "f.tcx", "error"),
    ("g.kml", None, "g.kml", "error"),
    ("h 1+.FIT", None, "h 1+.FIT", "imported"),
    ("i.fit", None, "i.fit", "no_gps_data"),
    ("j.fit", None, "j.fit", "error"),
]


def fit_records(spark):
    degree = 2**31 / 180
    rows = [("sub/h 1+.FIT", i, int(8 * degree), int((8 + i / 1000) * degree), 1_714_557_600 + i) for i in range(3)] + [("i.fit", 0, None, None, 1)]
    return spark.createDataFrame(rows, "file string, seq long, position_lat long, position_long long, ts long")


def test_import_job(spark, folder):
    store = str(folder / "store")
    log = importing.import_job(spark, str(folder / "in"), store, 0, fit_records(spark))
    key = lambda x: (x[0], -1 if x[1] is None else x[1])
    assert sorted(((unquote(r["path"].rsplit("/", 1)[1]), r["track_index"], r["filename"], r["status"]) for r in log.collect()), key=key) == WANT
    tracks_table = importing.stored(spark, store, "tracks")
    assert sorted(r["track_id"] for r in tracks_table.collect()) == list(range(1, 10))
    fit_track = tracks_table.where(F.col("filename") == "h 1+.FIT").first()
    assert (fit_track["num_points"], fit_track["start_time"], fit_track["end_time"]) == (3, "2024-05-01T10:00:00", "2024-05-01T10:00:02")
    assert {r["error"] for r in log.where(F.col("filename").rlike("fit$|kml$")).collect()} == {None, importing.NOT_DECODED, "Unsupported format: .kml"}
    assert importing.stored(spark, store, "trackpoints").count() == 19
    again = importing.import_job(spark, str(folder / "in"), store, 1, fit_records(spark))
    assert {r["status"] for r in again.collect()} == {"duplicate", "content_duplicate", "no_gps_data", "error"}
    assert importing.stored(spark, store, "tracks").count() == 9
    assert importing.import_job(spark, str(folder / "in"), store, 1).count() == 14


class Killed(Exception):
    pass


def readable(spark, store_dir):
    return {t: sorted(map(str, importing.stored(spark, store_dir, t).drop("imported_at").collect())) for t in importing.TABLES}


def test_a_job_killed_between_two_writes_changes_nothing(spark, folder, monkeypatch):
    """Whichever table was the last that it wrote, readers stay at the version before, and a new run of the batch gets through."""
    into, inbox = str(folder / "store"), str(folder / "in")
    importing.import_job(spark, inbox, into, 0, fit_records(spark))
    before = readable(spark, into)
    (folder / "in" / "z.gpx").write_text(gpx_file(track("again", (1, 1), (1, 1.001)), track("fresh", (11, 11), (11, 11.001))))
    real, steps = store.write, [importing.WORK, *importing.TABLES]
    for last in steps:
        def write(rows, path, table, *rest):
            found = real(rows, path, table, *rest)
            if table == last:
                raise Killed(table)
            return found

        monkeypatch.setattr(store, "write", write)
        with pytest.raises(Killed):
            importing.import_job(spark, inbox, into, 1, fit_records(spark))
        assert readable(spark, into) == before
    monkeypatch.setattr(store, "write", real)
    importing.import_job(spark, inbox, into, 1, fit_records(spark))
    after = readable(spark, into)
    assert len(after["tracks"]) == len(before["tracks"]) + 1 and len(after["log"]) == len(before["log"]) + 16
    assert store.vacuum(spark, into, steps) == sum(range(1, 7)) and readable(spark, into) == after


def test_a_writer_that_was_overtaken_starts_again(spark, folder, monkeypatch):
    """Another import of the same files commits between judging and committing: the tracks are stored once."""
    into, inbox, real, turns = str(folder / "store"), str(folder / "in"), store.commit, []

    def commit(*args):
        if not turns:
            turns.append(1)
            importing.import_job(spark, inbox, into, 7, fit_records(spark))
        real(*args)

    monkeypatch.setattr(store, "commit", commit)
    log = importing.import_job(spark, inbox, into, 8, fit_records(spark))
    assert "imported" not in {r["status"] for r in log.collect()}
    assert sorted(r["track_id"] for r in importing.stored(spark, into, "tracks").collect()) == list(range(1, 10))
    assert store.state(spark, into)[0] == 2
    with pytest.raises(store.Conflict):
        real(spark, into, 2, 9, "late")


TCX_CASES = {
    "plain": TCX.format(ns="", points="".join(TCX_POINT.format(t=f"t{i}", a=i, b=i + 0.5) for i in range(1, 9))),
    "laps": "<a><Activities><Activity><Lap><Track>{0}</Track><Track>{1}</Track></Lap><Lap/><Lap><Track/><Track>{2}</Track></Lap></Activity><Activity><Lap><Track>{0}</Track></Lap></Activity></Activities></a>".format(*[TCX_POINT.format(t="", a=i, b=i) for i in range(3)]),
    "prefixed": "<t:a xmlns:t='u'><t:Activities><t:Activity><t:Lap><t:Track>" + TCX_POINT.format(t="t", a=1, b=2).replace("</", "</t:").replace("<P", "<t:P").replace("<T", "<t:T").replace("<L", "<t:L") * 3 + "</t:Track></t:Lap></t:Activity></t:Activities></t:a>",
    "courses": "<a><Courses><Course><Track>" + TCX_POINT.format(t="t", a=1, b=2) + "</Track></Course></Courses></a>",
    "both": "<a><Activities><Activity><Lap><Track>{0}</Track></Lap></Activity></Activities><Courses><Course><Track>{1}</Track></Course></Courses></a>".format(TCX_POINT.format(t="t", a=1, b=2), TCX_POINT.format(t="u", a=3, b=4)),
    "sports": "<a><Activities><MultiSportSession><FirstSport><Activity><Lap><Track>" + TCX_POINT.format(t="t", a=1, b=2) + "</Track></Lap></Activity></FirstSport></MultiSportSession></Activities></a>",
    "outside": "<a><Activities><Activity><Track>{0}</Track><Lap><Note>{0}</Note><Track>{1}</Track></Lap></Activity></Activities></a>".format(TCX_POINT.format(t="t", a=1, b=2), TCX_POINT.format(t="u", a=3, b=4)),
    "no points": "<a><Activities><Activity><Lap><Track/></Lap></Activity></Activities></a>",
    "empty activity": "<a><Activities><Activity/></Activities></a>",
    "nothing": "<a/>",
    "cut": TCX.format(ns="", points=TCX_POINT.format(t="t", a=1, b=2) * 2)[:-30],
    "cut in a point": TCX.format(ns="", points=TCX_POINT.format(t="t", a=1, b=2) * 2)[:-130],
    "odd points": TCX.format(ns="", points="<Trackpoint/>" + TCX_POINT.format(t=" ", a="x", b=2) + TCX_POINT.format(t="t2", a=91, b=2) + "<Trackpoint ns3:a='1'><Time>t3</Time><Extensions><ns3:TPX><ns3:Speed>1</ns3:Speed></ns3:TPX></Extensions></Trackpoint>" + TCX_POINT.format(t="t4", a=" 5.5 ", b="-1e1")),
}


def test_tcx_in_splits(spark, tmp_path):
    """Points, times and errors of files in splits are those of files parsed as a whole."""
    for name, text in TCX_CASES.items():
        (tmp_path / f"{name}.tcx").write_text(text)
    (tmp_path / "zero.tcx").write_text("")
    (tmp_path / "done").mkdir()
    (tmp_path / "done" / "x.tcx").write_text(TCX_CASES["plain"])
    row = lambda r: (r["start_time"], r["end_time"], [tuple(p) for p in r["points"]], r["error"])
    read = lambda found: {unquote(r["path"].rsplit("/", 1)[1]): row(r) for r in found.collect()}
    whole = read(tcx.parsed_tcx(files.file_contents(spark, str(tmp_path), tcx.FILES).where("length(content) > 0")))
    assert len(whole) == len(TCX_CASES) and len(whole["plain.tcx"][2]) == 8 and len(whole["laps.tcx"][2]) == 4 and len(whole["odd points.tcx"][2]) == 1
    assert whole == read(tcx.split_tcx(spark, str(tmp_path)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    try:
        assert whole == read(tcx.split_tcx(spark, str(tmp_path)))
        assert tcx.split_tcx(spark, str(tmp_path), 1 << 30).isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_the_limit_changes_no_log(spark, folder):
    judged = lambda most: sorted((r["path"], r["track_index"], r["error"], tuple(map(tuple, r["points"]))) for r in importing.parsed_tracks(spark, str(folder / "in"), fit_records(spark), most).collect())
    order = lambda rows: [(p, -1 if i is None else i, e, x) for p, i, e, x in rows]
    assert order(judged(10)) == order(judged(1 << 30))


def test_the_order_of_records_counts(spark, tmp_path):
    one, two = track("a", (1, 1), (1, 2)), track("b", (2, 2), (2, 3))
    for name, parts in (("x", (one, two)), ("y", (two, one)), ("z", (one, two))):
        (tmp_path / f"{name}.gpx").write_text("<gpx>" + "".join(parts) + "</gpx>")
    found = {r["path"][-5]: r["file_hash"] for r in files.file_hashes(spark, str(tmp_path), 10).collect()}
    assert found["x"] == found["z"] != found["y"]


def test_hashes_of_large_files(spark, folder):
    """Above the limit the hash comes from records in splits, and does not depend on them."""
    inbox = str(folder / "in")
    hashes = lambda most: {r["path"]: r["file_hash"] for r in files.file_hashes(spark, inbox, most).collect()}
    whole, parts = hashes(1 << 30), hashes(100)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        again = hashes(100)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert whole.keys() == parts.keys() and parts == again
    assert {p.rsplit(".")[-1] for p in whole if whole[p] == parts[p]} == {"tcx", "kml", "fit", "FIT"} and len(set(parts.values())) == len(parts)
    for path, found in whole.items():
        if not path.endswith("kml"):
            assert found == hashlib.sha256(open(unquote(path.removeprefix("file:")), "rb").read()).hexdigest()


def test_many_tracks_over_small_splits(spark, tmp_path):
    (tmp_path / "big.gpx").write_text(gpx_file(*[track(f"t{i}", (i / 10, 1), (i / 10, 1.001)) for i in range(40)]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        found = gpx.parsed_gpx(gpx.read_gpx_tracks(spark, str(tmp_path))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["track_name"] for r in sorted(found, key=lambda r: r["track_index"])] == [f"t{i}" for i in range(40)]


def test_other_closers(spark, tmp_path):
    (tmp_path / "p.gpx").write_text(gpx_file(track("x", (1, 1), (1, 2))).replace("</trk>", "</TRK >"))
    assert [r["track_name"] for r in gpx.parsed_gpx(gpx.read_gpx_tracks(spark, str(tmp_path))).collect()] == ["x"]


@pytest.mark.parametrize("file_first", [True, False])
def test_stream_of_fit_files(spark, folder, file_first):
    """A file and its records meet, whichever comes first; a restart imports nothing again."""
    inbox, into, decoded = folder / "in", str(folder / "store"), folder / "decoded"
    decoded.mkdir()
    if not file_first:
        for path in ("i.fit", "sub/h 1+.FIT"):
            (inbox / path).rename(folder / path.replace("/", "-"))

    def run():
        imports.stream_fit(spark, str(inbox), str(decoded), into, str(folder / "c")).awaitTermination(120)
        return sorted((r["filename"], r["status"], r["num_points"]) for r in importing.stored(spark, into, "log").collect())

    if file_first:
        assert run() == []
    fit_records(spark).coalesce(1).write.mode("append").parquet(str(decoded))
    if not file_first:
        assert run() == []
        for path in ("i.fit", "sub/h 1+.FIT"):
            (folder / path.replace("/", "-")).rename(inbox / path)
    want = [("h 1+.FIT", "imported", 3), ("i.fit", "no_gps_data", 0)]  # j.fit waits
    assert run() == want and run() == want
    fit_records(spark).coalesce(1).write.mode("append").parquet(str(decoded))
    assert run() == want
    place = sorted((r["seq"], r["lat"], round(r["lon"], 3)) for r in importing.stored(spark, into, "trackpoints").collect())
    assert place == [(1, pytest.approx(8), 8.0), (2, pytest.approx(8), 8.001), (3, pytest.approx(8), 8.002)]


def test_stream_equals_job(spark, folder):
    """A stream over large files (in splits), odd names and other formats logs what the job logs; FIT files are left to their own."""
    inbox = folder / "in"
    (inbox / "w [1] {2}*?+%41.gpx").write_text(gpx_file(track("odd", (12, 12), (12, 12.001))))
    imports.stream_import(spark, str(inbox), str(folder / "s1"), str(folder / "c"), fit_apart=True, most_bytes=100).awaitTermination(120)
    importing.import_job(spark, str(inbox), str(folder / "s2"), 0, fit_records(spark))
    streamed, job = (statuses(importing.stored(spark, str(folder / s), "log")) for s in ("s1", "s2"))
    assert streamed == [r for r in job if not r[0].lower().endswith(".fit")] and any("odd" in r[2] for r in streamed)


def test_streams(spark, folder):
    inbox, store, out = folder / "in", str(folder / "store"), folder / "out"
    run = lambda f, *a: f(spark, *a).awaitTermination(120)
    run(imports.stream_import, str(inbox), store, str(folder / "c1"))
    (inbox / "z.gpx").write_text(gpx_file(track("again", (1, 1), (1, 1.001)), track("fresh", (11, 11), (11, 11.001))))
    run(imports.stream_import, str(inbox), store, str(folder / "c1"))
    log = importing.stored(spark, store, "log")
    assert {r["status"]: r["count"] for r in log.groupBy("status").count().collect()}["imported"] == 9  # done/old.gpx is left out
    run(imports.stream_dirty_tiles, store, str(out / "dirty"), str(folder / "c2"))
    points = importing.stored(spark, store, "trackpoints").drop("batch_id")
    key = ["z", "x", "y"]
    dirty = spark.read.parquet(str(out / "dirty")).select(*key).distinct()
    assert dirty.exceptAll(tiles.data_tiles(points)).count() == 0 and dirty.count() == tiles.data_tiles(points).count()
    run(imports.stream_render, store, str(out / "dirty"), str(out / "tiles"), str(folder / "c3"), 13, 14, None, 12)
    assert len(list((out / "tiles").glob("batch_id=0/round=*"))) > 1
    drawn = imports.latest_tiles(spark, str(out / "tiles")).select("style", *key)
    whole = render.render_tiles(points, tiles.data_tiles(points, 13, 14), 13, 14).select("style", *key)
    assert drawn.exceptAll(whole).count() == 0 and whole.exceptAll(drawn).count() == 0


def test_rounds(spark):
    """Heavy tiles are alone in their rounds, light rounds are below twice the bound, and every tile has a round."""
    rng = random.Random(3)
    rows = [(t, s, 10 + t * 0.7 + rng.random() / 500, 20 + rng.random() / 500) for t in range(12) for s in range(1, 2 + 3 ** (t % 6))]
    p = spark.createDataFrame(rows, "track_id long, seq long, lat double, lon double")
    wanted = tiles.data_tiles(p, 8, 13)
    off = spark.createDataFrame([(8, 0, 0)], wanted.schema)
    found = imports.rounds(p, wanted.unionByName(wanted).unionByName(off), 8, 13, 100).collect()
    want = {(r["z"], r["x"], r["y"]): r["points"] for r in tiles.tile_density(p).where("z BETWEEN 8 AND 13").collect()} | {(8, 0, 0): 0}
    assert len(found) == len(want) and {(r["z"], r["x"], r["y"]): r["points"] for r in found} == want
    together = {}
    for r in found:
        together.setdefault(r["round"], []).append(r["points"])
    assert any(max(t) >= 100 for t in together.values()) and any(len(t) > 1 for t in together.values())
    for costs in together.values():
        assert len(costs) == 1 if max(costs) >= 100 else sum(costs) < 200
    heaviest = [max(together[t]) for t in sorted(together)]
    assert heaviest == sorted(heaviest, reverse=True)


def test_incremental_equals_full(spark):
    rows = [(t, s, 46.5 + 0.0005 * s, -87.5 + 0.0004 * t * s) for t in range(1, 5) for s in range(1, 20)]
    p = spark.createDataFrame(rows, "track_id long, seq long, lat double, lon double")
    old, dirty = p.where("track_id < 4"), tiles.data_tiles(p.where("track_id = 4"), 12, 13)
    whole = render.render_tiles(p, tiles.data_tiles(p, 12, 13), 12, 13).select("style", "z", "x", "y")
    kept = render.render_tiles(old, tiles.data_tiles(old, 12, 13), 12, 13).select("style", "z", "x", "y")
    after = rendering.incremental(p, kept, dirty, 12, 13).drop("state")
    assert after.exceptAll(whole).count() == 0 and whole.exceptAll(after).count() == 0
    assert maintenance.missing_tiles(p.limit(0), after).count() == 0


def test_tile_files(spark, tmp_path):
    for name in ("warm/3/1/2.png", "warm/3/x/2.png", "cool/4/5/6.png"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    assert sorted(map(tuple, files.list_tiles_on_disk(spark, str(tmp_path)).collect())) == [("cool", 4, 5, 6), ("warm", 3, 1, 2)]
