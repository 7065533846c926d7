"""Files that no task should hold as one value."""

import hashlib
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from heatloom.schemas import TRACKPOINTS
from heatloom.sources import events, files, gpx


@pytest.fixture
def splits(spark, monkeypatch):
    """Every file is large, and read in splits of 400 bytes."""
    monkeypatch.setattr(files, "WHOLE_BYTES", 100)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "400b")
    yield
    spark.conf.set(key, before)


def track(n, prefix="", closer="</{}trk>"):
    points = "".join(f'<{prefix}trkpt lat="46.{i:03d}" lon="-87.5"/>' for i in range(n, n + 20))
    return f"<{prefix}trk><{prefix}name>t{n}</{prefix}name><{prefix}trkseg>{points}</{prefix}trkseg>{closer.format(prefix)}"


def test_hashes_in_pieces_are_those_of_the_bytes(spark, tmp_path, splits):
    text = ("<gpx>\n" + "\r\n".join(track(n, "g:") for n in range(5)) + "</gpx>").encode()
    found = {"a.gpx": text, "b 1%.GPX": text + b"\n", "c.gpx": b"\xef\xbb\xbf" + text, "d.tcx": b"\xef\xbb\xbf" + text + b"\n\n", "e.fit": bytes(range(256)) * 9, "f.fit": b"\xff" * 1000, "g.fit": b">" * 700, "h.gpx": b"short"}
    for name, data in found.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "done").mkdir()
    (tmp_path / "done" / "x.gpx").write_bytes(text)
    hashes = {unquote(r["path"].rsplit("/", 1)[1]): r["file_hash"] for r in files.file_hashes(spark, str(tmp_path)).collect()}
    assert hashes == {name: hashlib.sha256(data).hexdigest() for name, data in found.items()}


def test_large_gpx_is_split_at_its_own_closers(spark, tmp_path, monkeypatch, splits):
    """Prefixed, capital and mixed closers: tracks and their order are the same, and no piece holds a file."""
    texts = {
        "plain.gpx": [track(n) for n in range(6)], "pre fixed[1].gpx": [track(n, "g:") for n in range(6)], "spaced.GPX": [track(n, closer="</{}trk >") for n in range(6)],
        "mixed.gpx": [track(n, "g:" if n % 3 else "") for n in range(9)], "capital.gpx": [track(n).replace("trk>", "TRK>") for n in range(6)], "none.gpx": ["<gpx>" + " " * 300],
    }
    for name, parts in texts.items():
        (tmp_path / name).write_text("<gpx>" + "".join(parts) + "</gpx>")
    read = lambda: [(unquote(r["path"]).rsplit("/", 1)[1], r["xml"]) for r in gpx.read_gpx_tracks(spark, str(tmp_path)).orderBy("path", "chunk").collect()]
    large = read()
    closers = dict(gpx._closers(spark, str(tmp_path)))
    assert {"</trk>", "</g:trk>", "</trk >"} <= set(closers) and len(closers["</g:trk>"]) == 2
    monkeypatch.setattr(files, "WHOLE_BYTES", 1 << 30)
    assert large == read() and len(large) >= 27


def test_activity_files_are_written_line_by_line(spark):
    """Their bytes, and that no row of the job has more than a track."""
    rows = [(t, s, 46.5 + s / 1000, -87.5) for t in range(1, 41) for s in range(1, 4)]
    points = spark.createDataFrame(rows, TRACKPOINTS)
    folder, _ = events.activity_files(points, "gpx", "prefixed", "tcx", "fit")
    read = spark.read.format("binaryFile").load(f"{folder}/*.*").collect()
    found = {r["path"].rsplit("/", 1)[1]: bytes(r["content"]).decode() for r in read}
    spots = "".join(f'<trkpt lat="{46.5 + s / 1000:.6f}" lon="-87.500000"/>' for s in range(1, 4))
    ride = lambda t: f"<trk><name>ride {t}</name><trkseg>{spots}</trkseg></trk>"
    assert found["gpx-1.gpx"] == "<gpx>\n" + ride(4) + "\n" + ride(36) + "\n</gpx>\n"
    assert found["prefixed-0.gpx"] == ("<gpx>\n" + ride(1) + "\n" + ride(33) + "\n</gpx>\n").replace("<", "<g:").replace("<g:/", "</g:").replace("<g:gpx", "<gpx").replace("</g:gpx", "</gpx")
    assert found["fit-2.fit"] == "fit-2\n" and len(found) == 32
    lines = spark.read.text(f"{folder}/tcx-0.tcx").collect()
    assert len(lines) == 2 + len([t for t in range(1, 41) if t % 4 == 2 and t // 4 % 8 == 0])
