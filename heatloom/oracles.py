"""SQL for DuckDB that gives the same rows as the queries of the catalog."""

from __future__ import annotations

STYLES = "(VALUES ('cool'), ('top10'), ('warm')) AS st(style)"

POINTS = """
e AS (
  SELECT user_id + 1 AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
         (event_id * 7919) % 2001 - 1000 + CASE WHEN event_id % 97 = 0 THEN 20000 ELSE 0 END AS dy, (event_id * 104729) % 2001 - 1000 AS dx
  FROM events),
c AS (
  SELECT track_id, seq,
         46500000 + ((track_id * 37) % 20) * 2000 + sum(dy) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
         -87500000 + ((track_id * 53) % 20) * 2000 + sum(dx) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b
  FROM e),
tp AS (SELECT track_id, seq, CAST(a AS DOUBLE) / 1e6 AS lat, CAST(b AS DOUBLE) / 1e6 AS lon FROM c)"""

MX = "(({lon} + 180.0) / 360.0)"
MY = "((1.0 - ln(tan(radians(least(greatest({lat}, -85.06), 85.06))) + 1.0 / cos(radians(least(greatest({lat}, -85.06), 85.06)))) / pi()) / 2.0)"


def tx(lon: str, z: str) -> str:
    return f"CAST(least(greatest(floor({MX.format(lon=lon)} * pow(2.0, {z})), 0), pow(2.0, {z}) - 1) AS BIGINT)"


def ty(lat: str, z: str) -> str:
    return f"CAST(least(greatest(floor({MY.format(lat=lat)} * pow(2.0, {z})), 0), pow(2.0, {z}) - 1) AS BIGINT)"


def north(y: str, z: str) -> str:
    return f"degrees(atan(sinh(pi() * (1 - 2 * ({y}) / pow(2.0, {z})))))"


def west(x: str, z: str) -> str:
    return f"(({x}) / pow(2.0, {z}) * 360.0 - 180.0)"


ZOOMS = "zs AS (SELECT CAST(unnest(range(2, 19)) AS INT) AS z)"
TILES = f"{ZOOMS}, dt AS (SELECT DISTINCT z, {tx('lon', 'z')} AS x, {ty('lat', 'z')} AS y FROM tp, zs)"
DIRTY = f"dirty AS (SELECT DISTINCT z, {tx('lon', 'z')} AS x, {ty('lat', 'z')} AS y FROM tp, zs WHERE track_id > (SELECT max(track_id) FROM tp) * 0.9)"
DISK = f"disk AS (SELECT style, z, x, y FROM dt, {STYLES} WHERE NOT ((style = 'warm' AND (x + y) % 7 = 0) OR (style = 'cool' AND (x * y) % 11 = 0)))"
MISSING = f"missing AS (SELECT style, z, x, y FROM dt, {STYLES} EXCEPT SELECT style, z, x, y FROM disk)"
SEGMENTS = """sg AS (SELECT * FROM (
  SELECT track_id, seq, lat AS lat0, lon AS lon0, lead(lat) OVER w AS lat1, lead(lon) OVER w AS lon1 FROM tp WINDOW w AS (PARTITION BY track_id ORDER BY seq)) WHERE lat1 IS NOT NULL),
km AS (SELECT *, 6371.0 * sqrt(pow(radians(lat1 - lat0), 2) + pow(radians(lon1 - lon0) * cos(radians((lat0 + lat1) / 2)), 2)) AS km FROM sg),
near AS (SELECT * FROM km WHERE km <= 1.0)"""
TRACKS = """b AS (SELECT track_id, count(*) AS num_points, min(lat) AS min_lat, min(lon) AS min_lon, max(lat) AS max_lat, max(lon) AS max_lon FROM tp GROUP BY track_id),
h AS (SELECT track_id, sha256(string_agg(printf('%.6f,%.6f', lat, lon) || chr(10), '' ORDER BY seq)) AS content_hash FROM tp GROUP BY track_id),
tm AS (SELECT user_id + 1 AS track_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS s, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS f FROM events GROUP BY user_id),
tr AS (SELECT b.*, content_hash, CASE WHEN track_id % 10 <> 0 THEN s END AS start_time, CASE WHEN track_id % 10 <> 0 THEN f END AS end_time,
  sha256(CAST((track_id - track_id % 3) // 3 AS VARCHAR)) || CASE WHEN track_id % 3 <> 0 THEN ':track' || (track_id % 3) ELSE '' END AS file_hash,
  'ride ' || track_id || ' [name].gpx' AS filename
  FROM b JOIN h USING (track_id) JOIN tm USING (track_id))"""
BATCH = """half AS (SELECT max(track_id) // 2 AS m FROM tr),
stored AS (SELECT tr.* FROM tr, half WHERE track_id <= m), new AS (SELECT tr.* FROM tr, half WHERE track_id > m),
batch AS (
  SELECT track_id, printf('a/%06d.gpx', track_id) AS path, file_hash AS effective_hash, content_hash, num_points, CAST(NULL AS VARCHAR) AS error FROM stored WHERE track_id % 5 = 0
  UNION ALL SELECT track_id, printf('b/%06d.gpx', track_id), 'new-' || track_id, content_hash, num_points, NULL FROM stored WHERE track_id % 7 = 0
  UNION ALL SELECT track_id, printf('c/%06d.gpx', track_id), file_hash, content_hash, CASE WHEN track_id % 13 = 0 THEN 0 ELSE num_points END, CASE WHEN track_id % 17 = 0 THEN 'not well-formed' END FROM new
  UNION ALL SELECT track_id, printf('d/%06d.gpx', track_id), 'new-' || track_id, content_hash, CASE WHEN track_id % 13 = 0 THEN 0 ELSE num_points END, CASE WHEN track_id % 17 = 0 THEN 'not well-formed' END FROM new WHERE track_id % 11 = 0),
win AS (SELECT content_hash, min(path) AS won FROM batch
  WHERE error IS NULL AND num_points > 0 AND effective_hash NOT IN (SELECT file_hash FROM stored) AND content_hash NOT IN (SELECT content_hash FROM stored) GROUP BY content_hash),
wh AS (SELECT b.effective_hash, min(b.path) AS first_won FROM batch b JOIN win ON b.path = win.won GROUP BY b.effective_hash),
log AS (SELECT b.*, CASE
    WHEN b.effective_hash IN (SELECT file_hash FROM stored) OR wh.first_won < b.path THEN 'duplicate'
    WHEN error IS NOT NULL THEN 'error' WHEN num_points <= 0 THEN 'no_gps_data'
    WHEN b.content_hash IN (SELECT content_hash FROM stored) THEN 'content_duplicate'
    WHEN win.won = b.path THEN 'imported' ELSE 'content_duplicate' END AS status
  FROM batch b LEFT JOIN win ON win.content_hash = b.content_hash LEFT JOIN wh ON wh.effective_hash = b.effective_hash)"""
# Colour ramps of the three styles, in stretches from (t0, r0, g0, b0) to (t1, r1, g1, b1).
RAMPS = """ramp(style, part, t0, r0, g0, b0, t1, r1, g1, b1) AS (VALUES
  ('warm',0,0.0,0,0,0,0.05,40,5,0),('warm',1,0.05,40,5,0,0.15,80,15,0),('warm',2,0.15,80,15,0,0.3,160,30,0),('warm',3,0.3,160,30,0,0.5,220,70,5),('warm',4,0.5,220,70,5,0.75,255,120,20),('warm',5,0.75,255,120,20,1.0,200,60,5),
  ('cool',0,0.0,0,0,0,0.05,0,5,40),('cool',1,0.05,0,5,40,0.15,0,15,80),('cool',2,0.15,0,15,80,0.3,0,40,160),('cool',3,0.3,0,40,160,0.5,10,80,220),('cool',4,0.5,10,80,220,0.75,30,140,255),('cool',5,0.75,30,140,255,1.0,10,60,200),
  ('top10',0,0.0,0,0,0,0.89,0,0,0),('top10',1,0.89,0,0,0,0.90,0,200,80),('top10',2,0.90,0,200,80,0.95,0,255,136),('top10',3,0.95,0,255,136,1.0,68,255,170)),
steps AS (SELECT CAST(unnest(range(0, 256)) AS INT) AS idx),
hit AS (SELECT *, row_number() OVER (PARTITION BY style, idx ORDER BY part) AS n FROM (SELECT idx, idx / CAST(255 AS DOUBLE) AS t FROM steps) JOIN
  (SELECT style, part, CAST(t0 AS DOUBLE) AS t0, CAST(t1 AS DOUBLE) AS t1, CAST(r0 AS DOUBLE) AS r0, CAST(g0 AS DOUBLE) AS g0, CAST(b0 AS DOUBLE) AS b0, CAST(r1 AS DOUBLE) AS r1, CAST(g1 AS DOUBLE) AS g1, CAST(b1 AS DOUBLE) AS b1 FROM ramp) ON t BETWEEN t0 AND t1),
shade AS (SELECT style, idx, t, CASE WHEN idx = 0 THEN 0 ELSE CAST(trunc(r0 + (r1 - r0) * ((t - t0) / (t1 - t0))) AS INT) END AS r,
  CASE WHEN idx = 0 THEN 0 ELSE CAST(trunc(g0 + (g1 - g0) * ((t - t0) / (t1 - t0))) AS INT) END AS g, CASE WHEN idx = 0 THEN 0 ELSE CAST(trunc(b0 + (b1 - b0) * ((t - t0) / (t1 - t0))) AS INT) END AS b FROM hit WHERE n = 1),
lut AS (SELECT style, idx, r, g, b, CASE WHEN idx = 0 OR (r = 0 AND g = 0 AND b = 0) THEN 0 ELSE CAST(trunc(least(255.0, t * 3 * 255)) AS INT) END AS a FROM shade)"""


def q(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


def pixels(z: int, width: int) -> str:
    x = lambda c: f"{MX.format(lon=c)} * pow(2.0, {z}) * 256"
    y = lambda c: f"{MY.format(lat=c)} * pow(2.0, {z}) * 256"
    return f"""g AS (SELECT track_id, {x('lon0')} AS x0, {y('lat0')} AS y0, {x('lon1')} AS x1, {y('lat1')} AS y1 FROM near),
n AS (SELECT *, CAST(greatest(1, ceil(greatest(abs(x1 - x0), abs(y1 - y0)))) AS BIGINT) AS n, abs(x1 - x0) >= abs(y1 - y0) AS flat FROM g),
s AS (SELECT *, unnest(range(0, n + 1)) AS i FROM n),
w AS (SELECT track_id, CAST(floor(x0 + (x1 - x0) * i / n) AS BIGINT) AS px, CAST(floor(y0 + (y1 - y0) * i / n) AS BIGINT) AS py, flat, unnest(range({-((width - 1) // 2)}, {width // 2 + 1})) AS o FROM s),
pix AS (SELECT {z} AS z, px + CASE WHEN flat THEN 0 ELSE o END AS px, py + CASE WHEN flat THEN o ELSE 0 END AS py, count(DISTINCT track_id) AS tracks FROM w GROUP BY ALL),
ix AS (SELECT *, CAST(trunc(least(ln(1 + tracks) / ln(1 + {5 if z <= 8 else 15 if z <= 11 else 10}), 1.0) * 255) AS INT) AS idx FROM pix)"""


def hits(first: int, last: int) -> str:
    box = f"""lon BETWEEN {west('x', 'z')} - 360.0 / pow(2.0, z) * 0.1 AND {west('x + 1', 'z')} + 360.0 / pow(2.0, z) * 0.1
    AND lat BETWEEN {north('y + 1', 'z')} - ({north('y', 'z')} - {north('y + 1', 'z')}) * 0.1 AND {north('y', 'z')} + ({north('y', 'z')} - {north('y + 1', 'z')}) * 0.1"""
    return f"""hz AS (SELECT CAST(unnest(range({first}, {last + 1})) AS INT) AS z), d3(d) AS (VALUES (-1), (0), (1)),
near9 AS (SELECT z, track_id, seq, lat, lon, {tx('lon', 'z')} + a.d AS x, {ty('lat', 'z')} + b.d AS y FROM tp, hz, d3 a, d3 b),
hits AS (SELECT z, x, y, track_id, CAST(min(seq) AS BIGINT) AS first_seq, CAST(max(seq) AS BIGINT) AS last_seq FROM near9
  WHERE x >= 0 AND y >= 0 AND x < pow(2.0, z) AND y < pow(2.0, z) AND {box} GROUP BY ALL)"""


def drawn(wanted: str = "dt") -> str:
    """Segments in each wanted tile (z, x, y)."""
    gx = lambda c: f"{MX.format(lon=c)} * pow(2.0, c.z) * 256"
    gy = lambda c: f"{MY.format(lat=c)} * pow(2.0, c.z) * 256"
    most = "CASE WHEN z <= 4 THEN 500 WHEN z <= 8 THEN 2000 ELSE 10000 END"
    return f"""capped AS (SELECT * FROM (SELECT h.*, row_number() OVER (PARTITION BY h.z, h.x, h.y ORDER BY track_id) AS n FROM hits h JOIN {wanted} USING (z, x, y)) WHERE n <= {most}),
ts AS (SELECT c.z, c.x, c.y, c.track_id, k.seq, lat0, lon0, lat1, lon1 FROM capped c JOIN near k ON k.track_id = c.track_id AND k.seq BETWEEN c.first_seq - 1 AND c.last_seq
  WHERE c.x BETWEEN floor((least({gx('lon0')}, {gx('lon1')}) - 128) / 256) AND floor((greatest({gx('lon0')}, {gx('lon1')}) + 128) / 256)
    AND c.y BETWEEN floor((least({gy('lat0')}, {gy('lat1')}) - 128) / 256) AND floor((greatest({gy('lat0')}, {gy('lat1')}) + 128) / 256))"""


def images(wanted: str = "dt", least: int = 2) -> str:
    """im: z, x, y, tracks of tiles in which a pixel is drawn; sums: of the visible pixels of each style, from zoom `least`."""
    gx = lambda c: f"{MX.format(lon=c)} * pow(2.0, z) * 256"
    gy = lambda c: f"{MY.format(lat=c)} * pow(2.0, z) * 256"
    return f"""{drawn(wanted)},
g AS (SELECT z, x, y, track_id, {gx('lon0')} AS x0, {gy('lat0')} AS y0, {gx('lon1')} AS x1, {gy('lat1')} AS y1, CASE WHEN z <= 8 THEN 1 WHEN z <= 11 THEN 2 WHEN z <= 13 THEN 3 ELSE 4 END AS width FROM ts),
n AS (SELECT *, CAST(greatest(1, ceil(greatest(abs(x1 - x0), abs(y1 - y0)))) AS BIGINT) AS n, abs(x1 - x0) >= abs(y1 - y0) AS flat FROM g),
s AS (SELECT *, unnest(range(0, n + 1)) AS i FROM n),
w AS (SELECT DISTINCT z, x, y, track_id, CAST(floor(x0 + (x1 - x0) * i / n) AS BIGINT) AS px, CAST(floor(y0 + (y1 - y0) * i / n) AS BIGINT) AS py, flat, width FROM s),
o AS (SELECT *, unnest(range(-((width - 1) // 2), width // 2 + 1)) AS o FROM w),
pix AS (SELECT z, x, y, px + CASE WHEN flat THEN 0 ELSE o END AS px, py + CASE WHEN flat THEN o ELSE 0 END AS py, count(DISTINCT track_id) AS tracks FROM o GROUP BY ALL),
inside AS (SELECT * FROM pix WHERE px // 256 = x AND py // 256 = y),
ix AS (SELECT *, CAST(trunc(least(ln(1 + tracks) / ln(1 + CASE WHEN z <= 8 THEN 5 WHEN z <= 11 THEN 15 WHEN z <= 14 THEN 10 ELSE 5 END), 1.0) * 255) AS INT) AS idx FROM inside),
im AS (SELECT z, x, y, tracks FROM (SELECT DISTINCT z, x, y FROM inside) JOIN (SELECT z, x, y, count(DISTINCT track_id) AS tracks FROM ts GROUP BY ALL) USING (z, x, y)),
{RAMPS},
sums AS (SELECT style, z, x, y, count(*) AS shown, CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b, CAST(sum(a) AS BIGINT) AS a FROM ix JOIN lut USING (idx) WHERE a > 0 AND z >= {least} GROUP BY ALL)"""


def files(*formats: str) -> str:
    """f: track_id, kind and file of the activity files made of the points; gx: the tracks of GPX files; wx: the others."""
    kinds = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(formats))
    n = len(formats)
    return f"""k AS (SELECT DISTINCT track_id, CASE track_id % {n} {kinds} END AS kind, (track_id // {n}) % 8 AS part FROM tp),
f AS (SELECT track_id, kind, kind || '-' || part || '.' || CASE kind WHEN 'prefixed' THEN 'gpx' ELSE kind END AS file FROM k),
fh AS (SELECT track_id, count(*) AS num_points, sha256(string_agg(printf('%.6f,%.6f', lat, lon) || chr(10), '' ORDER BY seq)) AS content_hash FROM tp GROUP BY track_id),
gx AS (SELECT file, track_id, num_points, content_hash, 'ride ' || track_id AS track_name, CAST(row_number() OVER (PARTITION BY file ORDER BY track_id) - 1 AS INT) AS track_index FROM f JOIN fh USING (track_id) WHERE kind IN ('gpx', 'prefixed')),
wx AS (SELECT file, any_value(kind) AS kind, count(*) AS num_points, sha256(string_agg(printf('%.6f,%.6f', lat, lon) || chr(10), '' ORDER BY track_id, seq)) AS content_hash FROM f JOIN tp USING (track_id) WHERE kind IN ('tcx', 'fit') GROUP BY file)"""


ALL_FORMATS = ("gpx", "prefixed", "tcx", "fit")
TILE_ID = """hil AS (
  SELECT z, x, y, z - 1 AS k, CAST(0 AS BIGINT) AS d, x AS cx, y AS cy FROM dt
  UNION ALL
  SELECT z, x, y, k - 1, d + s * s * xor(3 * rx, ry),
         CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN s - 1 - ly ELSE ly END ELSE lx END, CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN s - 1 - lx ELSE lx END ELSE ly END
  FROM (SELECT *, CAST(1 AS BIGINT) << k AS s, (cx >> k) & 1 AS rx, (cy >> k) & 1 AS ry, cx & ((CAST(1 AS BIGINT) << k) - 1) AS lx, cy & ((CAST(1 AS BIGINT) << k) - 1) AS ly FROM hil WHERE k >= 0)),
ids AS (SELECT z, x, y, CAST((pow(4, z) - 1) / 3 AS BIGINT) + d AS tile_id FROM hil WHERE k = -1)"""
#: Short images of all tiles, with the offset of each style's first tile that has the image; a byte lies between two images.
PLACED = f"""im2 AS (SELECT style, tile_id, 'image ' || style || ' ' || repeat(CAST(((x >> 1) + (y >> 1)) % 5 AS VARCHAR), CAST(x % 4 AS INT)) AS data FROM ids, {STYLES}),
fi AS (SELECT style, data, min(tile_id) AS first FROM im2 GROUP BY style, data),
fo AS (SELECT style, data, CAST(coalesce(sum(length(data) + 1) OVER (PARTITION BY style ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM fi),
placed AS (SELECT style, tile_id, "offset", length(data) AS length, data FROM im2 JOIN fo USING (style, data))"""
BLOBS = "blobs AS (SELECT *, x % 97 * 13 + y % 89 * 7 + 67 AS length FROM ids)"
REQUESTS = """req AS (SELECT CASE WHEN (x + y) % 5 = 1 THEN 'neon' ELSE 'warm' END AS style, CASE WHEN (x + y) % 5 = 2 THEN -1 WHEN (x + y) % 5 = 3 AND x % 2 = 0 THEN 21 ELSE z END AS z,
  CASE WHEN (x + y) % 5 = 4 THEN CAST(pow(2, z) AS BIGINT) ELSE x END AS x, y FROM dt)"""
RECORDS = """rec AS (SELECT printf('ride-%06d.fit', track_id) AS file, seq,
  CASE WHEN seq % 19 <> 0 THEN CAST(round((CASE WHEN seq % 23 = 0 THEN lat + 60 ELSE lat END) * (2147483648.0 / 180.0)) AS BIGINT) END AS position_lat,
  CAST(round(lon * (2147483648.0 / 180.0)) AS BIGINT) AS position_long, CASE WHEN seq % 7 <> 0 THEN 1700000000 + track_id * 1000 + seq END AS ts FROM tp),
fp AS (SELECT file, seq, position_lat * (180.0 / 2147483648.0) AS lat, position_long * (180.0 / 2147483648.0) AS lon, ts FROM rec
  WHERE position_lat IS NOT NULL AND position_long IS NOT NULL AND position_lat * (180.0 / 2147483648.0) BETWEEN -90 AND 90 AND position_long * (180.0 / 2147483648.0) BETWEEN -180 AND 180)"""

LAST = "(SELECT max(track_id) FROM tp) * 0.9"


def oracle_sql() -> dict[str, str]:
    p, t = POINTS, TILES
    box = lambda pad: ", ".join(
        f"round({e}, 6) AS {n}"
        for n, e in (
            ("min_lat", f"{north('y + 1', 'z')} - ({north('y', 'z')} - {north('y + 1', 'z')}) * {pad}"),
            ("max_lat", f"{north('y', 'z')} + ({north('y', 'z')} - {north('y + 1', 'z')}) * {pad}"),
            ("min_lon", f"{west('x', 'z')} - 360.0 / pow(2.0, z) * {pad}"),
            ("max_lon", f"{west('x + 1', 'z')} + 360.0 / pow(2.0, z) * {pad}"),
        )
    )
    log = (p, TRACKS, BATCH)
    stay = p.replace("FROM c)", "FROM c WHERE track_id % 20 <> 13)")
    in_tile = "SELECT z, x, y, im.tracks, count(*) AS pixels, CAST(sum(inside.tracks) AS BIGINT) AS total, max(inside.tracks) AS largest FROM inside JOIN im USING (z, x, y) GROUP BY ALL"
    found = {
        "data_tiles": q(p, t, "SELECT * FROM dt"),
        "tile_density": q(p, ZOOMS, f"SELECT z, {tx('lon', 'z')} AS x, {ty('lat', 'z')} AS y, count(*) AS points, count(DISTINCT track_id) AS tracks FROM tp, zs GROUP BY ALL"),
        "lonlat_to_tile": q(p, f"SELECT track_id, seq, {tx('lon', '14')} AS x, {ty('lat', '14')} AS y FROM tp"),
        "zoom_explode": q(p, ZOOMS, "d AS (SELECT DISTINCT " + tx("lon", "18") + " AS x, " + ty("lat", "18") + " AS y FROM tp)", "SELECT z, x >> (18 - z) AS x, y >> (18 - z) AS y FROM d, zs"),
        "tile_bounds": q(p, t, f"SELECT z, x, y, {box(0.0)} FROM dt"),
        "tile_bounds_padded": q(p, t, f"SELECT z, x, y, {box(0.1)} FROM dt"),
        "lonlat_to_pixel": q(p, f"SELECT track_id, seq, round({MX.format(lon='lon')} * 16384 * 256 - {tx('lon', '14')} * 256, 4) AS px, round({MY.format(lat='lat')} * 16384 * 256 - {ty('lat', '14')} * 256, 4) AS py FROM tp"),
        "track_tile_hits": q(p, hits(2, 18), "SELECT * FROM hits"),
        "track_bounds": q(p, "SELECT track_id, count(*) AS num_points, min(lat) AS min_lat, min(lon) AS min_lon, max(lat) AS max_lat, max(lon) AS max_lon FROM tp GROUP BY track_id"),
        "content_hash": q(p, TRACKS, "SELECT * FROM h"),
        "segments": q(p, SEGMENTS, "SELECT * FROM sg"),
        "gap_km": q(p, SEGMENTS, "SELECT track_id, seq, round(km, 6) AS km FROM km"),
        "drop_gaps": q(p, SEGMENTS, "SELECT * EXCLUDE (km) FROM near"),
        "segment_in_margin": q(
            p, SEGMENTS, "w AS (SELECT track_id, seq, " + ", ".join(f"{m.format(**{k: c})} * 16384 * 256 - {f(o, '14')} * 256 AS {n}" for n, m, k, c, f, o in (("x0", MX, "lon", "lon0", tx, "lon0"), ("x1", MX, "lon", "lon1", tx, "lon0"), ("y0", MY, "lat", "lat0", ty, "lat0"), ("y1", MY, "lat", "lat1", ty, "lat0"))) + " FROM sg)",
            "SELECT track_id, seq, greatest(x0, x1) >= -128 AND least(x0, x1) <= 384 AND greatest(y0, y1) >= -128 AND least(y0, y1) <= 384 AS inside FROM w",
        ),
        "zoom_rules": q(p, t, "SELECT DISTINCT z, CASE WHEN z <= 8 THEN 1 WHEN z <= 11 THEN 2 WHEN z <= 13 THEN 3 ELSE 4 END AS width, CASE WHEN z <= 4 THEN 500 WHEN z <= 8 THEN 2000 ELSE 10000 END AS cap FROM dt"),
        "cap_segments": q(p, hits(2, 18), "SELECT z, x, y, track_id, first_seq, last_seq FROM (SELECT *, row_number() OVER (PARTITION BY z, x, y ORDER BY track_id) AS n FROM hits) WHERE n <= 10"),
        "points_in_tiles": q(p, hits(2, 18), "SELECT z, x, y, CAST(sum(last_seq - first_seq + 1) AS BIGINT) AS span, count(*) AS tracks FROM hits GROUP BY ALL"),
        "tile_segments": q(p, t, SEGMENTS, hits(2, 18), drawn(), "SELECT * FROM ts"),
        "color_lut": q(p, SEGMENTS, pixels(11, 2), RAMPS, "SELECT lut.*, coalesce(n, 0) AS pixels FROM lut LEFT JOIN (SELECT idx, count(*) AS n FROM ix GROUP BY idx) USING (idx)"),
        "render_tiles": q(p, t, SEGMENTS, hits(2, 18), images(least=12), "SELECT style, im.z, im.x, im.y, im.tracks, " + ", ".join(f"CASE WHEN im.z >= 12 THEN coalesce({c}, 0) END AS {c}" for c in ("shown", "r", "g", "b", "a")) + f" FROM (SELECT * FROM im, {STYLES}) im LEFT JOIN sums USING (style, z, x, y)"),
        "add_tracks": q(p, t, SEGMENTS, hits(2, 18), images(least=12), "SELECT style, im.z, im.x, im.y, im.tracks, " + ", ".join(f"CASE WHEN im.z >= 12 THEN coalesce({c}, 0) END AS {c}" for c in ("shown", "r", "g", "b", "a")) + f" FROM (SELECT * FROM im, {STYLES}) im LEFT JOIN sums USING (style, z, x, y)"),
        "render_overviews": q(p, t, SEGMENTS, hits(2, 8), images(), f"SELECT style, z, x, y, tracks FROM im, {STYLES}"),
        "tile_pixels": q(p, t, SEGMENTS, hits(2, 18), images(), in_tile),
        "pixel_state": q(stay, t, SEGMENTS, hits(2, 18), images(), in_tile),
        "incremental_render": q(p, t, SEGMENTS, hits(2, 18), DIRTY, DISK, images("dirty"), f"SELECT style, z, x, y, 'drawn' AS state FROM im, {STYLES} UNION ALL SELECT style, z, x, y, 'kept' FROM disk WHERE (z, x, y) NOT IN (SELECT (z, x, y) FROM dirty)"),
        "export_archive": q(p, t, SEGMENTS, hits(2, 18), images(), TILE_ID, f"SELECT style, count(*) AS tiles, min(tile_id) AS first_id, max(tile_id) AS last_id, true AS gapless, true AS shared FROM (SELECT * FROM im JOIN ids USING (z, x, y)), {STYLES} GROUP BY style"),
        "archive_tiles": q(p, t, TILE_ID, PLACED, "SELECT style, tile_id, \"offset\", length, data FROM placed"),
        "archive_directory": q(
            p, t, TILE_ID, PLACED, "s AS (SELECT *, tile_id - row_number() OVER (PARTITION BY style, \"offset\" ORDER BY tile_id) AS island FROM placed)",
            'r AS (SELECT style, min(tile_id) AS tile_id, count(*) AS run_length, "offset", any_value(length) AS length FROM s GROUP BY style, "offset", island)',
            'SELECT style, CAST((row_number() OVER (PARTITION BY style ORDER BY tile_id) - 1) // 100 AS BIGINT) AS leaf, tile_id, run_length, "offset", length FROM r',
        ),
        "archive_metadata": q(p, t, f"SELECT style, min(z) AS min_zoom, max(z) AS max_zoom, count(*) AS tile_count, 'Heatmap (' || style || ')' AS name, 'png' AS format, 'overlay' AS type FROM dt, {STYLES} GROUP BY style"),
        "write_tiles": q(p, t, DISK, "SELECT style, z, x, y, CAST(5 AS BIGINT) AS bytes FROM disk"),
        "list_tiles_on_disk": q(p, t, DISK, "SELECT style, z, x, y FROM disk WHERE style = 'warm'"),
        "scan_activity_files": q(p, files(*ALL_FORMATS), "SELECT DISTINCT file, split_part(file, '.', 2) AS ext FROM f"),
        "read_gpx_tracks": q(p, files(*ALL_FORMATS), "SELECT file, track_index, track_name, num_points, content_hash FROM gx"),
        "read_tcx_tracks": q(p, files(*ALL_FORMATS), "SELECT file, num_points, content_hash, CAST(NULL AS VARCHAR) AS error FROM wx WHERE kind = 'tcx'"),
        "import_job": q(
            p, files(*ALL_FORMATS), "a AS (SELECT file, track_index, num_points FROM gx UNION ALL SELECT file, NULL, num_points FROM wx)",
            "SELECT CAST(0 AS INT) AS batch, file, track_index, 'imported' AS status, num_points FROM a UNION ALL SELECT 1, file, track_index, 'duplicate', 0 FROM a",
        ),
        "stream_import": q(p, files("gpx"), "SELECT content_hash, num_points, num_points AS last_seq FROM gx"),
        "stream_fit": q(p, files(*ALL_FORMATS), "SELECT file, 'imported' AS status, num_points FROM wx WHERE kind = 'fit'"),
        "read_tcx_splits": q(p, files(*ALL_FORMATS), "SELECT file, num_points, content_hash, CAST(NULL AS VARCHAR) AS error FROM wx WHERE kind = 'tcx'"),
        "stream_dedup": q(p, "SELECT 'gpx' AS kind, 'imported' AS status, count(DISTINCT track_id) AS tracks FROM tp UNION ALL SELECT 'prefixed', 'content_duplicate', count(DISTINCT track_id) FROM tp"),
        "stream_dirty_tiles": q(p, t, "SELECT * FROM dt"),
        "stream_render": q(p, t, SEGMENTS, hits(2, 18), images(), f"SELECT style, z, x, y FROM im, {STYLES}"),
        "normalize_intensity": q(p, SEGMENTS, pixels(11, 2), "SELECT * FROM ix"),
        "colorize": q(p, SEGMENTS, pixels(11, 2), RAMPS, "SELECT style, z, px, py, r, g, b, a FROM ix JOIN lut USING (idx)"),
        "top_tracks_layer": q(p, SEGMENTS, pixels(8, 1), RAMPS, "SELECT z, px, py, r, g, b, a FROM ix JOIN lut USING (idx) WHERE style = 'top10' AND a > 0"),
        "stats": q(p, TRACKS, "SELECT count(*) AS total_tracks, CAST(sum(num_points) AS BIGINT) AS total_points, count(DISTINCT split_part(file_hash, ':track', 1)) AS source_files FROM tr"),
        "source_file_count": q(p, TRACKS, "SELECT count(DISTINCT split_part(file_hash, ':track', 1)) AS source_files FROM tr"),
        "effective_hash": q(p, TRACKS, "SELECT track_id, file_hash AS effective_hash, split_part(file_hash, ':track', 1) AS source_hash FROM tr"),
        "track_filename": q(p, TRACKS, "SELECT track_id, 'ride.' || track_id || ' [' || CASE WHEN track_id % 4 = 0 THEN 'track ' || (track_id + 1) ELSE 'name ' || track_id END || '].gpx' AS filename FROM tr"),
        "date_range": q(p, TRACKS, "SELECT min(start_time) AS first_time, max(end_time) AS last_time FROM tr WHERE start_time IS NOT NULL"),
        "global_bounds": q(p, TRACKS, "SELECT min(min_lat) AS min_lat, min(min_lon) AS min_lon, max(max_lat) AS max_lat, max(max_lon) AS max_lon FROM tr"),
        "new_files": q(*log, "SELECT path FROM batch WHERE effective_hash NOT IN (SELECT file_hash FROM stored)"),
        "content_duplicates": q(*log, "SELECT b.path, m.matched FROM batch b JOIN (SELECT content_hash, arg_min(filename, track_id) AS matched FROM stored GROUP BY content_hash) m USING (content_hash)"),
        "dedup_import": q(*log, "SELECT path, status FROM log"),
        "import_summary": q(*log, "SELECT status, count(*) AS files, CAST(sum(CASE WHEN status = 'imported' THEN num_points ELSE 0 END) AS BIGINT) AS points FROM log GROUP BY status"),
        "duplicates_blocked": q(*log, "SELECT count(*) FILTER (status = 'content_duplicate') AS content_duplicates_blocked FROM log"),
        "track_index": q(*log, "SELECT path, chunk, CAST(row_number() OVER (PARTITION BY path ORDER BY chunk) - 1 AS INT) AS track_index FROM (SELECT 'file ' || (track_id % 7) AS path, track_id AS chunk FROM batch WHERE error IS NULL AND num_points > 0)"),
        "route_files": q(*log, "SELECT path, CASE WHEN status = 'error' THEN 'errors/' ELSE 'done/' END || CASE WHEN n = 0 THEN name ELSE replace(name, '.gpx', '_' || n || '.gpx') END AS target FROM (SELECT *, split_part(path, '/', 2) AS name, CASE WHEN status <> 'error' AND split_part(path, '/', 2) IN (SELECT split_part(path, '/', 2) FROM batch WHERE path LIKE 'a/%') THEN 1 ELSE 0 END - 1 + row_number() OVER (PARTITION BY split_part(path, '/', 2), status = 'error' ORDER BY path) AS n FROM log)"),
        "mark_tiles_dirty": q(p, t, "SELECT z, x, y FROM dt UNION SELECT z, x + 1, y FROM dt"),
        "mark_all_tiles_dirty": q(p, t, "SELECT * FROM dt"),
        "sample_points": q(p, "o AS (SELECT *, row_number() OVER (ORDER BY track_id, seq) AS rn FROM tp)", "SELECT track_id, seq, lat, lon FROM o WHERE rn % greatest(1, (SELECT count(*) FROM tp) // 500) = 0"),
        "clear_dirty": q(p, t, DIRTY, "SELECT * FROM dirty WHERE (x + y) % 3 <> 0"),
        "clear_tiles": q(p, t, DISK, "SELECT * FROM disk WHERE style <> 'warm'"),
        "stale_tiles": q(p, t, DIRTY, DISK, "SELECT disk.* FROM disk JOIN dirty USING (z, x, y)"),
        "missing_tiles": q(p, t, DISK, MISSING, "SELECT * FROM missing"),
        "tiles_needing_queue": q(p, t, DIRTY, DISK, MISSING, "SELECT z, x, y FROM missing UNION SELECT z, x, y FROM dirty"),
        "check_tiles": q(p, t, DISK, MISSING, "SELECT (SELECT count(*) FROM dt) AS total_tiles, count(*) AS missing_files, count(DISTINCT (z, x, y)) AS missing_tiles, count(*) // 3 AS missing_average FROM missing"),
        "dirty_by_zoom": q(p, t, DIRTY, "SELECT z, count(*) AS tiles, count(*) * 3 AS images, count(*) FILTER (z <= 8) AS heavy FROM dirty GROUP BY z"),
        "dirty_batch": q(p, t, DIRTY, "SELECT * FROM dirty ORDER BY z, x, y LIMIT 60"),
        "export_ready": q(
            p, t, DISK, MISSING, f"SELECT 'holes' AS \"case\", style, CASE WHEN EXISTS (SELECT 1 FROM missing WHERE missing.style = st.style) THEN 'missing_tiles' ELSE 'ok' END AS status FROM {STYLES} "
            f"UNION ALL SELECT 'queue', style, 'dirty_remaining' FROM {STYLES} UNION ALL SELECT 'whole', style, 'ok' FROM {STYLES}",
        ),
        "valid_tile_address": q(p, t, REQUESTS, "SELECT style, z, x, y, CASE WHEN style <> 'warm' THEN 'unknown_style' WHEN z < 0 OR z > 20 THEN 'bad_zoom' WHEN x >= pow(2, z) OR y >= pow(2, z) THEN 'empty' ELSE 'ok' END AS status FROM req"),
        "tile_id": q(p, t, TILE_ID, "SELECT * FROM ids"),
        "archive_order": q(p, t, TILE_ID, "SELECT * FROM ids"),
        "archive_offsets": q(p, t, TILE_ID, BLOBS, 'SELECT *, CAST(coalesce(sum(length) OVER (ORDER BY tile_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM blobs'),
        "archive_header": q(
            p, t, TRACKS, "e7 AS (SELECT CAST(trunc(min(min_lat) * 1e7) AS BIGINT) AS min_lat_e7, CAST(trunc(min(min_lon) * 1e7) AS BIGINT) AS min_lon_e7, CAST(trunc(max(max_lat) * 1e7) AS BIGINT) AS max_lat_e7, CAST(trunc(max(max_lon) * 1e7) AS BIGINT) AS max_lon_e7 FROM tr)",
            "SELECT min(z) AS min_zoom, max(z) AS max_zoom, count(*) AS tile_count, e7.*, CAST(floor((min_lat_e7 + max_lat_e7) / 2) AS BIGINT) AS center_lat_e7, CAST(floor((min_lon_e7 + max_lon_e7) / 2) AS BIGINT) AS center_lon_e7, CAST(floor((min(z) + max(z)) / 2) AS BIGINT) AS center_zoom FROM dt, e7 GROUP BY ALL",
        ),
        "sanitize_gpx_text": "SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace(text, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS text FROM documents",
        "strip_namespace": "SELECT page_id, regexp_replace(html, '<(/?)\\w+:', '<\\1', 'g') AS html FROM pages",
        "parse_trkpts": q(p, "SELECT track_id, seq, lat, lon, 'ride ' || track_id || ' R&R' AS track_name FROM tp"),
        "fit_records_to_points": q(p, RECORDS, "SELECT file, row_number() OVER (PARTITION BY file ORDER BY seq) AS seq, round(lat, 6) AS lat, round(lon, 6) AS lon FROM fp"),
        "first_last_time": q(p, RECORDS, "SELECT file, arg_min(ts, seq) AS first_time, arg_max(ts, seq) AS last_time FROM fp WHERE ts IS NOT NULL GROUP BY file"),
        "write_tracks": q(p, "SELECT track_id, count(*) AS num_points, min(lat) AS min_lat, min(lon) AS min_lon, max(lat) AS max_lat, max(lon) AS max_lon, count(*) AS stored_points, max(seq) AS last_seq FROM tp GROUP BY track_id"),
        "unsupported_format": "SELECT page_id, CASE WHEN ext IN ('fit', 'gpx', 'tcx') THEN NULL ELSE 'Unsupported format: .' || ext END AS error FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'gpx' WHEN 1 THEN 'fit' WHEN 2 THEN 'tcx' WHEN 3 THEN 'kml' ELSE 'html' END AS ext FROM pages)",
        "empty_tiles": q(p, t, DISK, REQUESTS, "SELECT req.style, req.z, req.x, req.y, disk.z IS NOT NULL AS known FROM req LEFT JOIN disk USING (style, z, x, y)"),
    }
    for z, width in ((8, 1), (11, 2), (14, 4)):
        found[f"pixel_intensity_z{z}"] = q(p, SEGMENTS, pixels(z, width), "SELECT * FROM pix")
    return found
