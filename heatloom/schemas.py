"""Table schemas."""

PARSED_TRACKS = "path string, file_hash string, track_index int, ext string, track_name string, start_time string, end_time string, points array<struct<lat:double,lon:double>>, error string"
TRACKS = "track_id long, filename string, file_hash string, content_hash string, num_points long, start_time string, end_time string, min_lat double, min_lon double, max_lat double, max_lon double, imported_at timestamp"
TRACKPOINTS = "track_id long, seq long, lat double, lon double"
TILES = "z int, x long, y long"
IMPORT_LOG = "batch_id long, path string, track_index int, filename string, status string, num_points long, error string"
STYLES = ("cool", "top10", "warm")
