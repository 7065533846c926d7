"""GPS heatmaps as Spark jobs: files, tracks, points, tiles, pixels, archives."""
