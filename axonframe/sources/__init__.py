"""File catalogue, CSV, text-log and raster readers and writers."""
