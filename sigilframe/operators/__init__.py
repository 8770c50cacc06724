"""Relational and raster operators over symbol catalogs."""
