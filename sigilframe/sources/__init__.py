"""Readers and writers of catalogs, feature tables, markup and rasters."""
