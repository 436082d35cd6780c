"""Keyed change logs on Spark: state, files, maintenance, codecs and streams."""
