"""Glyphmill: analytics over collections of scanned service documents, on Spark DataFrames."""
