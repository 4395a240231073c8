"""Contig-end overhang analytics on PySpark."""
