"""Spark-native registry analytics: records in, organisation-by-year panel out."""

from orgpanel.functions.registered import register
from orgpanel.plans.pipeline import assign, cites, cluster, concat_source, concat_tables, export_csv, merge, parse, read_csv, read_table
from orgpanel.sources.fetch import fetch_file, fetch_many, manifest

__all__ = ["assign", "cites", "cluster", "concat_source", "concat_tables", "export_csv", "fetch_file", "fetch_many", "manifest", "merge", "parse", "read_csv", "read_table", "register"]
