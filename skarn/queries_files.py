"""Registered queries of repository files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .queries import Inputs, query
from .sources.ignore_rules import ignore_rules, without_ignored

#: Ignore files of the bound repository: nested, negated, of folders, anchored.
IGNORE_FILES = [
    (".gitignore", "*.md\n!f1*.md\nvendor/\n**/workflows/*.yaml\n/tools/f?.py\n"),
    ("src/.gitignore", "# tests\ntests/*\n!tests/f*0.rs\n"),
    ("vendor/x/.gitignore", "!*\n"),
]


@query("s3_ignored_files", " SELECT path FROM repo_files WHERE NOT CASE WHEN path LIKE 'vendor/%' THEN true WHEN path LIKE 'src/tests/%' THEN path NOT LIKE 'src/tests/f%0.rs' WHEN path LIKE '%.md' THEN NOT regexp_matches(path, '(^|/)f1[^/]*$') WHEN path LIKE '%/workflows/%' THEN path LIKE '%.yaml' ELSE regexp_matches(path, '^tools/f.[.]py$') END", "repo_files")
def _(t: Inputs) -> DataFrame:
    return without_ignored(t("repo_files"), ignore_rules(t.spark.createDataFrame(IGNORE_FILES, "path string, content string")))
