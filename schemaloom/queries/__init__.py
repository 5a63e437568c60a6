"""The library's queries, by family, and their DuckDB SQL."""

from __future__ import annotations

from schemaloom.queries import catalog, data, files, models, names, vocabularies

QUERIES = data.QUERIES | names.QUERIES | models.QUERIES | vocabularies.QUERIES | files.QUERIES | catalog.QUERIES
ORACLE = data.ORACLE | names.ORACLE | models.ORACLE | vocabularies.ORACLE | files.ORACLE | catalog.ORACLE
