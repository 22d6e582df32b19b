"""All registered queries and the SQL that must give the same rows."""

from . import files, marts, reports, sources, streams

QUERIES = {**sources.QUERIES, **files.QUERIES, **reports.QUERIES, **marts.QUERIES, **streams.QUERIES}
SQL = {**sources.SQL, **files.SQL, **reports.SQL, **marts.SQL, **streams.SQL}
