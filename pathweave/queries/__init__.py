"""The core's queries: name -> callable(spark, sf_dir), and the SQL that says the same where SQL can."""

from pathweave.queries import entities, files, graphs, interactions, problems, searches

MODULES = (problems, entities, searches, graphs, interactions, files)
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
