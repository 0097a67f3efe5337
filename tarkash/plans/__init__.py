"""Queries by subject; each module has `queries()` and `oracle_sql()`."""

from tarkash.plans import documents, engine, parsing, relational, replies, retrieval, structures, texts

MODULES = (retrieval, relational, texts, structures, documents, replies, parsing, engine)
