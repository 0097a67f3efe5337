from tarkash.sources.tables import read_table, session  # noqa: F401
