"""The registered queries, and the SQL that each should equal."""
