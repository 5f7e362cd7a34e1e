"""The registered queries, grouped by topic; each has a SQL twin where one can be written."""
