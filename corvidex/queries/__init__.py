"""Named queries over a data directory, and the SQL that says what they must return."""
