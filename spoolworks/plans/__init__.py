"""Named queries over the tables of a scale folder, and the SQL that gives the same rows."""
