"""Named queries over the driver's tables, with the SQL that they must agree with."""
