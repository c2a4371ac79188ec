"""Every operator as a named query over the given tables, with its ANSI SQL twin where one exists."""
