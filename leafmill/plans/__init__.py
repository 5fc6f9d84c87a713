"""Named queries over the supplied tables, each with equivalent SQL."""
