"""Named queries over the shared tables, each with an independent SQL twin."""
