"""Where the rows come from: file trees, source text, and the driver tables."""
