"""Region and variant feature analytics as generic DataFrame operators over column names."""
