"""Column functions: arrays, hashes, colours, geometry, nested values, paths."""
