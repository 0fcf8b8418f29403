"""Column builders: paths, numbers, boxes."""
