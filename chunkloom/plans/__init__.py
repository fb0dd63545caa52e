"""Query plans over the chunk table and the catalogs."""
