"""Physical helpers: stored intermediate tables and range-partitioned ordered computations."""
