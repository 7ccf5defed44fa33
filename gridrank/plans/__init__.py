"""Plans that put operators together, and the queries of the driver's entry module."""
