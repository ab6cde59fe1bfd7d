"""Metric learners: distributed sums, then dense algebra of the vectors' size on the driver."""
