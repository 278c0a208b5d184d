"""Property-graph analytics as DataFrame programs."""
