"""Source-repository and corpus analytics as DataFrame queries."""
