"""Evidence analytics as lazy Spark plans."""
