"""Events: batch queries and streams."""
