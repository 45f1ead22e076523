"""Graph operators over KGraph."""
