"""Model tables and the registered queries."""
