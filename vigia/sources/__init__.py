"""Reading and writing incident tables."""
