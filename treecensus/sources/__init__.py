"""Reading and writing inventories."""
