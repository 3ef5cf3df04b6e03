"""Column functions over listing titles, prices and pages."""
