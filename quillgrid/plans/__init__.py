"""Strategy, reports and registered queries."""
