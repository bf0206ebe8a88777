"""Query plans over whole tables, and the catalogue of registered queries."""
