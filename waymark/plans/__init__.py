"""Plans: configuration, the accessibility run, and the catalogue of driver queries."""
