"""Sources and sinks: driver tables, derived views, file catalogues, JSON history."""
