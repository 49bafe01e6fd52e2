"""Scene graphs: tables, normalisation and query generation."""
