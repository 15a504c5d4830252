"""Jobs a user runs: tables in, tables out."""
