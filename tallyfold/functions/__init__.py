"""Column expressions: cleaning, harmonising, calendar."""
