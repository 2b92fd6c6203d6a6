"""Column expressions for money, calendar periods and text keys."""
