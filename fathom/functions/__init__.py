"""Column expressions shared by the rules."""
