"""Registered queries over the driver's tables, each with the SQL of its result where SQL can express it."""
