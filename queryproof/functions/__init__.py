"""Column expressions: canonical text, rule ladders, verdicts and scores."""
