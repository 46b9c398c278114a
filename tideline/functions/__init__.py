"""Column expressions: nothing here starts a job or shuffles."""
