"""Reading and writing tables, vector stores and the evaluation log."""
