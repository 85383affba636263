"""Reading and writing page tables, word lists, models and results."""
