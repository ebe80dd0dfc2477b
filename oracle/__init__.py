"""The expected result of every query, as SQL for another engine over the same tables."""
