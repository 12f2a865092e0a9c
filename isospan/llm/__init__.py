"""Training-data pipeline operators.

Self-contained: nothing outside this subpackage imports it, and its modules
are imported one by one so that an executor loads only what a task needs.
"""
