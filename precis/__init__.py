"""Extractive text summarization as Spark jobs.

Every public function takes and returns a ``DataFrame`` (or a ``Column``); nothing runs at import time.
"""
