"""Incremental variants of the grouped summaries (Structured Streaming).

The reference has no streaming operator; this package keeps the discharge summary (A1/A2) up
to date as new discharge files land, with the same aggregate expressions as the batch form.
"""

from carelens.streaming.summary import los_stream, start_summary  # noqa: F401
