"""Incremental runs of the batch operators. The label project itself has no streams, so there is only a restartable ingest."""
