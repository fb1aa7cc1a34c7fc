"""Incremental forms of operators whose batch form has no stream; a replayed source gives the batch result."""
