"""Incremental forms of batch operators (an extension: the batch engine has no streams of its own)."""
