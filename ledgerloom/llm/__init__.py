"""Training-data operators. Nothing outside this folder (and the guarded hook in ``__spark_entry__``) imports it."""
