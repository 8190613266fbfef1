"""The queries behind `__spark_entry__`: each runs over whole tables, beside its SQL."""
