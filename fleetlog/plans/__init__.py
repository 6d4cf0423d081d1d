"""Reports: whole questions put together from operators."""
