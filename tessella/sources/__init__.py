"""Reading and writing annotations, records, metrics, image tables and sidecars."""
