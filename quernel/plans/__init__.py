"""Planning helpers: cutting lineage, sizing joins and partitions."""
