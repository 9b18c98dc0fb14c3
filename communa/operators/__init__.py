"""DataFrame operators on graphs and partitions."""
