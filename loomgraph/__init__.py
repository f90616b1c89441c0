"""Analytics over code graphs, and operations for training-data pipelines, as PySpark DataFrame transforms."""
