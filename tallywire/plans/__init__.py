"""Reports assembled from the operators."""
