"""Readers of graphs, partitioner output, matrices, arrays, settings and logs."""
