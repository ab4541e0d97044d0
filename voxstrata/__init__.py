"""Spark-native analytics over voxels, blocks, skeleton graphs and point sets."""
