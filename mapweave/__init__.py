"""Spark-native analytics over robot recordings, transform trees and voxel maps."""
