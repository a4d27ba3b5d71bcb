"""Preparation, feature maps, blocked sums, shard solves and scoring."""
