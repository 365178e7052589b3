"""Shardweave: analytics over partitioned, feature-carrying graphs, and text preparation at scale, on Spark."""
