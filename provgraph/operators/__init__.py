"""Operators on edge tables, graphs, snapshots, features, scores."""
