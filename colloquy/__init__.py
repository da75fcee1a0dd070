"""Colloquy: conversation and activity analytics on Spark."""
