"""Batch and streaming jobs for forensic timelines and text corpora on Spark."""
