"""Batch and streaming analytics over structured normative documents on Spark."""
