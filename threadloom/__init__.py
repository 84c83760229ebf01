"""Conversation and tool-call log analytics on Spark DataFrames."""
