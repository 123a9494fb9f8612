"""Conversation analytics on Spark: DataFrame operators over libraries of timed, attributed text."""
