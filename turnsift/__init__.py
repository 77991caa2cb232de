"""Conversation-log cleaning, de-duplication, command extraction and reporting as Spark jobs."""
