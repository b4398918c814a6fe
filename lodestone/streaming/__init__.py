"""Structured Streaming over the event feed and over change feeds."""
