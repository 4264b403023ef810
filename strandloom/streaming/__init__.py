"""Structured Streaming forms of word counts and scans."""
