"""Structured Streaming jobs over growing inputs."""
