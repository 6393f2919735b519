"""Structured Streaming jobs over progress events and progress logs."""
