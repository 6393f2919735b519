"""Readers, document parsers, sinks and the adapter views over the test tables."""
