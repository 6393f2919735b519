"""Bulk planning jobs: byte targets, bitrates, resolutions, presets and estimates."""
