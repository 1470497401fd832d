"""Operators on tracks, detections and matches."""
