"""Readers and writers of tracking, label and metric files."""
