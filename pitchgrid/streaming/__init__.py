"""Stateful operators on streams; each shares its state function with the batch operator."""
