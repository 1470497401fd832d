"""Views of the driver's tables as tracks and detections, and the registered queries with their oracle SQL."""
