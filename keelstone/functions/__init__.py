"""Key codecs and resolve functions."""
