"""Models that grow with a stream, and segmentation of streams."""
