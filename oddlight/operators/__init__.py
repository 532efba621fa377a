"""DataFrame operators on patches, maps, banks, statistics and detections."""
