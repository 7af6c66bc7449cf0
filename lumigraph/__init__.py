"""lumigraph: a media-intelligence analytics engine expressed as Spark plans."""
