"""polytrace: multichannel time-series analytics expressed as Spark plans."""
