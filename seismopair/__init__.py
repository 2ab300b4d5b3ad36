"""Event catalogs, waveform pairs and event families as Spark DataFrame pipelines."""
