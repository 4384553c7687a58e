"""Event data of pixelated, time-stamping detectors as Spark DataFrames."""
