"""Trace files: `wire` (numbers and values as bytes), `waves` and `txns` (data blocks), `container` (frames, descriptions,
index), `codecs` (blocks of other forms), `calls`, `writer` (one file) and `trace` (the Spark data source)."""
