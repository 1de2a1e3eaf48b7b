"""A Spark engine for labelled time series: selection, relabeling, ingestion, blocks and delivery."""
