"""Document analytics on Spark: segmentation, checks, packing, resumable work."""
