"""scenetables: analytics on driving-scene tables (poses, boxes, maps, points, captions) as Spark DataFrames."""
