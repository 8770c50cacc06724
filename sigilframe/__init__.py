"""sigilframe: Spark-native analytics for collections of visual symbols and their metadata."""
