"""inkfold: Spark-native analytics over rasters, outlines and print documents."""
