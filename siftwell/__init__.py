"""A Spark-native search engine over collections of files and documents."""
