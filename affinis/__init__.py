"""affinis: Spark-native similarity analytics over sparse ratings and documents."""

__version__ = "0.1.0"
