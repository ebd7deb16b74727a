"""procmill: PySpark-native analytics over process descriptions, process models and their run histories."""
